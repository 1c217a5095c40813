"""Around a model that extracts triples: passes and prompts, injected scorers, tolerant parsing, gold triples, macro and micro scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X

TRIPLE = "struct<subject:struct<name:string,type:string,text:string>,predicate:string,relation:string,object:struct<name:string,type:string,text:string>,evidence:struct<quote:string>>"


def passes(units: DataFrame, templates: list[str], n: int) -> DataFrame:
    """Each unit(text) n times, pass i with template i mod their number; ``{text}`` in a template is the unit."""
    chosen = F.get(F.array(*[F.lit(t) for t in templates]), F.col("pass") % len(templates))
    return units.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("prompt", F.replace(chosen, F.lit("{text}"), F.col("text")))


def scored(rows: DataFrame, columns: list[str], kind: str, load: Callable[[], Callable], name: str = "score", batch: int = 32) -> DataFrame:
    """rows with what a model gives for ``columns``: ``load`` runs once per task and returns a function of lists, called on at most ``batch``
    rows at a time. A call that fails gives nulls for its rows, so one bad reply doesn't end a job."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(frames: Iterator) -> Iterator:
        model = load()
        for pdf in frames:
            out: list = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    out += list(model(*[part[c].tolist() for c in columns]))
                except Exception:
                    out += [None] * len(part)
            pdf[name] = out
            yield pdf

    return rows.mapInPandas(run, schema)


def parsed_triples(reply: Column) -> Column:
    """Triples of a reply: repaired JSON, a list or one object, under 'triples' or by itself; other field names are understood. Null reads as none."""
    body = X.repair_json(reply)
    listed = F.from_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), f"array<{TRIPLE}>")
    inside = F.from_json(body, f"struct<triples:array<{TRIPLE}>>")["triples"]
    name = lambda s: F.coalesce(s["name"], s["text"])
    rows = F.coalesce(F.when(F.size(inside) > 0, inside), listed, F.array().cast(f"array<{TRIPLE}>"))
    fine = F.filter(rows, lambda t: t.isNotNull() & name(t["subject"]).isNotNull() & name(t["object"]).isNotNull())
    return F.transform(fine, lambda t: F.struct(
        name(t["subject"]).alias("s_name"), t["subject"]["type"].alias("s_type"), F.coalesce(t["predicate"], t["relation"]).alias("predicate"),
        name(t["object"]).alias("o_name"), t["object"]["type"].alias("o_type"), t["evidence"]["quote"].alias("quote"),
    ))


def spilled_pages(pages: DataFrame, n: int) -> DataFrame:
    """pages(doc, page, sentences array) with the last n sentences of the page before, which help to embed a page and are cut off after."""
    before = F.lag("sentences").over(Window.partitionBy("doc").orderBy("page"))
    held = F.coalesce(F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n), F.array().cast("array<string>"))
    return pages.withColumn("spill", held).withColumn("units", F.concat("spill", "sentences"))


def pair_within(entities: DataFrame, by: str, left: list[str], right: str, predicate: str) -> DataFrame:
    """entities(by, name, type): triples of each left-typed entity with each right-typed one of its sample. Hot samples are joins Spark may split."""
    d = entities.select(by, "name", "type").distinct()
    a = d.where(F.col("type").isin(left)).select(by, F.col("name").alias("subject"))
    b = d.where(F.col("type") == right).select(by, F.col("name").alias("object"))
    return a.join(b, by).select(by, "subject", F.lit(predicate).alias("predicate"), "object")


def gold_triples(annotations: DataFrame) -> DataFrame:
    """annotations(doc, actor, tools array, techniques array): (tool, executes, technique), or (actor, uses, technique) where there is no tool."""
    who = F.when(F.size("tools") > 0, F.col("tools")).otherwise(F.array("actor"))
    verb = F.when(F.size("tools") > 0, F.lit("executes")).otherwise(F.lit("uses"))
    rows = annotations.select("doc", F.explode(who).alias("subject"), verb.alias("predicate"), "techniques")
    return rows.select("doc", "subject", "predicate", F.explode("techniques").alias("object")).where("subject is not null").distinct()


def set_scores(predicted: DataFrame, gold: DataFrame, by: str, key: list[str]) -> DataFrame:
    """Macro (mean over samples) and micro (pooled) precision, recall and F1 of distinct keys. A sample without either set scores 0."""
    p, g = predicted.select(by, *key).distinct().withColumn("p", F.lit(1)), gold.select(by, *key).distinct().withColumn("g", F.lit(1))
    both = p.join(g, [by, *key], "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = both.groupBy(by).agg(n(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"), n(F.col("p").isNotNull()).alias("np"), n(F.col("g").isNotNull()).alias("ng"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def prf(hit: Column, np: Column, ng: Column) -> list[Column]:
        return [div(hit, np), div(hit, ng), div(2 * hit, np + ng)]

    macro = [F.avg(c) for c in prf(F.col("hit"), F.col("np"), F.col("ng"))]
    micro = prf(F.sum("hit"), F.sum("np"), F.sum("ng"))
    names = [f"{a}_{m}" for a in ("macro", "micro") for m in ("precision", "recall", "f1")]
    return per.agg(F.count("*").alias("samples"), *[c.alias(x) for c, x in zip(macro + micro, names, strict=True)])


def greedy_matches(predicted: DataFrame, gold: DataFrame, by: str, least: float) -> DataFrame:
    """predicted(by, k, text) and gold(by, k, text): each prediction takes only its most similar gold text (TF-IDF cosine in the sample's own
    vocabulary), and counts if that is similar enough and no earlier prediction has it. Returns (by, matched, predicted, gold)."""
    rows = predicted.select(by, F.lit(1).alias("side"), "k", "text").union(gold.select(by, F.lit(0).alias("side"), "k", "text"))
    tf = rows.select(by, "side", "k", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]{2,}"), F.lit(0))).alias("term")).groupBy(by, "side", "k", "term").agg(F.count("*").alias("tf"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    df = tf.groupBy(by, "term").agg(F.count("*").alias("df"))
    w = tf.join(df, [by, "term"]).join(n, by).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    length = w.groupBy(by, "side", "k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    unit = w.join(length, [by, "side", "k"]).select(by, "side", "k", "term", (F.col("w") / F.col("l")).alias("u"))
    a = unit.where("side = 1").select(by, F.col("k").alias("pk"), "term", F.col("u").alias("pu"))
    b = unit.where("side = 0").select(by, F.col("k").alias("gk"), "term", F.col("u").alias("gu"))
    cosine = a.join(b, [by, "term"]).groupBy(by, "pk", "gk").agg(F.round(F.sum(F.col("pu") * F.col("gu")), 9).alias("c"))
    best = cosine.groupBy(by, "pk").agg(F.min(F.struct((-F.col("c")).alias("s"), "gk")).alias("b")).where(-F.col("b.s") >= least)
    matched = best.groupBy(by, F.col("b.gk").alias("gk")).agg(F.min("pk")).groupBy(by).agg(F.count("*").alias("matched"))
    sizes = rows.groupBy(by).agg(F.sum("side").alias("predicted"), F.sum(1 - F.col("side")).alias("gold"))
    return sizes.join(matched, by, "left").select(by, F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.col("predicted").cast("long").alias("predicted"), F.col("gold").cast("long").alias("gold"))


def loose_json_list(reply: Column) -> Column:
    """Triples between the first and the last square bracket of a reply; none if that is no JSON list. Fences are passed over."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), f"array<{TRIPLE}>"), F.array().cast(f"array<{TRIPLE}>"))


def any_json(reply: Column) -> Column:
    """Triples of a reply that is a JSON list or one object, in fences or not; else of the list within it; else none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```(json)?", ""), r"```$", ""))
    whole = F.when(bare.startswith("["), F.from_json(bare, f"array<{TRIPLE}>")).when(bare.startswith("{"), F.array(F.from_json(bare, TRIPLE)))
    return F.coalesce(whole, loose_json_list(reply))


def triple_list(triples: Column) -> Column:
    """Names, types and predicates of parsed triples, under either field name, empty where there is none; nulls in the list are passed over."""
    word = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    return F.transform(F.filter(triples, lambda t: t.isNotNull()), lambda t: F.struct(
        word(t["subject"]["name"], t["subject"]["text"]).alias("s_name"), word(t["subject"]["type"]).alias("s_type"), word(t["predicate"], t["relation"]).alias("predicate"),
        word(t["object"]["name"], t["object"]["text"]).alias("o_name"), word(t["object"]["type"]).alias("o_type"),
    ))


def is_allowed(s_type: Column, predicate: Column, o_type: Column, types: list[str], predicates: list[str]) -> Column:
    """Both types are allowed as they are and the predicate is when trimmed."""
    return F.coalesce(F.trim(predicate).isin(predicates) & s_type.isin(types) & o_type.isin(types), F.lit(False))


def is_evidenced(s_name: Column, s_type: Column, predicate: Column, o_name: Column, o_type: Column, quote: Column, types: list[str], predicates: list[str]) -> Column:
    """Allowed, with both names and a quote that isn't blank."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    return is_allowed(s_type, predicate, o_type, types, predicates) & some(s_name) & some(o_name) & some(F.trim(quote))


def chunk_data(units: DataFrame, types: list[str], predicates: list[str]) -> DataFrame:
    """units(sentence, page_no, i, triples array of s_name, s_type, predicate, o_name, o_type, quote) -> what a report's file holds: the context, its
    allowed triples nested, page number, three-digit id and source; units without any are left out."""
    kept = F.filter("triples", lambda t: is_allowed(t["s_type"], t["predicate"], t["o_type"], types, predicates))
    nested = F.transform(kept, lambda t: F.struct(F.struct(t["s_name"].alias("name"), t["s_type"].alias("type")).alias("subject"), t["predicate"].alias("predicate"), F.struct(t["o_name"].alias("name"), t["o_type"].alias("type")).alias("object"), F.struct(t["quote"].alias("quote")).alias("evidence")))
    meta = F.struct(F.col("page_no").alias("page_number"), F.lpad(F.col("i").cast("string"), 3, "0").alias("id"), F.lit("TEXT").alias("source"))
    return units.select(F.col("sentence").alias("context"), nested.alias("triple"), meta.alias("metadata")).where(F.size("triple") > 0)


def statement_text(s_name: Column, predicate: Column, o_name: Column) -> Column:
    """The line that is embedded for a triple."""
    return F.concat_ws(" ", s_name, predicate, o_name)


def extraction_prompt(text: Column, types: list[str], predicates: list[str], several: bool) -> Column:
    """What a model is asked about a sentence, or with ``several`` about a chunk of them: triples as a JSON array with a quote each."""
    what = "these sentences" if several else "this sentence"
    return F.concat(
        F.lit(f"Extract threat-intelligence triples from {what}. Types: {', '.join(sorted(types))}. Predicates: {', '.join(sorted(predicates))}. Use only what the text says. "
              'Answer with a JSON array of {"subject": {"name", "type"}, "predicate", "object": {"name", "type"}, "evidence": {"quote"}}, and [] if there is none.\nText: '), text,
    )
