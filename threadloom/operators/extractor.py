"""An extraction run over pages: units, gate, passes of a model, consensus, validation, and what the run reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import chunking, extraction, triples
from threadloom.session import written
from threadloom.sources.config import Options

# ---- fixed values: the least length of a unit, likeness of names in a run's consensus, the order in which one stage is chosen ----
LEAST_UNIT, LIKENESS = 40, 0.50
PRIORITY = ("SENTENCE_CONSENSUS", "SENTENCE_SINGLE", "CHUNK_CONSENSUS", "CHUNK_SINGLE")
# ---- end of fixed values ----


@dataclass(frozen=True)
class Run:
    """``chunks``: accepted triples by unit; ``rejected``: the others with a reason; ``pages``: counts by page; ``metrics``: a row per report."""

    chunks: DataFrame
    rejected: DataFrame
    pages: DataFrame
    metrics: DataFrame


def units_of(pages: DataFrame, chunks: bool, embed: Callable | None = None) -> DataFrame:
    """pages(doc, page, text) -> (doc, page, i, unit): the sentences of a page, or with ``chunks`` runs of like neighbours among them."""
    sentences = pages.select("doc", "page", X.sentences(F.col("text")).alias("sentences"))
    if not chunks:
        return sentences.select("doc", "page", F.posexplode("sentences").alias("i", "unit"))
    keyed = sentences.select(F.struct("doc", "page").alias("key"), "sentences")
    flat = chunking.chunked_texts(keyed.withColumn("id", F.to_json("key")).select("id", "sentences"), "id", embed)
    back = flat.join(keyed.select(F.to_json("key").alias("id"), "key.doc", "key.page").distinct(), "id")
    return back.select("doc", "page", F.col("chunk").alias("i"), F.col("text").alias("unit"))


def reason(s_type: Column, predicate: Column, o_type: Column, types: tuple, predicates: tuple) -> Column:
    """Why a triple isn't accepted, null if it is."""
    out = F.when(predicate.isNull(), "invalid_predicate_type").when(~F.trim(predicate).isin(*predicates), "predicate_not_in_ontology")
    out = out.when(~F.coalesce(s_type.isin(*types), F.lit(False)), "subject_type_not_in_ontology")
    return out.when(~F.coalesce(o_type.isin(*types), F.lit(False)), "object_type_not_in_ontology")


def run(pages: DataFrame, load: Callable[[], Callable], options: Options, gate: Callable[[Column], Column] | None = None, templates: list[str] | None = None, types: tuple = triples.TYPES, predicates: tuple = triples.PREDICATES, embed: Callable | None = None, consensus: bool | None = None) -> Run:
    """One stage of extraction over pages(doc, page, text).

    Units of 40 characters or more that pass the ``gate`` go to the model: once, or, with ``consensus`` (by default if more than one pass is asked
    for), as often as ``options`` says with the templates in turn, and what enough passes agree on is kept. Replies are read as JSON; a
    reply that can't be read is none. Replies are written once, since a model costs more than anything here.
    """
    options.checked()
    consensus = options.passes > 1 if consensus is None else consensus
    stage = ("SENTENCE" if options.sentences else "CHUNK") + ("_CONSENSUS" if consensus else "_SINGLE")
    units = units_of(pages, not options.sentences, embed)
    used = units.where(F.length(F.trim("unit")) >= LEAST_UNIT)
    used = used.where(gate(F.col("unit"))) if gate else used
    asked = extraction.passes(used.withColumn("text", F.col("unit")), templates or ["{text}"], options.passes if consensus else 1)
    replied = extraction.scored(asked.select("doc", "page", "i", "unit", "pass", "prompt"), ["prompt"], "string", load, "reply", options.batch)
    replied = written(replied.select("doc", "page", "i", "unit", "pass", "reply"), "replies")
    each = replied.select("doc", "page", "i", "unit", "pass", F.posexplode(extraction.any_json(F.col("reply"))).alias("k", "t")).where("t is not null")
    side = lambda s: F.coalesce(F.col(f"t.{s}.name"), F.col(f"t.{s}.text"))
    raw = each.select(
        "doc", "page", "i", "unit", (F.col("pass") * 1000 + F.col("k")).alias("seq"), side("subject").alias("s_name"), F.col("t.subject.type").alias("s_type"), F.coalesce("t.predicate", "t.relation").alias("predicate"),
        side("object").alias("o_name"), F.col("t.object.type").alias("o_type"), F.col("t.evidence.quote").alias("quote"),
    )
    found = raw
    if consensus:
        place = replied.select(F.struct("doc", "page", "i").alias("key"), "unit").distinct().select(F.to_json("key").alias("id"), "key.doc", "key.page", "key.i", "unit")
        agreed = triples.fuzzy_consensus(raw.withColumn("id", F.to_json(F.struct("doc", "page", "i"))), "id", max(2, options.votes), LIKENESS, types, predicates)
        found = agreed.join(place, "id").select("doc", "page", "i", "unit", F.lit(0).alias("seq"), "s_name", "s_type", "predicate", "o_name", "o_type", "quote")
    why = reason(F.col("s_type"), F.col("predicate"), F.col("o_type"), types, predicates)
    judged = written(found.withColumn("reason", why), "extracted")
    accepted = judged.where("reason is null").dropDuplicates(["doc", "page", "i", "s_name", "s_type", "predicate", "o_name", "o_type"])
    told = F.struct("s_name", "s_type", "predicate", "o_name", "o_type", "quote")
    chunks = accepted.groupBy("doc", "page", "i").agg(F.first("unit").alias("context"), F.array_sort(F.collect_list(told)).alias("triples"))
    rejected = judged.where("reason is not null").select("doc", "page", F.col("i").alias("unit_index"), F.col("unit").alias("context"), told.alias("triple"), F.col("reason").alias("rejection_reason"), F.lit(stage).alias("stage"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    by_page = judged.groupBy("doc", "page").agg(n(F.col("reason").isNull()).alias("valid"), n(F.col("reason").isNotNull()).alias("invalid"), F.count("*").alias("total"))
    size = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    metrics = pages.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("num_pages"))
    for df, name in ((units, "num_sentences_total"), (used, "num_sentences_used"), (raw, "num_raw_triples"), (accepted, "num_valid_triples"), (rejected, "num_invalid_triples")):
        metrics = metrics.join(size(df, name), "doc", "left")
    reasons = rejected.groupBy("doc", "rejection_reason").agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rejection_reason", "n")))).alias("rejection_reasons"))
    metrics = metrics.na.fill(0).join(reasons, "doc", "left").withColumn("avg_triples_per_sentence", F.when(F.col("num_sentences_used") > 0, F.round(F.col("num_raw_triples") / F.col("num_sentences_used"), 2)).otherwise(0.0))
    return Run(chunks, rejected, by_page, metrics)


def chosen(wanted: list[str], combine: bool) -> list[str]:
    """The stages of a run: all that are wanted, or only the first by priority."""
    unknown = [w for w in wanted if w not in PRIORITY]
    if unknown:
        raise ValueError(f"unknown stages: {unknown}")
    return wanted if combine else [p for p in PRIORITY if p in wanted][:1]


def page_texts(items: DataFrame) -> DataFrame:
    """items(doc, page, place, layer, text) -> the body text of each page, items in order, each behind a space; items without a page are left out."""
    body = items.where("page is not null and (layer is null or layer = 'body')")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim("text").alias("text")))), lambda x: F.concat(F.lit(" "), x["text"]))
    return body.groupBy("doc", "page").agg(F.array_join(ordered, "").alias("text"))


def annotated_samples(annotations: DataFrame) -> DataFrame:
    """annotations(doc, actor, seq, context, techniques array, tool) -> a sample per document: its text, distinct techniques and tools, and gold
    triples in lower case: each tool executes each technique, or without tools the actor uses them."""
    g = annotations.groupBy("doc").agg(
        F.first("actor", ignorenulls=True).alias("actor"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("seq", "context")))), lambda x: x["context"]), " ").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("techniques", F.array().cast("array<string>")))))).alias("techniques"), F.array_sort(F.collect_set(F.when(F.col("tool") != "", F.col("tool")))).alias("tools"),
    )
    who = F.when(F.size("tools") > 0, F.col("tools")).when(F.coalesce("actor", F.lit("")) != "", F.array("actor")).otherwise(F.array().cast("array<string>"))
    verb = F.when(F.size("tools") > 0, "executes").otherwise("uses")
    gold = F.flatten(F.transform(who, lambda s: F.transform("techniques", lambda t: F.struct(F.lower(s).alias("subject"), verb.alias("predicate"), F.lower(t).alias("object")))))
    return g.withColumn("gold", gold)


def annotation_ids(annotations: DataFrame) -> DataFrame:
    """annotations(doc, technique, sub_technique, tactics array, tools array) -> distinct (doc, kind, id), trimmed and upper-cased, blanks left out."""
    none = F.array().cast("array<string>")
    tagged = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), F.upper(F.trim(x)).alias("id")))
    every = F.concat(tagged(F.array("technique", "sub_technique"), "technique"), tagged(F.coalesce("tactics", none), "tactic"), tagged(F.coalesce("tools", none), "software"))
    return annotations.select("doc", F.explode(every).alias("x")).select("doc", "x.kind", "x.id").where("id <> ''").distinct()


def ids_in_text(text: Column) -> Column:
    """Distinct technique, tactic and software ids in a text, upper-cased and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"\b(?:TA\d{4}|T\d{4}(?:\.\d{3})?|S\d{4})\b"), F.lit(0))))
