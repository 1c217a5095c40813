"""Repair of rejected triples: cleanup, sentence smoothing, a gate, a model's proposals, propagation, and the append of what is new.

A rejected triple has id (a whole number, in order), context (text, may be null), s_name, s_type, predicate, o_name, o_type, and may have confidence and quote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import lookup, sentences
from threadloom.operators import extraction, propagate, triples
from threadloom.session import written

# ---- fixed values: loose aliases, codes that a model may mend and codes that end a triple, confidences for propagation ----
LOOSE_TYPES = {
    "threatactor": "threat-actor", "intrusionset": "intrusion-set", "attackpattern": "attack-pattern", "courseofaction": "course-of-action", "domain": "domain-name",
    "domainname": "domain-name", "ipv4": "ipv4-addr", "ipv4addr": "ipv4-addr", "ipv6": "ipv6-addr", "ipv6addr": "ipv6-addr", "email": "email-addr",
    "emailaddress": "email-addr", "organisation": "organization", "useraccount": "user-account", "autonomoussystem": "autonomous-system",
    "observeddata": "observed-data", "malwareanalysis": "malware-analysis",
}
LOOSE_PREDICATES = {
    "communicateswith": "communicates_with", "usestechnique": "uses_technique", "subtechniqueof": "subtechnique_of", "revokedby": "revoked_by", "duplicateof": "duplicate_of",
    "originatesfrom": "originates_from", "resolvesto": "resolves_to", "downloadsfrom": "downloads_from", "writesto": "writes_to", "readsfrom": "reads_from", "emailsto": "emails_to",
    "observedon": "observed_on", "analysisof": "analysis_of", "characterizes": "characterizes", "sightingof": "sighting_of", "sightedat": "sighted_at", "sightedby": "sighted_by",
    "basedon": "based_on", "derivedfrom": "derived_from", "locatedat": "located_at",
}
FATAL = ["predicate_invalid", "subject_not_object", "object_not_object"]
FIXABLE = ["subject.name_bad", "object.name_bad", "subject.type_not_allowed", "object.type_not_allowed", "subject.type_domain", "object.type_domain", "subject.type_range", "object.type_range"]
LOOSE_FIXABLE = ["subject_empty", "object_empty", "surface_form_error", "minor_text_error", "unrecognized_entity_name", "subject.name_invalid", "object.name_invalid"]
LOOSE_FATAL = ["predicate_invalid", "subject.type_not_allowed", "object.type_not_allowed", "subject.type_domain", "object.type_domain", "subject.type_range", "object.type_range"]
NO_NAMES = ["UNKNOWN", "?", "N/A", "??"]
GENERIC = ["org", "tactic", "other"]
REPAIRED_NODE, REPAIRED_EDGE, REJECTED = 0.9, 0.85, 0.4
# ---- end of fixed values ----

PARTS = ["s_name", "s_type", "predicate", "o_name", "o_type"]


def strict_predicate(x: Column) -> Column:
    """Canonical if that is a known predicate, else as given."""
    p = triples.canonical_predicate(x)
    return F.when(p.isin(*triples.PREDICATES), p).otherwise(x)


def loose_type(x: Column) -> Column:
    """Letters, digits and hyphens, one space; known types stay, others go by an alias without spaces and hyphens."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9\- ]", ""), r"\s+", " "))
    return F.when(raw.isin(*triples.TYPES), raw).otherwise(lookup(F.translate(raw, " -", ""), LOOSE_TYPES, raw))


def loose_predicate(x: Column) -> Column:
    """Known ones stay; others go by an alias of their letters, or by splitting capitals with underscores."""
    letters = F.lower(F.regexp_replace(x, "[^A-Za-z]", ""))
    snake = F.trim(F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2")))
    alias = lookup(letters, LOOSE_PREDICATES, F.lit(None).cast("string"))
    return F.when(x.isin(*triples.PREDICATES), x).when(alias.isNotNull(), alias).when(snake.isin(*triples.PREDICATES), snake).otherwise(x)


def cleaned(rows: DataFrame, kind: Callable[[Column], Column] = triples.canonical_type, predicate: Callable[[Column], Column] = strict_predicate) -> DataFrame:
    """Trimmed names, UNKNOWN for blank ones (nulls stay), canonical types and predicate."""
    name = lambda c: F.when(F.trim(c) == "", "UNKNOWN").otherwise(F.trim(c))
    return rows.withColumns({"s_name": name("s_name"), "o_name": name("o_name"), "s_type": kind(F.col("s_type")), "o_type": kind(F.col("o_type")), "predicate": predicate(F.trim("predicate"))})


def loose_errors(s_name: Column, s_type: Column, predicate: Column, o_name: Column, o_type: Column) -> Column:
    """Codes of the looser check: schema first, then empty and placeholder names, names of mostly symbols, and near misses of predicates."""
    p, st, ot = loose_predicate(predicate), loose_type(s_type), loose_type(o_type)
    schema = F.filter(triples.errors(F.lit("x"), st, p, F.lit("x"), ot), lambda c: ~c.endswith("name_bad"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    noisy = lambda x: F.coalesce(F.length(F.regexp_replace(x, r"[\p{L}\p{N}]", "")) > F.length(x) * 0.5, F.lit(False))
    near = F.exists(F.array(*[F.lit(x) for x in triples.PREDICATES]), lambda q: (F.abs(F.length(q) - F.length(p)) <= 2) & q.startswith(F.substring(p, 1, 3)))
    missed = ~F.coalesce(p.isin(*triples.PREDICATES), F.lit(False)) & F.coalesce(near, F.lit(False))
    codes = []
    for side, x in (("subject", s_name), ("object", o_name)):
        codes.append(F.when(blank(x), f"{side}_empty").when(F.trim(x).isin(*NO_NAMES), f"{side}.name_invalid"))
    codes += [F.when(noisy(s_name), "surface_form_error"), F.when(noisy(o_name), "surface_form_error"), F.when(missed, "minor_text_error")]
    return F.concat(schema, F.filter(F.array(*codes), lambda c: c.isNotNull()))


def sentence_labels(rejected: DataFrame) -> DataFrame:
    """(context_id, labels): the sentences of each context in order, with the smoothed kind of the names that stand in them."""
    keyed = rejected.where("context is not null").withColumn("context_id", F.sha2("context", 256))
    contexts = keyed.groupBy("context_id").agg(F.first("context").alias("text"))
    order = F.row_number().over(Window.partitionBy("context_id").orderBy("id"))
    sides = F.array(F.struct(F.col("s_name").alias("name"), F.col("s_type").alias("kind"), (2 * order).alias("seq")), F.struct(F.col("o_name").alias("name"), F.col("o_type").alias("kind"), (2 * order + 1).alias("seq")))
    mentions = keyed.withColumn("sides", sides).select("context_id", F.explode("sides").alias("m")).select("context_id", "m.*")
    smooth = triples.smoothed(triples.majority_labels(mentions, contexts), "context_id", "k")
    split = contexts.select("context_id", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    joined = split.join(smooth.select("context_id", "k", "smooth"), ["context_id", "k"])
    return joined.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("k", "sentence", "smooth"))).alias("labels"))


def relabelled(rows: DataFrame) -> DataFrame:
    """rows with ``labels``: an unknown or generic type takes the label of the first sentence that holds its name, if that is a known type."""

    def side(tag: str) -> Column:
        name, kind = F.col(f"{tag}_name"), triples.canonical_type(F.col(f"{tag}_type"))
        first = F.get(F.filter("labels", lambda x: x["sentence"].contains(name)), 0)["smooth"]
        loose = ~F.coalesce(kind.isin(*triples.TYPES), F.lit(False)) | F.coalesce(kind.isin(*GENERIC), F.lit(False))
        return F.when((name != "") & loose & first.isin(*triples.TYPES), first).otherwise(F.col(f"{tag}_type"))

    return rows.withColumns({"s_type": side("s"), "o_type": side("o")})


def cascade(rejected: DataFrame, propose: Callable[[], Callable] | None = None, prompt: Column | None = None, folder: str | None = None) -> DataFrame:
    """Each rejected triple with its ``repair``: deterministic, markov_smooth, model, or bad with the codes that are left in ``reasons``; then,
    with a null id, triples that propagation adds (szf_propagated).

    ``propose`` loads a model, a function of a list of prompts that gives replies; only triples that the gate lets through are sent to it, and
    the first proposal that is valid after cleanup is taken.
    """
    key = F.when(F.col("context").isNotNull(), F.sha2("context", 256)).alias("context_id")
    kept = ["id", "context", *PARTS]
    first = written(triples.validated(cleaned(rejected).select(*kept, key)), "repair", folder)
    done = first.where(F.size("errors") == 0).select(*kept, F.lit("deterministic").alias("repair"), "errors")
    left = first.where(F.size("errors") > 0).drop("errors").join(sentence_labels(rejected), "context_id", "left")
    second = written(triples.validated(relabelled(left)).select(*kept, "errors"), "repair", folder)
    smooth = second.where(F.size("errors") == 0).select(*kept, F.lit("markov_smooth").alias("repair"), "errors")
    rest = second.where(F.size("errors") > 0)
    mended = smooth.limit(0)
    if propose is not None:
        asked = rest.where(triples.worth_repair(F.col("errors"), FATAL, FIXABLE)).withColumn("prompt", prompt if prompt is not None else repair_prompt())
        replies = extraction.scored(asked.select("id", "context", "prompt"), ["prompt"], "string", propose, "reply")
        offered = replies.select("id", "context", F.posexplode(extraction.parsed_triples(F.col("reply"))).alias("k", "t")).select("id", "context", "k", "t.s_name", "t.s_type", "t.predicate", "t.o_name", "t.o_type")
        fine = triples.validated(cleaned(offered)).where(F.size("errors") == 0)
        mended = written(fine.groupBy("id").agg(F.min_by(F.struct(*kept[1:], "errors"), "k").alias("m")).select("id", "m.*").select(*kept, F.lit("model").alias("repair"), "errors"), "repair", folder)
        rest = rest.join(mended.select("id"), "id", "left_anti")
    out = written(done.union(smooth).union(mended).union(rest.select(*kept, F.lit("bad").alias("repair"), "errors")), "repair", folder)
    return out.union(propagated(out, folder).select(F.lit(None).cast(out.schema["id"].dataType), F.lit(None).cast("string"), *PARTS, F.lit("szf_propagated"), F.array().cast("array<string>"))).withColumnRenamed("errors", "reasons")


def propagated(repaired: DataFrame, folder: str | None = None) -> DataFrame:
    """Valid triples that propagation over repaired and bad ones gives and no repaired triple has."""
    bad, edge = F.col("repair") == "bad", F.when(F.col("repair") == "bad", REJECTED)
    rows = repaired.withColumn("seq", F.col("id") + F.when(bad, F.lit(1 << 40)).otherwise(0)).withColumns({
        "s_confidence": edge.otherwise(REPAIRED_NODE), "o_confidence": edge.otherwise(REPAIRED_NODE), "confidence": edge.otherwise(REPAIRED_EDGE),
        "source": propagate.node_label(F.col("s_name"), F.col("s_type")), "target": propagate.node_label(F.col("o_name"), F.col("o_type")),
    })
    nodes, edges = propagate.run(rows.where("source <> '' and target <> ''"), folder=folder)
    seen = rows.where(~bad).select("source", "predicate", "target").distinct()
    new = edges.join(seen, ["source", "predicate", "target"], "left_anti")
    named = lambda tag, end: nodes.select(F.col("node").alias(end), F.col("name").alias(f"{tag}_name"), F.col("type").alias(f"{tag}_type"))
    found = new.join(named("s", "source"), "source").join(named("o", "target"), "target")
    return triples.validated(found.select(*PARTS)).where(F.size("errors") == 0).select(*PARTS)


def repair_prompt() -> Column:
    """What a model is asked, from the columns of a triple and its context's first 800 characters."""
    listed = lambda xs: ", ".join(sorted(xs))
    told = F.to_json(F.struct(F.struct(F.col("s_name").alias("name"), F.col("s_type").alias("type")).alias("subject"), "predicate", F.struct(F.col("o_name").alias("name"), F.col("o_type").alias("type")).alias("object")))
    return F.concat(
        F.lit(f"Mend this triple. Types: {listed(triples.TYPES)}. Predicates: {listed(triples.PREDICATES)}. Stay within the context, invent no entities, answer with a JSON array of 3 to 5 triples "
              "(subject and object with name and type, predicate, confidence) and nothing else.\nContext: "),
        F.substring(F.coalesce("context", F.lit("")), 1, 800), F.lit("\nTriple: "), told,
    )


def append_new(valid: DataFrame, repaired: DataFrame) -> DataFrame:
    """valid and the distinct repaired triples that it lacks, compared null-safely by their parts."""
    same = F.struct(*[F.coalesce(c, F.lit("\x00")).alias(c) for c in PARTS])
    new = repaired.select(*PARTS).distinct().withColumn("_k", same).join(valid.select(same.alias("_k")).distinct(), "_k", "left_anti")
    return valid.select(*PARTS).union(new.select(*PARTS))


def reason_counts(rows: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent codes of bad triples, ties by name."""
    n = rows.where("repair = 'bad'").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "reason").limit(k)
