"""Queries of triples and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.vectors import as_double
from threadloom.operators import chunking, triples
from threadloom.session import table

_S = ["threat actor", "malware", "Tool", "campaign", "domain", "widget"]
_O = ["attack-pattern", "vulnerability", "ipv4", "organization", "file", "country"]
_P = ["uses", "exploits", "resolves to", "targets", "drops", "attributed-to", "befriends"]


def _pick(values: list[str], k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _triples(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(k.alias("seq"), F.when(k % 17 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("s_name"), _pick(_S, k).alias("s_type"), _pick(_P, k).alias("predicate"), F.col("p_brand").alias("o_name"), _pick(_O, F.floor(k / 3)).alias("o_type"), F.col("p_type").alias("quote"))


def triple_validation(spark, sf_dir):
    """Error codes of triples made from parts, and whether a repair is worth trying."""
    v = triples.validated(_triples(spark, sf_dir))
    repair = triples.worth_repair(F.col("errors"), ["predicate_invalid"], ["subject.type_domain", "object.type_range"])
    return v.groupBy(F.array_join("errors", ",").alias("errors"), repair.alias("repair")).agg(F.count("*").alias("n"))


def triple_rejections(spark, sf_dir):
    """Histogram of error codes and the accounting of valid triples."""
    v = triples.validated(_triples(spark, sf_dir))
    code = F.explode(F.when(F.size("errors") == 0, F.array(F.lit("valid"))).otherwise(F.col("errors")))
    return v.select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def min_pairwise_cos(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", as_double(F.col("embedding")).alias("vec"))
    return chunking.min_pairwise_cosine(e, "label").select("label", F.round("min_cosine", 6).alias("min_cosine"))


def fuzzy_consensus(spark, sf_dir):
    """Votes of four passes over the turns of conversations; names differ by pass in case and a trailing letter."""
    c = table(spark, sf_dir, "conversations")
    v = c.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pass"), F.col("text").alias("name"), F.col("text").alias("quote"))
    v = v.select("conv_id", (F.col("turn") * 10 + F.col("pass")).alias("seq"), F.concat("name", F.when(F.col("pass") == 3, F.lit("s")).otherwise(F.lit(""))).alias("s_name"), F.lit("malware").alias("s_type"), F.lit("uses").alias("predicate"), F.upper("name").alias("o_name"), F.lit("tool").alias("o_type"), "quote")
    return triples.fuzzy_consensus(v, "conv_id")


def viterbi_smooth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "malware").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "error", "indicator").otherwise("other")
    rows = e.select("user_id", "event_id", kind.alias("kind"), (0.3 + (F.col("event_id") % 7) / 10.0).alias("confidence"))
    return triples.smoothed(rows, "user_id", "event_id")


def chunk_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("sentences"))
    return chunking.chunked_texts(d, "doc_id")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(values: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {x} END"


_DOM = " ".join(f"WHEN '{p}' THEN list_contains({_list(d)}, st)" for p, (d, _) in triples.DOMAIN_RANGE.items())
_RNG = " ".join(f"WHEN '{p}' THEN list_contains({_list(r)}, ot)" for p, (_, r) in triples.DOMAIN_RANGE.items())
_V = f"""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_name END AS sn, {_list(_S)}[p_partkey % 6 + 1] AS s, {_list(_P)}[p_partkey % 7 + 1] AS p, p_brand AS onm, {_list(_O)}[(p_partkey // 3) % 6 + 1] AS o FROM part),
    c AS (SELECT *, replace(replace(lower(trim(s)), ' ', ''), '_', '-') AS s0, replace(replace(lower(trim(o)), ' ', ''), '_', '-') AS o0, replace(lower(trim(p)), ' ', '_') AS p0 FROM r),
    d AS (SELECT *, {_case(triples.TYPE_ALIASES, 's0')} AS st, {_case(triples.TYPE_ALIASES, 'o0')} AS ot, {_case(triples.PREDICATE_ALIASES, 'p0')} AS pp FROM c),
    v AS (SELECT list_filter([CASE WHEN NOT list_contains({_list(triples.PREDICATES)}, pp) THEN 'predicate_invalid' END, CASE WHEN NOT list_contains({_list(triples.TYPES)}, st) THEN 'subject.type_not_allowed' END, CASE WHEN NOT list_contains({_list(triples.TYPES)}, ot) THEN 'object.type_not_allowed' END,
        CASE WHEN NOT (CASE pp {_DOM} ELSE true END) THEN 'subject.type_domain' END, CASE WHEN NOT (CASE pp {_RNG} ELSE true END) THEN 'object.type_range' END,
        CASE WHEN length(trim(sn)) = 0 OR length(trim(sn)) > 500 THEN 'subject.name_bad' END, CASE WHEN length(trim(onm)) = 0 OR length(trim(onm)) > 500 THEN 'object.name_bad' END], lambda x: x IS NOT NULL) AS e FROM d)"""

QUERIES = {f.__name__: f for f in (triple_validation, triple_rejections, min_pairwise_cos, fuzzy_consensus, viterbi_smooth, chunk_sentences)}
ORACLE = {
    "triple_validation": _V + " SELECT array_to_string(e, ',') AS errors, (list_contains(e, 'subject.type_domain') OR list_contains(e, 'object.type_range')) AND NOT list_contains(e, 'predicate_invalid') AS repair, count(*) AS n FROM v GROUP BY ALL",
    "triple_rejections": _V + " SELECT unnest(CASE WHEN len(e) = 0 THEN ['valid'] ELSE e END) AS code, count(*) AS n FROM v GROUP BY 1",
    "min_pairwise_cos": "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.label, round(coalesce(min(list_cosine_similarity(a.v, b.v)), 1), 6) AS min_cosine FROM v a LEFT JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label",
}
