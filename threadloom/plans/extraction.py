"""Queries around extraction: replies, gold pairs, set scores, greedy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import extraction, extractor
from threadloom.plans.texts import _SENT
from threadloom.session import table
from threadloom.sources.config import Options


def reply_parsing(spark, sf_dir):
    """Triples of replies in several broken forms, made from customers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = F.concat(F.lit("{'subject': {'name': '"), "c_name", F.lit("', 'type': 'tool'}, predicate: 'uses', 'object': {'text': '"), "c_mktsegment", F.lit("'},}"))
    reply = F.when(k % 4 == 0, one).when(k % 4 == 1, F.concat(F.lit("```json\n["), one, F.lit(", "), one, F.lit(",]\n```"))).when(k % 4 == 2, F.concat(F.lit("Sure: {\"triples\": ["), one, F.lit("]}"))).otherwise(F.lit("I found none."))
    t = c.select("c_custkey", extraction.parsed_triples(reply).alias("t"))
    return t.select("c_custkey", F.size("t").cast("long").alias("n"), F.get("t", 0)["s_name"].alias("subject"), F.get("t", 0)["o_name"].alias("object"))


def pairs_within(spark, sf_dir):
    """Clicks and views of a user with each of their purchases' days."""
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", F.concat("event_type", F.lit(" "), F.date_format("ts", "dd")).alias("name"), F.col("event_type").alias("type"))
    return extraction.pair_within(rows, "user_id", ["click", "view"], "purchase", "related-to").groupBy("user_id").agg(F.count("*").alias("n"))


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value >= 20"), e.where("value < 60")


def triple_set_scores(spark, sf_dir):
    """Events of 20 and more as predicted, those under 60 as gold (type, day) pairs of users; every event is in one of them."""
    p, g = (x.select("user_id", "event_type", F.date_format("ts", "dd").alias("day")) for x in _sides(spark, sf_dir))
    out = extraction.set_scores(p, g, "user_id", ["event_type", "day"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "samples"})


def greedy_matching(spark, sf_dir):
    """Even turns of a conversation against its odd ones."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"), "text")
    return extraction.greedy_matches(c.where("k % 2 = 0"), c.where("k % 2 = 1"), "conv_id", 0.1)


def _answering():
    import json
    import re

    def reply(prompt: str) -> str:
        w = re.findall("[A-Za-z]+", prompt)
        if len(w) < 2:
            return "no triples"
        triple = {"subject": {"name": w[0], "type": ("malware", "widget", "tool")[len(w) % 3]}, "predicate": "uses" if len(w) % 4 else "befriends", "object": {"name": w[-1], "type": "tool"}}
        return json.dumps([triple])

    return lambda prompts: [reply(p) for p in prompts]


def _run(spark, sf_dir, passes: int):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return extractor.run(pages, _answering, Options(passes=passes, votes=min(2, passes)), lambda unit: ~unit.contains("###"), ["{text}", " {text}"])


def extraction_run(spark, sf_dir):
    """Sentences of all documents to a stand-in for a model, once: what the run reports per source."""
    m = _run(spark, sf_dir, 1).metrics
    names = ["num_pages", "num_sentences_total", "num_sentences_used", "num_raw_triples", "num_valid_triples", "num_invalid_triples"]
    return m.select("doc", *[F.col(n).cast("long").alias(n) for n in names], "avg_triples_per_sentence", F.coalesce(F.element_at("rejection_reasons", "subject_type_not_in_ontology"), F.lit(0)).alias("bad_types"))


def extraction_consensus(spark, sf_dir):
    """The same three times over, with a quorum of two: accepted triples per page's source."""
    return _run(spark, sf_dir, 3).chunks.groupBy("doc").agg(F.count("*").alias("units"), F.sum(F.size("triples")).cast("long").alias("triples"))


_TF = """WITH r AS (SELECT conv_id, 1 - turn % 2 AS side, turn AS k, text FROM conversations), w0 AS (SELECT conv_id, side, k, term, count(*) AS tf FROM (SELECT conv_id, side, k, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM r) GROUP BY ALL),
    n AS (SELECT conv_id, count(*) AS n, sum(side)::BIGINT AS predicted, sum(1 - side)::BIGINT AS gold FROM r GROUP BY 1), d AS (SELECT conv_id, term, count(*) AS df FROM w0 GROUP BY ALL), w AS (SELECT w0.*, tf * (ln((1 + n) / (1.0::DOUBLE + df)) + 1) AS w FROM w0 JOIN d USING (conv_id, term) JOIN n USING (conv_id)),
    u AS (SELECT conv_id, side, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, side, k)) AS u FROM w),
    c AS (SELECT a.conv_id, a.k AS pk, b.k AS gk, round(sum(a.u * b.u), 9) AS c FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.term = b.term AND a.side = 1 AND b.side = 0 GROUP BY ALL),
    b AS (SELECT conv_id, pk, min({'s': -c, 'g': gk}) AS b FROM c GROUP BY ALL), m AS (SELECT conv_id, count(DISTINCT b.g) AS matched FROM b WHERE -b.s >= 0.1 GROUP BY 1)
    SELECT n.conv_id, coalesce(matched, 0) AS matched, predicted, gold FROM n LEFT JOIN m USING (conv_id)"""
_DIV = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END"

_UNITS = rf"""WITH s AS (SELECT source AS doc, doc_id AS page, unnest({_SENT}) AS unit FROM documents), u AS (SELECT *, regexp_extract_all(unit, '[A-Za-z]+') AS w FROM s WHERE length(trim(unit, ' ')) >= 40 AND NOT contains(unit, '###')), t AS (SELECT *, len(w) % 3 <> 1 AS typed, len(w) % 4 <> 0 AS uses FROM u WHERE len(w) >= 2)"""

QUERIES = {f.__name__: f for f in (reply_parsing, pairs_within, triple_set_scores, greedy_matching, extraction_run, extraction_consensus)}
ORACLE = {
    "reply_parsing": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS subject, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment END AS object FROM customer",
    "pairs_within": "WITH e AS (SELECT DISTINCT user_id, event_type || ' ' || strftime(ts, '%d') AS name, event_type AS type FROM events) SELECT a.user_id, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.type IN ('click', 'view') AND b.type = 'purchase' GROUP BY 1",
    "triple_set_scores": f"""WITH e AS (SELECT user_id, event_type, strftime(ts, '%d') AS day, max((value >= 20)::INT) AS p, max((value < 60)::INT) AS g FROM events GROUP BY ALL), s AS (SELECT user_id, sum(p * g) AS h, sum(p) AS np, sum(g) AS ng FROM e GROUP BY 1)
        SELECT count(*) AS samples, round(avg({_DIV('h', 'np')}), 6) AS macro_precision, round(avg({_DIV('h', 'ng')}), 6) AS macro_recall, round(avg({_DIV('2 * h', 'np + ng')}), 6) AS macro_f1,
        round(sum(h) / sum(np), 6) AS micro_precision, round(sum(h) / sum(ng), 6) AS micro_recall, round(2 * sum(h) / (sum(np) + sum(ng)), 6) AS micro_f1 FROM s""",
    "greedy_matching": _TF,
    "extraction_run": _UNITS + """, n AS (SELECT source AS doc, count(DISTINCT doc_id) AS num_pages FROM documents GROUP BY 1), a AS (SELECT doc, count(*) AS total FROM s GROUP BY 1), b AS (SELECT doc, count(*) AS used FROM u GROUP BY 1), c AS (SELECT doc, count(*) AS raw, count(*) FILTER (typed AND uses) AS valid, count(*) FILTER (NOT (typed AND uses)) AS invalid, count(*) FILTER (uses AND NOT typed) AS bad FROM t GROUP BY 1)
        SELECT doc, num_pages, total AS num_sentences_total, coalesce(used, 0) AS num_sentences_used, coalesce(raw, 0) AS num_raw_triples, coalesce(valid, 0) AS num_valid_triples, coalesce(invalid, 0) AS num_invalid_triples, CASE WHEN used > 0 THEN round(raw / used, 2) ELSE 0 END AS avg_triples_per_sentence, coalesce(bad, 0) AS bad_types FROM n LEFT JOIN a USING (doc) LEFT JOIN b USING (doc) LEFT JOIN c USING (doc)""",
    "extraction_consensus": _UNITS + " SELECT doc, count(*) AS units, count(*) AS triples FROM t WHERE typed AND uses GROUP BY 1",
}
