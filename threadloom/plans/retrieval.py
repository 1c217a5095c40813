"""Retrieval queries: benchmark items against documents; turns of a conversation against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import retrieval
from threadloom.session import table

K = 10


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def bm25_topk(spark, sf_dir):
    top = retrieval.bm25(*_sides(spark, sf_dir), K)
    return top.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def tfidf_cosine_topk(spark, sf_dir):
    top = retrieval.tfidf_cosine(*_sides(spark, sf_dir), 3)
    return top.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_recall_at_k(spark, sf_dir):
    """Share of items whose ten best documents hold the item's text."""
    q, d = _sides(spark, sf_dir)
    top = retrieval.bm25(q, d, K).select("query", "doc")
    hit = top.join(d.withColumnRenamed("text", "body"), "doc").join(q, "query").groupBy("query").agg(F.max(F.col("body").contains(F.col("text")).cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("recall"))


def hash_scorer_rank(spark, sf_dir):
    """Turns of a conversation ranked for its first turn by the deterministic scorer."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.min("turn").alias("t0"))
    rows = c.join(first, "conv_id").where("turn > t0").withColumn("score", X.hash_score(F.col("q"), F.col("text")))
    by = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    return rows.select("conv_id", "turn", F.round("score", 9).alias("score"), F.row_number().over(by).cast("long").alias("rank"))


def loo_token_deltas(spark, sf_dir):
    """What the scorer loses when a word of an item is left out, against the item of the same text with a fixed candidate."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    rows = b.select("item_id", "text", "w", F.posexplode("w").alias("k", "token"))
    left = F.array_join(F.filter("w", lambda x, i: i != F.col("k")), " ")
    base, without = X.hash_score(F.col("text"), F.lit("candidate")), X.hash_score(left, F.lit("candidate"))
    return rows.select("item_id", F.col("k").cast("long").alias("k"), "token", F.round(base - without, 9).alias("delta"))


_SCORE = "('0x' || substr(sha256({} || chr(0) || {}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
_BM = r"""WITH dt AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\s+'), lambda w: w <> '')) AS term FROM documents),
    qt AS (SELECT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\s+'), lambda w: w <> '')) AS term FROM benchmark),
    tf AS (SELECT doc, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc, sum(tf) AS dl FROM tf GROUP BY doc), c AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl) AS total),
    i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, c GROUP BY term, n), m AS (SELECT avg(idf) AS mean FROM i),
    w AS (SELECT query, term, count(*) * any_value(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END) AS w FROM qt JOIN i USING (term), m GROUP BY ALL),
    s AS (SELECT query, doc, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS score FROM tf JOIN w USING (term) JOIN dl USING (doc), c GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s QUALIFY rank <= 10)"""
_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"

QUERIES = {f.__name__: f for f in (bm25_topk, tfidf_cosine_topk, bm25_recall_at_k, hash_scorer_rank, loo_token_deltas)}
ORACLE = {
    "bm25_topk": _BM + " SELECT query, doc, round(score, 6) AS score, rank FROM t",
    "bm25_recall_at_k": _BM + ", h AS (SELECT query, max(contains(d.text, b.text)::INT) AS hit FROM t JOIN documents d ON t.doc = d.doc_id JOIN benchmark b ON t.query = b.item_id GROUP BY query) SELECT count(*) AS n_queries, round(avg(hit), 6) AS recall FROM h",
    "tfidf_cosine_topk": f"""WITH dt AS (SELECT doc_id AS doc, unnest({_GRAMS}) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS t FROM documents)),
        qt AS (SELECT item_id AS query, unnest({_GRAMS}) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS t FROM benchmark)),
        tf AS (SELECT doc, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL), qf AS (SELECT query, term, count(*)::DOUBLE AS tf FROM qt GROUP BY ALL), i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY term),
        dw AS (SELECT doc, term, (1 + ln(tf)) * idf AS dw FROM tf JOIN i USING (term)), qw AS (SELECT query, term, (1 + ln(tf)) * idf AS qw FROM qf JOIN i USING (term)),
        dl AS (SELECT doc, sqrt(sum(dw * dw)) AS dl FROM dw GROUP BY doc), ql AS (SELECT query, sqrt(sum(qw * qw)) AS ql FROM qw GROUP BY query),
        s AS (SELECT query, doc, sum(dw * qw) / any_value(dl * ql) AS score FROM dw JOIN qw USING (term) JOIN dl USING (doc) JOIN ql USING (query) GROUP BY ALL)
        SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s QUALIFY rank <= 3""",
    "hash_scorer_rank": f"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS q, min(turn) AS t0 FROM conversations GROUP BY conv_id), s AS (SELECT c.conv_id, turn, {_SCORE.format('q', 'c.text')} AS score FROM conversations c JOIN f USING (conv_id) WHERE turn > t0)
        SELECT conv_id, turn, round(score, 9) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s""",
    "loo_token_deltas": f"""WITH b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), r AS (SELECT item_id, text, w, unnest(range(len(w))) AS k FROM b),
        s AS (SELECT *, list_aggregate(list_filter(w, lambda x, i: i <> k + 1), 'string_agg', ' ') AS l FROM r)
        SELECT item_id, k, w[k + 1] AS token, round({_SCORE.format('text', "'candidate'")} - {_SCORE.format("coalesce(l, '')", "'candidate'")}, 9) AS delta FROM s""",
}
