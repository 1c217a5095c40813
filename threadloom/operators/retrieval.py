"""Lexical retrieval over inverted indices: BM25 and TF-IDF cosine. Documents: (doc, text); queries: (query, text).

Both are joins of query terms with postings, so a pair costs only where it shares a term, and all corpus statistics are
aggregates. Terms travel as 64-bit hashes. Texts are dealt by document once; counting terms, scoring and summing by document need no
further shuffle of postings: document frequencies are counted map-side, and the vocabulary's weights go to the postings by broadcast if it is
small enough, which is counted, so a word of most documents is no hot key. The best k of a query are found in every task before they
meet (Spark's group limit below the window). Ties go to the smaller document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms whose weights are broadcast, 16 bytes each.
MOST_TERMS = 2_000_000


def _counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    # by number: texts are small beside the terms and sums made from them, so partitions must not be merged by the size of texts
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, "text").repartition(parts, key).select(key, F.explode(terms).alias("word"))
    return rows.groupBy(key, F.xxhash64("word").alias("term")).agg(F.count("*").cast("double").alias("tf"))


def _sent(weights: DataFrame, own: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """Query weights for the join with postings: broadcast if the query terms they come from are few enough, which are counted first. Postings
    then stay where their document is, and so do the sums; a frequent term is no hot key. Otherwise Spark shuffles both."""
    return F.broadcast(weights) if own.limit(most_rows + 1).count() <= most_rows else weights


def _top(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def words(text: Column) -> Column:
    """Lower-cased, split at white space."""
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """Okapi BM25 top k: (query, doc, score, rank). A negative idf is floored at epsilon times the mean idf of the vocabulary; a
    term counts as often as the query has it."""
    tf = _counts(docs, "doc", words(F.col("text"))).withColumn("dl", F.sum("tf").over(Window.partitionBy("doc")))
    corpus = docs.agg(F.count("*").cast("double").alias("n"), F.sum(F.size(words(F.col("text")))).alias("total"))  # one row
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(corpus))
    raw = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean"))
    own = _counts(queries, "query", words(F.col("text"))).withColumnRenamed("tf", "qtf")
    weights = own.join(raw, "term").join(F.broadcast(mean)).withColumn("w", F.col("qtf") * F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")))
    hits = tf.join(_sent(weights.select("query", "term", "w", (F.col("total") / F.col("n")).alias("avgdl")), own), "term")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _top(hits.groupBy("query", "doc").agg(F.sum(part).alias("score")), k)


def grams(text: Column) -> Column:
    """Tokens of two or more letters or digits, and pairs of neighbours."""
    one = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    two = F.filter(F.zip_with(one, F.slice(one, 2, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.concat(one, two)


def tfidf_cosine(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Top k by cosine of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) vectors over the documents' vocabulary: (query, doc, score, rank)."""
    tf, own = _counts(docs, "doc", grams(F.col("text"))), _counts(queries, "query", grams(F.col("text")))
    n = docs.agg(F.count("*").cast("double").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = written(idf, "idf")
    weighted = tf.join(_sent(idf, idf, MOST_TERMS), "term")
    w = (1 + F.log("tf")) * F.col("idf")
    length = lambda t, key, name: t.groupBy(key).agg(F.sqrt(F.sum(w * w)).alias(name))
    known = own.join(idf, "term")
    qw = known.select("query", "term", (w * F.col("idf")).alias("qw"))  # with the idf of the document's side
    dots = tf.join(_sent(qw, own), "term").groupBy("query", "doc").agg(F.sum((1 + F.log("tf")) * F.col("qw")).alias("dot"))
    scored = dots.join(length(weighted, "doc", "dl"), "doc").join(length(known, "query", "ql"), "query")
    return _top(scored.select("query", "doc", (F.col("dot") / (F.col("dl") * F.col("ql"))).alias("score")), k)
