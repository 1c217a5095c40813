"""Evaluation queries. Events serve as a ranking log: user is the query, event the item, value the score, a purchase is gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import confusion, curves, explain, ranking
from threadloom.session import table

THRESHOLDS = [10.0, 20.0, 40.0, 60.0, 80.0]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"), "event_type", "ts")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def query_group(spark, sf_dir):
    """Rows by query: first-seen type, counts, the gold set's digest."""
    p = _pairs(spark, sf_dir)
    return p.groupBy("query").agg(
        F.min_by("event_type", "item").alias("first_type"), F.count("*").alias("n"), F.sum("label").cast("long").alias("n_gold"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.col("item")))), lambda x: x.cast("string")), ",")).alias("gold_md5"),
    )


def rank_metrics_ndcg(spark, sf_dir):
    return _rounded(ranking.metrics(_pairs(spark, sf_dir), 5), "mrr", "recall", "ndcg")


def threshold_sweep(spark, sf_dir):
    return _rounded(ranking.threshold_sweep(_pairs(spark, sf_dir), THRESHOLDS), "precision", "recall", "f1")


def multilabel_prf(spark, sf_dir):
    """Sets of event types: those of a user's five best events against those of purchases and errors."""
    r = ranking.ranked(_pairs(spark, sf_dir))
    sets = r.groupBy("query").agg(F.array_distinct(F.collect_list(F.when(F.col("rank") <= 5, F.col("event_type")))).alias("p"), F.array_distinct(F.collect_list(F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")))).alias("g"))
    precision, recall, f1 = ranking.sets_prf(F.col("p"), F.col("g"))
    return _rounded(sets.select("query", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")), "precision", "recall", "f1")


def confusion_mcc(spark, sf_dir):
    """Length over 1000 characters as a guess at quality, by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("score"))
    pairs = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    out = confusion.statistics(confusion.counts(pairs, ["source"], 1000))
    return _rounded(out, "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc")


def roc_curve(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("score", F.round("score", 0))
    return _rounded(curves.roc(p), "fpr", "tpr")


def auroc_auprc(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return _rounded(curves.auroc(p).join(F.broadcast(curves.auprc(p))), "auroc", "auprc")


def op_points(spark, sf_dir):
    return _rounded(curves.operating_points(_pairs(spark, sf_dir), [0.01, 0.05, 0.1, 0.5, 0.95]), "value")


def brier_ece(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("p", 1.0 / (1.0 + F.exp(-(F.col("score") - 50.0) / 20.0)))
    return _rounded(curves.brier(p).join(F.broadcast(curves.ece(p))), "brier", "ece")


def coverage_at_k(spark, sf_dir):
    """Event types found among a user's k best events, against those of every seventh event: matched, missed, spurious and coverage."""
    r = ranking.ranked(_pairs(spark, sf_dir))
    per = r.groupBy("query").agg(
        *[F.array_distinct(F.collect_list(F.when(F.col("rank") <= k, F.col("event_type")))).alias(f"f{k}") for k in (1, 3, 5)],
        F.array_distinct(F.collect_list(F.when(F.col("item") % 7 == 0, F.col("event_type")))).alias("g"),
    )
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("f"), F.col("g")) for k in (1, 3, 5)])).alias("x")).select("x.*")
    size = lambda a: F.sum(F.size(a)).cast("long")
    both, missed, extra = F.array_intersect("f", "g"), F.array_except("g", "f"), F.array_except("f", "g")
    out = rows.groupBy("k").agg(size(both).alias("matched"), size(missed).alias("missed"), size(extra).alias("spurious"))
    return out.withColumn("coverage", F.round(F.col("matched") / (F.col("matched") + F.col("missed")), 6))


def macro_micro_grouping(spark, sf_dir):
    """Mean score and gold share over everything, by type and by tenth of users, in one pass of grouping sets."""
    p = _pairs(spark, sf_dir).withColumn("bucket", F.col("query") % 10)
    p.createOrReplaceTempView("threadloom_pairs")
    return spark.sql("""SELECT event_type, bucket, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS gold_share
        FROM threadloom_pairs GROUP BY GROUPING SETS ((), (event_type), (bucket))""")


def score_histogram(spark, sf_dir):
    """Twenty equal bins of the score between its extremes."""
    p = _pairs(spark, sf_dir).select("score")
    ends = p.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    b = F.least(F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19))
    return p.join(F.broadcast(ends)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def margin_tiers(spark, sf_dir):
    """Best against second-best score by query, in tiers."""
    r = ranking.ranked(_pairs(spark, sf_dir))
    m = r.groupBy("query").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))
    return m.groupBy(explain.tier(F.coalesce("margin", F.lit(0.0))).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"))


def hard_negatives(spark, sf_dir):
    """Non-gold items that score at least the least gold one and within ten of the best gold one, and their confusion with types."""
    p = _pairs(spark, sf_dir)
    gold = p.where("label = 1").groupBy("query").agg(F.greatest(F.min("score"), F.max("score") - 10).alias("least"))
    return p.where("label = 0").join(gold, "query").where("score >= least").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score") - F.col("least")), 6).alias("mean_gap"))


_P = "WITH p AS (SELECT user_id AS query, event_id AS item, value AS score, (event_type = 'purchase')::INT AS label, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM p)"
_SWEEP = ", ".join(str(t) for t in THRESHOLDS)
_PRF = "CASE WHEN np > 0 THEN hit / np WHEN ng = 0 THEN 1 ELSE 0 END AS a, CASE WHEN ng > 0 THEN hit / ng WHEN np = 0 THEN 1 ELSE 0 END AS b"
_ROC = """, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score),
    c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g),
    pts AS (SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT fp / nn, tp / np FROM c)"""


def _bracket(x: str, y: str, name: str) -> str:
    return f"""SELECT '{name}' AS kind, t AS target, round(CASE WHEN hi IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (t - lo.x) / (hi.x - lo.x) END, 6) AS value FROM (
        SELECT t, (SELECT max({{'x': {x}, 'y': {y}}}) FROM pts WHERE {x} <= t) AS lo, (SELECT min({{'x': {x}, 'y': {y}}}) FROM pts WHERE {x} > t) AS hi FROM (SELECT unnest([0.01, 0.05, 0.1, 0.5, 0.95])::DOUBLE AS t))"""


QUERIES = {f.__name__: f for f in (query_group, rank_metrics_ndcg, threshold_sweep, multilabel_prf, confusion_mcc, roc_curve, auroc_auprc, op_points, brier_ece, coverage_at_k, macro_micro_grouping, score_histogram, margin_tiers, hard_negatives)}
ORACLE = {
    "query_group": _P + " SELECT query, arg_min(event_type, item) AS first_type, count(*) AS n, sum(label)::BIGINT AS n_gold, md5(coalesce(string_agg(item::VARCHAR, ',' ORDER BY item) FILTER (label = 1), '')) AS gold_md5 FROM p GROUP BY query",
    "rank_metrics_ndcg": _P + """ , q AS (SELECT query, count(*) AS n, sum(label)::BIGINT AS n_pos, max(CASE WHEN rank = 1 THEN label END)::DOUBLE AS p_at_1, min(CASE WHEN label = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 5 THEN label ELSE 0 END) AS found, sum(CASE WHEN label = 1 AND rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM r GROUP BY query)
        SELECT query, n, n_pos, p_at_1, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END AS hit, round(CASE WHEN n_pos > 0 THEN 1.0::DOUBLE / first END, 6) AS mrr, round(CASE WHEN n_pos > 0 THEN found / n_pos END, 6) AS recall,
        round(CASE WHEN n_pos > 0 THEN dcg / list_sum(list_transform(range(1, least(n_pos, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END, 6) AS ndcg FROM q""",
    "threshold_sweep": _P + f""", s AS (SELECT query, t AS threshold, sum((score >= t OR rank = 1)::INT) AS np, sum(label) AS ng, sum(CASE WHEN score >= t OR rank = 1 THEN label ELSE 0 END) AS hit FROM r, (SELECT unnest([{_SWEEP}])::DOUBLE AS t) GROUP BY ALL), m AS (SELECT threshold, {_PRF} FROM s)
        SELECT threshold, count(*) AS n_queries, round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END), 6) AS f1 FROM m GROUP BY threshold""",
    "multilabel_prf": _P + f""", s AS (SELECT query, count(DISTINCT CASE WHEN rank <= 5 THEN event_type END) AS np, count(DISTINCT CASE WHEN event_type IN ('purchase', 'error') THEN event_type END) AS ng,
        len(list_intersect(coalesce(list(DISTINCT event_type) FILTER (rank <= 5), []), coalesce(list(DISTINCT event_type) FILTER (event_type IN ('purchase', 'error')), []))) AS hit FROM r GROUP BY query), m AS (SELECT query, {_PRF} FROM s)
        SELECT query, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS f1 FROM m""",
    "confusion_mcc": """WITH c AS (SELECT source, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1000 AND quality <> 1) AS tn, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source),
        s AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp FROM c)
        SELECT source, tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(rc, 6) AS recall, round(sp, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((rc + sp) / 2, 6) AS balanced_accuracy,
        round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM s""",
    "roc_curve": _P.replace("value AS score", "round(value, 0) AS score") + _ROC + " SELECT score AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM c",
    "auroc_auprc": _P + _ROC + ", o AS (SELECT label, row_number() OVER (ORDER BY score DESC, item) AS k, sum(label) OVER (ORDER BY score DESC, item) AS t FROM p) SELECT round((SELECT sum(neg * (tp - pos + pos / 2.0)) / (max(np) * max(nn)) FROM c), 6) AS auroc, round((SELECT sum(t / k) / count(*) FROM o WHERE label = 1), 6) AS auprc",
    "op_points": _P + _ROC + " " + _bracket("fpr", "tpr", "tpr_at_fpr") + " UNION ALL " + _bracket("tpr", "fpr", "fpr_at_tpr"),
    "brier_ece": """WITH p AS (SELECT event_id, (event_type = 'purchase')::INT AS y, 1.0::DOUBLE / (1 + exp(-(value - 50) / 20)) AS p FROM events), o AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS k, count(*) OVER () AS n FROM p),
        b AS (SELECT len(list_filter(range(1, 11), lambda i: (n * i) // 10 < k)) AS bin, p, y FROM o), e AS (SELECT count(*) AS n, avg(p) AS c, avg(y) AS a FROM b GROUP BY bin)
        SELECT round((SELECT avg((p - y) * (p - y)) FROM p), 6) AS brier, round((SELECT sum(n * abs(c - a)) / sum(n) FROM e), 6) AS ece""",
    "coverage_at_k": _P + """, s AS (SELECT query, k, coalesce(list(DISTINCT event_type) FILTER (rank <= k), []) AS f, coalesce(list(DISTINCT event_type) FILTER (item % 7 = 0), []) AS g FROM r, (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL),
        c AS (SELECT k, sum(len(list_intersect(f, g)))::BIGINT AS matched, sum(len(g) - len(list_intersect(f, g)))::BIGINT AS missed, sum(len(f) - len(list_intersect(f, g)))::BIGINT AS spurious FROM s GROUP BY k)
        SELECT *, round(matched / (matched + missed), 6) AS coverage FROM c""",
    "macro_micro_grouping": "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean_score, round(avg((event_type = 'purchase')::INT), 6) AS gold_share FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id % 10))",
    "score_histogram": "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM events, e GROUP BY 1",
    "margin_tiers": _P + ", m AS (SELECT query, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM r GROUP BY query) SELECT CASE WHEN margin >= 0.3 THEN 'HIGH' WHEN margin >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n, round(avg(margin), 6) AS mean_margin FROM m GROUP BY 1",
    "hard_negatives": _P + ", g AS (SELECT query, greatest(min(score), max(score) - 10) AS least FROM p WHERE label = 1 GROUP BY query) SELECT event_type, count(*) AS n, round(avg(score - least), 6) AS mean_gap FROM p JOIN g USING (query) WHERE label = 0 AND score >= least GROUP BY event_type",
}
