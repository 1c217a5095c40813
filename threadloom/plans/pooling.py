"""Queries of ranked pools, curves by depth, per-report scores and the node store."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import inference, pools, records, store
from threadloom.functions.vectors import as_double
from threadloom.session import table


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


def _taxonomy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return e.select("id", (F.col("id") + 1).alias("parent")), e.select("id", (F.col("id") + 2).alias("tactic"))


def pool_verdicts(spark, sf_dir):
    """Verdict of every user's events as a pool; an event rolls up to the next one and belongs to the one after it."""
    v = pools.evaluate_pool(_pairs(spark, sf_dir), *_taxonomy(spark, sf_dir))
    return v.select("query", "pool_size", "gold_in_pool", "predicted", "correct", "correct_plus", "hit3", "hit5", F.col("gold_rank").cast("long").alias("gold_rank"), F.round("rr", 6).alias("rr"))


def pool_groups(spark, sf_dir):
    """Means of the verdicts by a function of the query."""
    v = pools.evaluate_pool(_pairs(spark, sf_dir), *_taxonomy(spark, sf_dir))
    return pools.aggregate(v, lambda t: F.concat(F.lit("g"), (F.col("query") % 5).cast("string")))


def _top(spark, sf_dir):
    top = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), F.concat(F.lit(" p"), (F.col("l_partkey") % 97).cast("string")).alias("item"))
    gold = table(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), (F.col("s_suppkey") * 3 % 101).cast("string")).alias("item"))
    return top, gold


def metrics_by_k(spark, sf_dir):
    """Order lines as ranked items against one set of gold ones, by depth."""
    out = pools.metrics_by_k(*_top(spark, sf_dir), [1, 3, 5])
    return out.select("k", "queries", *[F.round(c, 6).alias(c) for c in ("hit", "precision", "spurious", "recall")])


def report_leaderboard(spark, sf_dir):
    """The same, by ship mode of the order's flag as the report."""
    t = table(spark, sf_dir, "lineitem")
    top = t.select(F.col("l_returnflag").alias("report"), F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string")).alias("item"))
    gold = t.select(F.col("l_returnflag").alias("report"), F.concat(F.lit("P"), (F.col("l_suppkey") * 3 % 101).cast("string")).alias("item")).distinct()
    out = pools.leaderboard(top, gold, "report", [1, 5])
    return out.select("report", "k", "queries", *[F.round(c, 6).alias(c) for c in ("hit", "precision", "recall")])


def report_id_scores(spark, sf_dir):
    """Parts that a customer segment's orders name, against a rule's, as sets of ids."""
    o, c, l = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))  # noqa: E741
    found = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("report"), F.concat(F.lit("t"), F.floor(F.col("l_partkey") / 7).cast("string")).alias("id"))
    gold = table(spark, sf_dir, "part").select(F.explode(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")])).alias("report"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("id"))
    out = store.id_scores(found, gold, "report")
    return out.select("report", *[F.size(x).cast("long").alias(x) for x in ("matched", "missed", "spurious")], "precision", "recall", "f1")


def precision_recall_points(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("score", F.round("score", 0))
    return pools.precision_recall(p).where("threshold < 1e300").select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


def grouped_statistics(spark, sf_dir):
    """A user's own statistic per nation: the mean of account balances beyond 1000, as a plain function."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    out = pools.grouped_statistic(c, ["c_nationkey"], "c_acctbal", lambda v: (lambda x: sum(x) / len(x) if x else 0.0)([b for b in v if b > 1000]))
    return out.select("c_nationkey", F.round("value", 6).alias("value"))


def grouped_metrics(spark, sf_dir):
    """A user's own metric of scores and labels per event type's pool of each day: the score of the best gold item, 0 without one."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    out = pools.grouped_metric(e, ["day"], lambda s, y: max((a for a, b in zip(s, y) if b), default=0.0))
    return out.select("day", F.round("value", 6).alias("value"))


def _results(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("query"), F.col("event_type").alias("intervention"), (k % 3 == 0).alias("flip"), F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 50).alias("margin_delta"),
        F.when(k % 13 == 0, None).otherwise(F.col("value") / 7).alias("score_delta"), (k % 5 - 2).alias("rank_change"),
    )


def intervention_summary(spark, sf_dir):
    """Events as scored edits, by type."""
    out = records.intervention_summary(_results(spark, sf_dir), ["intervention"])
    return out.select("intervention", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("intervention", "n")])


def paired_differences(spark, sf_dir):
    """Mean margin change of users under clicks less that under views."""
    return records.paired_differences(_results(spark, sf_dir), "margin_delta", "click", "view").select("query", F.round("d", 6).alias("d"))


def sign_flip_exact(spark, sf_dir):
    """Exact sign-flip tests of nations' mean balances by region: five differences each."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.round(F.avg("c_acctbal"), 3) - 4500).alias("d")), F.col("n_nationkey") == F.col("c_nationkey"))
    out = inference.sign_flip_tests(n.select("n_regionkey", F.col("n_nationkey").alias("id"), "d"), ["n_regionkey"])
    return out.select("n_regionkey", "n", F.round("mean", 6).alias("mean"), F.round("p", 9).alias("p"), "method")


def sign_tests(spark, sf_dir):
    """Exact sign tests of values against 50 by event type and month."""
    e = table(spark, sf_dir, "events").select("event_type", F.month("ts").alias("month"), (F.floor("value") - 50).alias("d"))
    return inference.sign_tests(e, ["event_type", "month"]).withColumn("p_value", F.round("p_value", 9))


def _nodes(spark, sf_dir):
    s, e = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "embeddings")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("doc_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "tool").otherwise("malware").alias("type"), F.array(F.when(F.col("s_suppkey") % 4 == 0, F.lit("Tactic")).otherwise(F.lit("Entity"))).alias("labels"))
    return store.with_embeddings(nodes, e.select(F.col("vec_id").alias("id"), as_double(F.col("embedding")).alias("embedding")))


def store_labels(spark, sf_dir):
    """Suppliers as nodes with embeddings; those of one label are marked as targets."""
    marked = store.with_label(store.without_label(_nodes(spark, sf_dir), "Target"), "Target", ["Tactic"])
    return marked.groupBy(F.array_join("labels", ",").alias("labels"), F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("squares"))


def store_sources(spark, sf_dir):
    """Nodes with embeddings that orders' customers' nations mention, as documents."""
    n = _nodes(spark, sf_dir)
    m = n.select("doc_id", "id").union(n.select(F.lit("d0"), "id"))
    return store.sources(n, m).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def key_violations(spark, sf_dir):
    """Customers whose segment, nation and rounded balance stand more than once."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", F.round(F.col("c_acctbal") / 1000).cast("long").alias("thousands"))
    return store.violations(c, ["c_mktsegment", "c_nationkey", "thousands"])


_P = "WITH p AS (SELECT user_id AS query, event_id AS item, value AS score, (event_type = 'purchase')::INT AS label FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM p)"
_V = _P + """, v AS (SELECT query, count(*) AS pool_size, max(label) = 1 AS gold_in_pool, max(item) FILTER (rank = 1) AS predicted, max(label) FILTER (rank = 1) = 1 AS correct, min(rank) FILTER (label = 1) AS gold_rank FROM r GROUP BY query),
    x AS (SELECT DISTINCT v.query FROM v JOIN p ON p.query = v.query AND p.label = 1 AND p.item - v.predicted BETWEEN 0 AND 3 WHERE p.item = predicted OR (p.item <= (SELECT max(item) FROM p) + 3 AND (p.item = predicted + 1 OR p.item = predicted + 2 OR (p.item = predicted + 3 AND predicted + 1 IN (SELECT item FROM p))))),
    w AS (SELECT v.*, x.query IS NOT NULL AS correct_plus, coalesce(gold_rank <= 3, false) AS hit3, coalesce(gold_rank <= 5, false) AS hit5, coalesce(1.0::DOUBLE / gold_rank, 0) AS rr FROM v LEFT JOIN x USING (query))"""
_K = "WITH t AS (SELECT l_orderkey AS query, l_linenumber AS rank, 'P' || (l_partkey % 97) AS item FROM lineitem), g AS (SELECT DISTINCT 'P' || (s_suppkey * 3 % 101) AS item FROM supplier)"
_RES = "WITH r AS (SELECT user_id AS query, event_type AS intervention, event_id % 3 = 0 AS flip, CASE WHEN event_id % 11 <> 0 THEN value - 50 END AS m, CASE WHEN event_id % 13 <> 0 THEN value / 7 END AS s, event_id % 5 - 2 AS c FROM events)"
_NODES = "WITH n AS (SELECT s_suppkey AS id, 'd' || s_nationkey AS doc_id, s_name AS name, s_suppkey % 4 = 0 AS tactic, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey)"

QUERIES = {f.__name__: f for f in (pool_verdicts, pool_groups, metrics_by_k, report_leaderboard, report_id_scores, precision_recall_points, grouped_statistics, grouped_metrics, intervention_summary, paired_differences, sign_flip_exact, sign_tests, store_labels, store_sources, key_violations)}
ORACLE = {
    "pool_verdicts": _V + " SELECT query, pool_size, gold_in_pool, predicted, correct, correct_plus, hit3, hit5, gold_rank, round(rr, 6) AS rr FROM w",
    "pool_groups": _V + ' SELECT \'g\' || (query % 5) AS "group", count(*) AS n, round(avg(correct::INT), 4) AS p1, round(avg(correct_plus::INT), 4) AS p1_plus, round(avg(hit3::INT), 4) AS hit3, round(avg(hit5::INT), 4) AS hit5, round(avg(rr), 4) AS mrr, round(avg(gold_in_pool::INT), 4) AS gold_in_pool_rate FROM w GROUP BY 1',
    "metrics_by_k": _K + """, m AS (SELECT k, query, count(*) AS n, count(g.item) AS tp FROM t JOIN (SELECT unnest([1, 3, 5]) AS k) ON rank <= k LEFT JOIN g USING (item) GROUP BY ALL), c AS (SELECT k, count(DISTINCT g.item) AS covered FROM t JOIN (SELECT unnest([1, 3, 5]) AS k) ON rank <= k JOIN g USING (item) GROUP BY k)
        SELECT k, count(*) AS queries, round(avg((tp > 0)::INT), 6) AS hit, round(sum(tp) / sum(n), 6) AS precision, round(1 - sum(tp) / sum(n), 6) AS spurious, round(max(covered) / (SELECT count(*) FROM g), 6) AS recall FROM m JOIN c USING (k) GROUP BY k""",
    "report_leaderboard": """WITH t AS (SELECT l_returnflag AS report, l_orderkey AS query, l_linenumber AS rank, 'P' || (l_partkey % 97) AS item FROM lineitem), g AS (SELECT DISTINCT l_returnflag AS report, 'P' || (l_suppkey * 3 % 101) AS item FROM lineitem),
        j AS (SELECT t.report, k, query, t.item, g.item AS gold FROM t JOIN (SELECT unnest([1, 5]) AS k) ON rank <= k LEFT JOIN g ON g.report = t.report AND g.item = t.item), m AS (SELECT report, k, query, count(*) AS n, count(gold) AS tp FROM j GROUP BY ALL),
        c AS (SELECT report, k, count(DISTINCT gold) AS covered FROM j GROUP BY ALL), z AS (SELECT report, count(*) AS total FROM g GROUP BY 1)
        SELECT report, k, count(*) AS queries, round(avg((tp > 0)::INT), 6) AS hit, round(sum(tp) / sum(n), 6) AS precision, round(max(covered) / max(total), 6) AS recall FROM m JOIN c USING (report, k) JOIN z USING (report) GROUP BY report, k""",
    "report_id_scores": """WITH f AS (SELECT DISTINCT c_mktsegment AS report, 'T' || (l_partkey // 7) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), g AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY']) AS report, 'T' || p_partkey AS id FROM part),
        j AS (SELECT coalesce(f.report, g.report) AS report, f.id IS NOT NULL AS f, g.id IS NOT NULL AS g FROM f FULL JOIN g ON f.report = g.report AND f.id = g.id), n AS (SELECT report, count(*) FILTER (f AND g) AS matched, count(*) FILTER (NOT f) AS missed, count(*) FILTER (NOT g) AS spurious FROM j GROUP BY 1)
        SELECT *, CASE WHEN matched + spurious > 0 THEN round(matched / (matched + spurious), 4) ELSE 0 END AS precision, CASE WHEN matched + missed > 0 THEN round(matched / (matched + missed), 4) ELSE 0 END AS recall, round(2 * matched / (2 * matched + missed + spurious), 4) AS f1 FROM n""",
    "precision_recall_points": "WITH g AS (SELECT round(value, 0) AS score, sum((event_type = 'purchase')::INT) AS pos, count(*) AS n FROM events GROUP BY 1), c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER () AS p FROM g) SELECT score AS threshold, round(tp / seen, 6) AS precision, round(tp / p, 6) AS recall FROM c",
    "grouped_statistics": "SELECT c_nationkey, round(coalesce(avg(c_acctbal) FILTER (c_acctbal > 1000), 0), 6) AS value FROM customer GROUP BY 1",
    "grouped_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS day, round(coalesce(max(value) FILTER (event_type = 'purchase'), 0), 6) AS value FROM events GROUP BY 1",
    "intervention_summary": _RES + """, g AS (SELECT intervention, count(*) AS n, count(*) FILTER (flip) AS k, avg(m) AS a, stddev_samp(m) AS sd, avg(s) AS b, avg(c) AS c FROM r GROUP BY 1), w AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
        SELECT intervention, n, round(p, 6) AS flip_rate, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS high,
        round(a, 6) AS mean_margin_delta, round(sd, 6) AS std_margin_delta, round(b, 6) AS mean_score_delta, round(c, 6) AS mean_rank_change FROM w""",
    "paired_differences": _RES + ", q AS (SELECT query, avg(m) FILTER (intervention = 'click') AS a, avg(m) FILTER (intervention = 'view') AS b FROM r GROUP BY 1) SELECT query, round(a - b, 6) AS d FROM q WHERE a IS NOT NULL AND b IS NOT NULL",
    "sign_flip_exact": """WITH b AS (SELECT n_regionkey, n_nationkey, round(avg(c_acctbal), 3) - 4500 AS d FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM b), n AS (SELECT n_regionkey, count(*) AS n, avg(d) AS mean, sum(d) AS t FROM d GROUP BY 1),
        f AS (SELECT n_regionkey, unnest(range(1::BIGINT << n)) AS f FROM n), s AS (SELECT n_regionkey, f, sum(CASE WHEN (f >> k) & 1 = 1 THEN -d ELSE d END) AS s FROM f JOIN d USING (n_regionkey) GROUP BY ALL)
        SELECT n_regionkey, max(n) AS n, round(max(mean), 6) AS mean, round(avg((abs(s) >= abs(t) - 1e-9)::INT), 9) AS p, 'exact' AS method FROM s JOIN n USING (n_regionkey) GROUP BY 1""",
    "sign_tests": """WITH d AS (SELECT event_type, month(ts) AS month, floor(value) - 50 AS d FROM events), c AS (SELECT event_type, month, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) FILTER (d = 0) AS n_zero, count(*) AS n_paired FROM d GROUP BY ALL), n AS (SELECT *, n_pos + n_neg AS n_nonzero, least(n_pos, n_neg) AS k FROM c),
        t AS (SELECT event_type, month, sum(exp(lgamma(n_nonzero + 1.0) - lgamma(j + 1.0) - lgamma(n_nonzero - j + 1.0) - n_nonzero * ln(2))) AS p FROM (SELECT *, unnest(range(k + 1)) AS j FROM n) GROUP BY ALL)
        SELECT n.event_type, n.month, n_pos, n_neg, n_zero, n_paired, n_nonzero, round(least(1, 2 * p), 9) AS p_value FROM n JOIN t ON n.event_type = t.event_type AND n.month = t.month""",
    "store_labels": _NODES + " SELECT CASE WHEN tactic THEN 'Tactic' ELSE 'Entity' END || CASE WHEN v IS NULL THEN '' WHEN tactic THEN ',Vectorized,Target' ELSE ',Vectorized' END AS labels, coalesce(len(v), NULL) AS dimension, count(*) AS n, CASE WHEN count(v) > 0 THEN round(count(v)::DOUBLE, 6) END AS squares FROM n GROUP BY 1, 2",
    "store_sources": _NODES + " SELECT doc_id, count(DISTINCT id) AS n, min(name) AS first FROM (SELECT doc_id, id, name FROM n WHERE v IS NOT NULL UNION ALL SELECT 'd0', id, name FROM n WHERE v IS NOT NULL) GROUP BY 1",
    "key_violations": "SELECT c_mktsegment, c_nationkey, round(c_acctbal / 1000)::BIGINT AS thousands, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1",
}
