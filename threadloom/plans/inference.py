"""Queries of the inferential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.functions import text as X
from threadloom.operators import inference
from threadloom.session import table


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def mcnemar(spark, sf_dir):
    """Quality against toxicity labels."""
    l = table(spark, sf_dir, "labels")
    return _r(inference.mcnemar(l.select(F.col("quality").alias("a"), F.col("toxic").alias("b"))), "chi2", "chi2_corrected", "p_exact", "p_mid")


def kappa_ac1_alpha(spark, sf_dir):
    return _r(inference.agreement(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))), "agreement", "kappa", "ac1", "alpha")


def holm_bh(spark, sf_dir):
    """Draws stand in for the p-values of suppliers."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.pow(X.hash_draw(F.lit("p"), F.col("s_suppkey")), 3).alias("p"))
    return _r(inference.adjust(t), "p", "holm", "bh")


def wilson_ci(spark, sf_dir):
    """Share of large quantities by return flag and status."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum((F.col("l_quantity") > 40).cast("long")).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return _r(s.withColumns({"low": low, "high": high}), "low", "high")


def cles_dz(spark, sf_dir):
    """Ship month against quantity, by ship mode's stand-in, the line number."""
    li = table(spark, sf_dir, "lineitem")
    d = li.select("l_linenumber", (F.col("l_quantity") - 25 + (F.col("l_partkey") % 7) - 3).alias("d"))
    return _r(inference.paired_effects(d, ["l_linenumber"]).drop("p_sign"), "mean", "dz", "gz", "cles")


def bootstrap_hash_ci(spark, sf_dir):
    """Mean score over resamples of users."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cluster")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return _r(inference.cluster_bootstrap(c, 200, 42), "mean", "low", "high")


def sign_flip_p(spark, sf_dir):
    """Whether the mean of purchases' scores differs from 50, over users."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg((F.round(F.avg("value"), 3) - 50).alias("d"))
    return _r(inference.sign_flip(e, 199, 3), "p")


def paired_median(spark, sf_dir):
    """Medians with sign-test intervals by order priority."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("d"))
    return inference.median_sign_interval(o.select("o_orderpriority", "d"), ["o_orderpriority"])


_D = "('0x' || substr(md5({}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0"
_CDF = "list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))"

QUERIES = {f.__name__: f for f in (mcnemar, kappa_ac1_alpha, holm_bh, wilson_ci, cles_dz, bootstrap_hash_ci, sign_flip_p, paired_median)}
ORACLE = {
    "mcnemar": f"""WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n00 FROM labels),
        s AS (SELECT *, n10 + n01 AS n, least(n10, n01)::BIGINT AS k FROM t), c AS (SELECT *, {_CDF.format(k='k')} AS upto, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS pk FROM s)
        SELECT n11, n10, n01, n00, round(abs(n10 - n01) * abs(n10 - n01) / n, 6) AS chi2, round(pow(greatest(abs(n10 - n01) - 1, 0), 2) / n, 6) AS chi2_corrected, round(least(1, 2 * upto), 6) AS p_exact, round(CASE WHEN n10 = n01 THEN 1 - pk ELSE least(1, 2 * (upto - pk) + pk) END, 6) AS p_mid, n < 5 AS few FROM c""",
    "kappa_ac1_alpha": """WITH c AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a1, avg(toxic) AS b1, (sum(quality) + sum(toxic))::DOUBLE AS ones FROM labels),
        s AS (SELECT *, a1 * b1 + (1 - a1) * (1 - b1) AS pe, 2 * (ones / (2 * n)) * (1 - ones / (2 * n)) AS pe1, 1 - (ones * (ones - 1) + (2 * n - ones) * (2 * n - ones - 1)) / (2 * n * (2 * n - 1)) AS de FROM c)
        SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pe1) / (1 - pe1), 6) AS ac1, round(1 - (1 - po) / de, 6) AS alpha FROM s""",
    "holm_bh": f"""WITH t AS (SELECT s_suppkey AS id, pow({_D.format("'p|' || s_suppkey")}, 3) AS p FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM t)
        SELECT id, round(p, 6) AS p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY p, id)), 6) AS holm, round(least(1, min(m * p / k) OVER (ORDER BY p DESC, id DESC)), 6) AS bh FROM k""",
    "paired_median": """WITH o AS (SELECT o_orderpriority, round(avg(o_totalprice), 2) AS d FROM orders GROUP BY o_orderpriority, o_custkey), g AS (SELECT o_orderpriority, list(d ORDER BY d) AS x, count(*) AS n FROM o GROUP BY 1),
        c AS (SELECT o_orderpriority, n, x, list_transform(range(0, (n - 1) // 2 + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS t FROM g),
        k AS (SELECT *, greatest(len(list_filter(range(1, len(t) + 1), lambda j: 2 * list_sum(t[1:j]) <= 0.05)) - 1, 0) AS k FROM c)
        SELECT o_orderpriority, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 AS median, x[k + 1] AS low, x[n - k] AS high FROM k""",
    "wilson_ci": f"""WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 40) AS k FROM lineitem GROUP BY ALL), w AS (SELECT *, k / n AS p, {stats.Z95}::DOUBLE AS z FROM s)
        SELECT l_returnflag, l_linestatus, n, k, round(CASE WHEN k = 0 THEN 0 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) END, 6) AS low,
        round(CASE WHEN k = n THEN 1 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) END, 6) AS high FROM w""",
    "cles_dz": """WITH d AS (SELECT l_linenumber, l_quantity - 25 + (l_partkey % 7) - 3 AS d FROM lineitem), s AS (SELECT l_linenumber, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, avg(CASE WHEN d > 0 THEN 1 WHEN d = 0 THEN 0.5 ELSE 0 END::DOUBLE) AS cles FROM d GROUP BY 1)
        SELECT l_linenumber, n, round(mean, 6) AS mean, round(mean / sd, 6) AS dz, round(mean / sd * (1 - 3.0 / (4.0 * (n - 1) - 1)), 6) AS gz, round(cles, 6) AS cles FROM s""",
    "bootstrap_hash_ci": f"""WITH c AS (SELECT user_id, sum(value) AS s, count(*) AS n, row_number() OVER (ORDER BY user_id) AS k, count(*) OVER () AS m FROM events GROUP BY user_id),
        d AS (SELECT r, floor({_D.format("'42|' || r || '|' || j")} * m)::BIGINT + 1 AS k FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(1, count(DISTINCT user_id) + 1)) AS j, count(DISTINCT user_id) AS m FROM events)),
        v AS (SELECT r, sum(s) / sum(n) AS v FROM d JOIN c USING (k) GROUP BY r) SELECT count(*) AS replicates, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v""",
    "sign_flip_p": f"""WITH e AS (SELECT user_id AS id, round(avg(value), 3) - 50 AS d FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        f AS (SELECT r, sum(d * CASE WHEN {_D.format("'3|' || r || '|' || id")} < 0.5 THEN -1 ELSE 1 END) AS s FROM e, (SELECT unnest(range(199)) AS r) GROUP BY r)
        SELECT round((1 + count(*) FILTER (abs(s) >= (SELECT abs(sum(d)) FROM e) - 1e-9)) / 200.0, 6) AS p FROM f""",
}
