"""Agreement, multiple testing, resampling and paired effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.functions import text as X
from threadloom.operators.kernels import exact_sign_flip
from threadloom.operators.running import running
from threadloom.session import written


def mcnemar(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of 0/1 -> the table, chi-squared with and without correction, exact and mid p."""
    n = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0)).cast("long")
    t = pairs.agg(n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"))
    b, c = F.col("n10"), F.col("n01")
    exact, mid = stats.mcnemar_exact(b, c)
    d = F.abs(b - c)
    return t.select(
        "*", F.when(b + c > 0, d * d / (b + c)).otherwise(0.0).alias("chi2"), F.when(b + c > 0, F.pow(F.greatest(d - 1, F.lit(0)), 2) / (b + c)).otherwise(0.0).alias("chi2_corrected"),
        exact.alias("p_exact"), mid.alias("p_mid"), (b + c < 5).alias("few"),
    )


def agreement(ratings: DataFrame) -> DataFrame:
    """ratings(a, b), nominal -> Cohen's kappa, Gwet's AC1 and Krippendorff's alpha for two raters. One row per category is the largest intermediate."""
    cells = ratings.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda x, other: cells.select(F.col(x).alias("c"), F.when(F.lit(other), F.col("n")).otherwise(0).alias("na"), F.when(F.lit(not other), F.col("n")).otherwise(0).alias("nb"))
    marg = side("a", True).union(side("b", False)).groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    m = marg.join(F.broadcast(total))  # one row
    s = m.groupBy("total", "same").agg(
        F.sum(F.col("na") * F.col("nb") / (F.col("total") * F.col("total"))).alias("pe"), F.count("*").alias("q"),
        F.sum((F.col("na") + F.col("nb")) / (2.0 * F.col("total")) * (1 - (F.col("na") + F.col("nb")) / (2.0 * F.col("total")))).alias("spread"),
        F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb") - 1)).alias("pairs"),
    )
    po, n2 = F.col("same") / F.col("total"), 2 * F.col("total")
    pe1 = F.col("spread") / (F.col("q") - 1)
    de = 1 - F.col("pairs") / (n2 * (n2 - 1))
    return s.select(
        F.col("total").alias("n"), po.alias("agreement"), F.when(F.col("pe") < 1, (po - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0).alias("kappa"),
        F.when(F.col("q") > 1, (po - pe1) / (1 - pe1)).otherwise(1.0).alias("ac1"), F.when(de > 0, 1 - (1 - po) / de).otherwise(1.0).alias("alpha"),
    )


def adjust(tests: DataFrame) -> DataFrame:
    """tests(id, p) with Holm's step-down and Benjamini-Hochberg's step-up values, over ranges of p rather than one task."""
    m = tests.agg(F.count("*").alias("m"))
    rows = running(tests.select("id", "p"), "p", [F.asc("p"), F.col("id")], {"k": ("sum", F.lit(1))}).join(F.broadcast(m))  # one row
    rows = rows.withColumns({"h": (F.col("m") - F.col("k") + 1) * F.col("p"), "b": F.col("m") * F.col("p") / F.col("k")})
    down = running(rows, "p", [F.asc("p"), F.col("id")], {"holm": ("max", F.col("h"))})
    up = running(down, "p", [F.desc("p"), F.desc("id")], {"bh": ("min", F.col("b"))}, descending=True)
    return up.select("id", "p", F.least(F.lit(1.0), "holm").alias("holm"), F.least(F.lit(1.0), "bh").alias("bh"))


MOST_CLUSTERS = 500_000


def cluster_bootstrap(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """clusters(cluster, s, n): percentile interval of sum(s) / sum(n) over resamples of clusters by hash draws.

    Clusters are numbered once. If they are few enough to broadcast, which is counted, draws are made, matched and summed where they are, and only a
    sum per replicate and task is shuffled; else a replicate's draws meet the clusters in a join.
    """
    numbered = written(running(clusters, "cluster", [F.col("cluster")], {"k": ("sum", F.lit(1))}).select("k", "s", "n"), "clusters")
    m = numbered.count()
    numbered = F.broadcast(numbered) if m <= MOST_CLUSTERS else numbered
    count = numbered.agg(F.count("*").alias("m"))
    draws = clusters.sparkSession.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(count))  # one row
    draws = draws.select("replicate", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("j"))
    draws = draws.select("replicate", (F.floor(X.hash_draw(F.lit(seed), F.col("replicate"), F.col("j")) * F.col("m")) + 1).alias("k"))
    per = draws.join(numbered, "k").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("value"))
    return per.agg(F.count("*").alias("replicates"), F.avg("value").alias("mean"), F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))


def paired_effects(diffs: DataFrame, by: list[str]) -> DataFrame:
    """diffs(by, d): mean, dz, Hedges' gz, P(d > 0) + P(d = 0) / 2, and the sign test."""
    d = F.col("d")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = diffs.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), n(d > 0).alias("up"), n(d < 0).alias("down"), F.avg(F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)).alias("cles"))
    dz = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    exact, _ = stats.mcnemar_exact(F.col("up"), F.col("down"))
    return s.select(*by, "n", "mean", dz.alias("dz"), (dz * (1 - 3.0 / (4.0 * (F.col("n") - 1) - 1))).alias("gz"), "cles", exact.alias("p_sign"))


def sign_flip(diffs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """diffs(id, d): Monte Carlo sign-flip p of the mean, (1 + hits) / (1 + replicates), with hash signs. ``sign_flip_tests`` takes the
    exact value where few differences allow it."""
    seen = diffs.agg(F.abs(F.sum("d")).alias("t"))
    sign = F.when(X.hash_draw(F.lit(seed), F.col("r"), F.col("id")) < 0.5, -1).otherwise(1)
    rows = diffs.select("id", "d", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    sums = rows.groupBy("r").agg(F.sum(sign * F.col("d")).alias("s"))
    hits = sums.join(F.broadcast(seen)).agg(F.sum(F.when(F.abs("s") >= F.col("t") - 1e-9, 1).otherwise(0)).alias("x"))  # one row
    return hits.select(((1 + F.col("x")) / (1.0 + replicates)).alias("p"))


EXACT_FLIPS = 20  # fixed value: up to so many differences every sign pattern is tried


def sign_flip_tests(diffs: DataFrame, by: list[str], replicates: int = 20_000, seed: int = 42) -> DataFrame:
    """diffs(by, id, d): sign-flip test of the mean per group: mean, p, n, 'exact' with the share of all 2^n patterns for up to EXACT_FLIPS
    differences, else 'monte_carlo' with (1 + hits) / (1 + replicates). Null differences are left out.

    Exact groups are enumerated where their few rows meet; large ones are summed map-side per replicate and never meet."""
    rows = diffs.where("d is not null")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.sum("d").alias("total"))
    small = rows.join(sizes.where(F.col("n") <= EXACT_FLIPS).select(*by), by, "left_semi").groupBy(*by).agg(F.collect_list("d").alias("ds"))
    exact = small.select(*by, F.udf(lambda ds: exact_sign_flip(ds), "double")("ds").alias("p"), F.lit("exact").alias("method"))
    large = rows.join(sizes.where(F.col("n") > EXACT_FLIPS).select(*by), by, "left_semi").select(*by, "id", "d", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    sign = F.when(X.hash_draw(F.lit(seed), F.col("r"), F.col("id")) < 0.5, -1).otherwise(1)
    sums = large.groupBy(*by, "r").agg(F.sum(sign * F.col("d")).alias("s")).join(sizes.select(*by, "total"), by)
    hits = sums.groupBy(*by).agg(F.sum(F.when(F.abs("s") >= F.abs("total") - 1e-9, 1).otherwise(0)).alias("x"))
    drawn = hits.select(*by, ((1 + F.col("x")) / (1.0 + replicates)).alias("p"), F.lit("monte_carlo").alias("method"))
    return sizes.select(*by, "n", "mean").join(exact.union(drawn), by)


def sign_tests(diffs: DataFrame, by: list[str]) -> DataFrame:
    """diffs(by, d): counts of positive, negative and zero differences and the exact two-sided binomial p, 1 if none differs from zero."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = diffs.where("d is not null").groupBy(*by).agg(n(F.col("d") > 0).alias("n_pos"), n(F.col("d") < 0).alias("n_neg"), n(F.col("d") == 0).alias("n_zero"))
    exact, _ = stats.mcnemar_exact(F.col("n_pos"), F.col("n_neg"))
    return s.select(*by, "n_pos", "n_neg", "n_zero", (F.col("n_pos") + F.col("n_neg") + F.col("n_zero")).alias("n_paired"), (F.col("n_pos") + F.col("n_neg")).alias("n_nonzero"), exact.alias("p_value"))


def paired_risk_difference(a: DataFrame, b: DataFrame, replicates: int = 9999, seed: int = 42) -> DataFrame:
    """a(query, rate) and b(query, rate): mean of the differences over the queries of both, with a percentile interval over resampled queries."""
    d = a.select("query", F.col("rate").alias("x")).join(b.select("query", F.col("rate").alias("y")), "query").select(F.col("query").alias("cluster"), (F.col("x") - F.col("y")).alias("s"), F.lit(1).alias("n"))
    mean = d.agg(F.avg("s").alias("risk_diff"), F.count("*").alias("n_queries"))
    return cluster_bootstrap(d, replicates, seed).select("low", "high").join(F.broadcast(mean)).select("risk_diff", F.col("low").alias("ci_lo"), F.col("high").alias("ci_hi"), "n_queries")  # one row


def median_sign_interval(diffs: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Median and the order statistics of the sign-test interval, per group, from ranks over ranges of the values.

    The place k is the last with 2 P(X <= k) within 1 - level for n fair coins, 0 if there is none (``stats.sign_place``, a call a group).
    """
    n = F.col("n")
    place = F.udf(lambda size: stats.sign_place(size, 1 - level), "long")
    rows = diffs.where("d is not null")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("k", place("n"))
    ranked = running(rows.select(*by, "d"), "d", [F.asc("d")], {"rank": ("sum", F.lit(1))}, partition=by)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("d")))
    joined = ranked.join(sizes, by).where("rank in (k + 1, n - k, floor((n + 1) / 2), floor(n / 2) + 1)")
    return joined.groupBy(*by).agg(
        ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"), at(F.col("k") + 1).alias("low"), at(n - F.col("k")).alias("high")
    )
