"""Resampling and rank kernels on the values of one group: NumPy on an array, a group at a time."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame

from threadloom.operators.grouped import per_group

_NORMAL = NormalDist()


def exact_sign_flip(d) -> float:
    """Share of all sign patterns whose absolute sum reaches the observed one; for up to 20 values."""
    import numpy as np

    d = np.asarray(d, dtype=float)
    sums = np.zeros(1)
    for x in d:
        sums = np.concatenate((sums + x, sums - x))
    return float(np.mean(np.abs(sums) >= abs(d.sum()) - 1e-12))


def wilcoxon(d) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p with Pratt's zeros, normal approximation with ties."""
    import numpy as np

    d = np.asarray(d, dtype=float)
    size = np.abs(d)
    _, inverse, count = np.unique(size, return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    rank = (upto - (count - 1) / 2.0)[inverse]
    some = d != 0
    if not some.any():
        return 0.0, 1.0
    up, down = rank[d > 0].sum(), rank[d < 0].sum()
    n, zeros = len(d), int((~some).sum())
    mean = n * (n + 1) / 4.0 - zeros * (zeros + 1) / 4.0
    ties = np.unique(size[some], return_counts=True)[1]
    var = (n * (n + 1) * (2 * n + 1) - zeros * (zeros + 1) * (2 * zeros + 1)) / 24.0 - (ties**3 - ties).sum() / 48.0
    t = min(up, down)
    return float(t), float(min(1.0, 2 * _NORMAL.cdf((t - mean) / math.sqrt(var)))) if var > 0 else 1.0


def bca(d, level: float = 0.95, replicates: int = 9999, seed: int = 42) -> tuple[float, float]:
    """Bias-corrected accelerated interval of the mean; the percentile interval where the correction is undefined; a constant is its own interval."""
    import numpy as np

    d = np.asarray(d, dtype=float)
    if len(d) == 0:
        return math.nan, math.nan
    if np.all(d == d[0]):
        return float(d[0]), float(d[0])
    rng, means = np.random.default_rng(seed), []
    for at in range(0, replicates, 500):
        means.append(d[rng.integers(0, len(d), (min(500, replicates - at), len(d)))].mean(axis=1))
    means = np.concatenate(means)
    share = float((means < d.mean()).mean())
    low, high = (1 - level) / 2, (1 + level) / 2
    if 0 < share < 1:
        jack = (d.sum() - d) / (len(d) - 1)
        dev = jack.mean() - jack
        z0, a = _NORMAL.inv_cdf(share), float((dev**3).sum() / (6 * (dev**2).sum() ** 1.5))
        adjusted = [z0 + (z0 + _NORMAL.inv_cdf(q)) / (1 - a * (z0 + _NORMAL.inv_cdf(q))) for q in (low, high)]
        low, high = (_NORMAL.cdf(x) for x in adjusted)
    return float(np.quantile(means, low)), float(np.quantile(means, high))


def paired_tests(diffs: DataFrame, by: str, replicates: int = 1999) -> DataFrame:
    """diffs(by, d) -> signed-rank test and BCa interval per group; a group's values are one array, so groups must fit a task."""
    kind = dict(diffs.dtypes)[by]

    def run(rows: list[dict]) -> list[tuple]:
        d = [r["d"] for r in rows]
        (t, p), (low, high) = wilcoxon(d), bca(d, replicates=replicates)
        return [(rows[0][by], len(d), t, p, low, high)]

    return per_group(diffs.select(by, "d").where("d is not null"), [by], ["d"], run, f"`{by}` {kind}, n long, statistic double, p double, low double, high double")
