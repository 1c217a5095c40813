"""Closed-form statistics as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n, pinned to 0 and 1 at the ends; null for n = 0."""
    p, zz = k / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n == 0, None).when(k == 0, 0.0).otherwise(centre - half), F.when(n == 0, None).when(k == n, 1.0).otherwise(centre + half)


def binomial_cdf(k: Column, n: Column) -> Column:
    """P(X <= k) for n fair coins; terms in logarithms, so large n doesn't underflow. Linear in k, inside one expression."""
    half = F.log(F.lit(2.0)) * n
    start = F.struct((-half).alias("l"), F.exp(-half).alias("s"))

    def step(a: Column, i: Column) -> Column:
        term = a["l"] + F.log((n - i + 1) / i.cast("double"))
        return F.struct(term.alias("l"), (a["s"] + F.exp(term)).alias("s"))

    return F.when(k < 0, 0.0).when(k < 1, F.exp(-half)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1))), start, step)["s"])


def mcnemar_exact(b: Column, c: Column) -> tuple[Column, Column]:
    """Exact and mid-p values of McNemar's test; 1 without discordant pairs."""
    n, k = b + c, F.least(b, c)
    below, upto = binomial_cdf(k - 1, n), binomial_cdf(k, n)
    exact = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * upto))
    mid = F.when(n == 0, 1.0).when(b == c, 1.0 - (upto - below)).otherwise(F.least(F.lit(1.0), 2 * below + (upto - below)))
    return exact, mid


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - 1 / 1260 / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is close to the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        new = total + term / (2 * j + 1)
        if new == total:
            return total
        total, j = new, j + 1


def fair_coin_pmf(k: int, n: int) -> float:
    """P(X = k) for n fair coins by the saddle point, to nearly full precision at any n."""
    if k in (0, n):
        return 0.5**n
    low = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2)
    return math.exp(low) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def fair_coin_cdf(k: int, n: int) -> float:
    """P(X <= k) for n fair coins, k at most n / 2: terms fall from k downward, so about twelve root n of them count."""
    import numpy as np

    if k < 0:
        return 0.0
    j = np.arange(min(k, 12 * math.isqrt(n) + 60), dtype=float)
    return fair_coin_pmf(k, n) * float(1 + np.cumprod((k - j) / (n - k + j + 1)).sum())


def sign_place(n: int, alpha: float) -> int:
    """The last k with 2 P(X <= k) <= alpha for n fair coins, 0 if there is none; exact at every n."""
    k = max(0, min((n - 1) // 2, int((n - 2 * math.sqrt(n)) / 2)))
    while k < (n - 1) // 2 and 2 * fair_coin_cdf(k + 1, n) <= alpha:
        k += 1
    while k > 0 and 2 * fair_coin_cdf(k, n) > alpha:
        k -= 1
    return k
