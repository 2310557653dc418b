"""Rank tests: U and Wilcoxon statistics in DataFrame form, p-values on the results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.plans.ordered import along

EXACT_LIMIT = 8  # the smaller sample up to which the exact U distribution is used
EXACT_SIGNED = 50  # pairs up to which the exact signed-rank distribution is used


def rank_sums(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U, Cliff's delta and tie term for samples x and y of every key.

    Input (keys.., side 'x' or 'y', value). Equal values are counted first, so a
    key's order work is over distinct values: for one value with nx and ny rows and
    `below` smaller y rows, U grows by nx * (below + ny / 2).
    """
    x, y = F.col("side") == "x", F.col("side") == "y"
    cells = values.groupBy(*keys, "value").agg(
        F.count(F.when(x, 1)).alias("nx"), F.count(F.when(y, 1)).alias("ny")
    )
    ranked = along(cells, keys, ["value"]).running_sum(F.col("ny"), "_upto")
    below = F.col("_upto") - F.col("ny")
    ties = F.col("nx") + F.col("ny")
    out = ranked.frame().groupBy(*keys).agg(
        F.sum("nx").alias("n_x"),
        F.sum("ny").alias("n_y"),
        F.sum(F.col("nx") * (below + F.col("ny") / 2)).alias("u"),
        F.sum((ties * ties * ties - ties).cast("double")).alias("ties"),
    )
    delta = 2 * F.col("u") / (F.col("n_x") * F.col("n_y")) - 1
    both = (F.col("n_x") > 0) & (F.col("n_y") > 0)
    return out.select(
        *keys,
        "n_x",
        "n_y",
        F.when(both, F.col("u")).alias("u"),
        F.when(both, delta).alias("cliffs_delta"),
        "ties",
    )


@lru_cache(maxsize=512)
def _u_tail(n: int, m: int) -> np.ndarray:
    """P(U >= k) for k = 0..n*m without ties."""
    counts = np.zeros(n * m + 1)
    counts[0] = 1.0
    for i in range(1, n + 1):  # multiply by (1 - z^(m+i)) / (1 - z^i)
        step = m + i
        if step <= n * m:
            counts[step:] = counts[step:] - counts[: n * m + 1 - step]
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
    mass = counts / counts.sum()
    return np.cumsum(mass[::-1])[::-1]


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided p: exact for a small side without ties, else normal with corrections."""
    if n == 0 or m == 0 or u is None or math.isnan(u):
        return math.nan
    top = max(u, n * m - u)
    if min(n, m) <= EXACT_LIMIT and ties == 0:
        return min(1.0, 2.0 * float(_u_tail(min(n, m), max(n, m))[int(top)]))
    total = n + m
    spread = n * m / 12.0 * (total + 1 - ties / (total * (total - 1)))
    if spread <= 0:
        return 1.0
    z = (top - n * m / 2.0 - 0.5) / math.sqrt(spread)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def with_mann_whitney_p(stats: DataFrame) -> DataFrame:
    """Add `p_value` to `rank_sums` rows."""

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if pd.isna(a) else mann_whitney_p(a, int(b), int(c), d)
                for a, b, c, d in zip(u, n, m, ties)
            ],
            dtype="float64",
        )

    p = p_value("u", "n_x", "n_y", "ties")
    return stats.withColumn("p_value", F.when(F.col("u").isNotNull(), p))


def signed_rank(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wilcoxon signed-rank statistic of paired differences (keys.., diff) per key.

    Zero differences are dropped and mid-ranks are used for equal magnitudes.
    """
    size = F.abs("diff")
    cells = (
        values.where(F.col("diff") != 0)
        .groupBy(*keys, F.round(size, 12).alias("size"))
        .agg(
            F.count(F.when(F.col("diff") > 0, 1)).alias("np"),
            F.count(F.when(F.col("diff") < 0, 1)).alias("nn"),
        )
        .withColumn("n", F.col("np") + F.col("nn"))
    )
    ranked = along(cells, keys, ["size"]).running_sum(F.col("n"), "_upto").frame()
    rank = F.col("_upto") - (F.col("n") - 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("np") * rank).alias("w_plus"),
        F.sum(F.col("nn") * rank).alias("w_minus"),
        F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"),
    )
    zeros = values.groupBy(*keys).agg(F.count(F.when(F.col("diff") == 0, 1)).alias("zeros"))
    return zeros.join(sums, list(keys), "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        "zeros",
        F.least("w_plus", "w_minus").alias("w"),
        F.coalesce("ties", F.lit(0.0)).alias("ties"),
    )


@lru_cache(maxsize=64)
def _signed_rank_cdf(n: int) -> np.ndarray:
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] = counts[rank:] + counts[:-rank].copy()
    return np.cumsum(counts / counts.sum())


def signed_rank_p(w: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided p: exact for few pairs without ties or zeros, else normal."""
    if n == 0 or w is None or math.isnan(w):
        return math.nan
    if n <= EXACT_SIGNED and ties == 0 and zeros == 0:
        return min(1.0, 2.0 * float(_signed_rank_cdf(n)[int(w)]))
    mean = n * (n + 1) / 4.0
    spread = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if spread <= 0:
        return 1.0
    return min(1.0, math.erfc(abs(w - mean) / math.sqrt(2.0 * spread)))


def with_signed_rank_p(stats: DataFrame) -> DataFrame:
    """Add `p_value` to `signed_rank` rows."""

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if pd.isna(a) else signed_rank_p(a, int(b), c, int(d))
                for a, b, c, d in zip(w, n, ties, zeros)
            ],
            dtype="float64",
        )

    p = p_value("w", "n", "ties", "zeros")
    return stats.withColumn("p_value", F.when(F.col("w").isNotNull(), p))


def paired_differences(
    runs: DataFrame, key: str, order: str, value: str, keys: Sequence[str]
) -> DataFrame:
    """Differences of all pairs among a few named series, matched on `order`.

    Series of unequal length, or a run missing on one side, are an error.
    """
    lengths = {
        r[key]: r["n"]
        for r in runs.where(F.col(key).isin(*keys)).groupBy(key).agg(F.count("*").alias("n")).collect()
    }
    if len(set(lengths.values())) > 1 or len(lengths) < len(set(keys)):
        raise ValueError(f"series of unequal length: {lengths}")
    named = runs.where(F.col(key).isin(*keys)).select(key, order, value)
    left = named.select(F.col(key).alias("left"), order, F.col(value).alias("_a"))
    right = named.select(F.col(key).alias("right"), order, F.col(value).alias("_b"))
    pairs = left.join(right, order).where(F.col("left") < F.col("right"))
    return pairs.select("left", "right", order, (F.col("_a") - F.col("_b")).alias("diff"))
