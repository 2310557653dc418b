"""Null distributions: metric series, best rows, empirical p-values, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import safe_divide

METRICS = ("silhouette", "cliffs_delta_mean", "normalized_mean_difference")
TAILS = ("right", "left", "two-sided")


def null_metric(name: str) -> Column:
    """A separation metric over the columns of a statistics row."""
    if name == "silhouette":
        return F.col("silhouette_overall_mean")
    if name == "cliffs_delta_mean":
        return (
            F.col("mw_ai_human_vs_ai_ai_cliffs_delta")
            + F.col("mw_ai_human_vs_human_human_cliffs_delta")
        ) / 2
    if name == "normalized_mean_difference":
        within = (F.col("ai_ai_mean") + F.col("human_human_mean")) / 2
        across = F.col("ai_human_mean")
        return safe_divide(across - within, across + within)
    raise ValueError(f"unknown metric {name!r}; known: {METRICS}")


def metric_series(
    stats: DataFrame, keys: Sequence[str], name: str = "separation"
) -> DataFrame:
    """All metrics in long form."""
    cells = F.array(
        *[F.struct(F.lit(m).alias(name), null_metric(m).alias("value")) for m in METRICS]
    )
    return stats.select(*keys, F.inline(cells))


def best_rows(series: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The largest value per key, the first in `order` among equals; NULLs are skipped."""
    found = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    first = F.struct(F.col("value"), (-F.col(order)).alias("_early"))
    return found.groupBy(*keys).agg(
        F.max("value").alias("value"), F.max_by(order, first).alias(order)
    )


def mean_values(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean value per key, NULLs skipped."""
    return series.groupBy(*keys).agg(F.avg("value").alias("value"))


def empirical_p(
    nulls: DataFrame, observed: DataFrame, keys: Sequence[str], *, tail: str = "right"
) -> DataFrame:
    """(1 + values as extreme as the observed one) / (n + 1), per key.

    The smallest p the design can reach is 1 / (n + 1); it is reported as `floor`. Several
    observed values of a key get a row each.
    """
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}, got {tail!r}")
    keys = list(keys)
    seen = observed.select(*keys, F.col("value").alias("observed"))
    values = nulls.where(F.col("value").isNotNull())
    both = values.join(seen, keys) if keys else values.join(F.broadcast(seen))
    if tail == "two-sided":
        mean = values.groupBy(*keys).agg(F.avg("value").alias("mean"))
        both = both.join(mean, keys) if keys else both.join(F.broadcast(mean))
        hit = F.abs(F.col("value") - F.col("mean")) >= F.abs(F.col("observed") - F.col("mean"))
    elif tail == "left":
        hit = F.col("value") <= F.col("observed")
    else:
        hit = F.col("value") >= F.col("observed")
    return both.groupBy(*keys, "observed").agg(
        F.count("*").alias("n_null"),
        ((1 + F.count_if(hit)) / (F.count("*") + 1)).alias("p_value"),
        (1 / (F.count("*") + 1)).alias("floor"),
    )


def null_summary(nulls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, standard deviation (0 for one value), minimum, median and maximum."""
    v = F.col("value")
    return nulls.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"),
        F.median(v).alias("median"),
        F.max(v).alias("max"),
    )
