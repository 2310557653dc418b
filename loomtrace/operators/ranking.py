"""Ranking of configurations and of result series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import safe_divide
from loomtrace.plans.ordered import along
from loomtrace.session import anchor

CORE = ("normalized_mean_separation", "silhouette_overall", "cliffs_delta_mean")
WEIGHTS = (0.2, 0.3, 0.5)  # fixed values: weights of the three core scores
DIGITS = 12


def finite(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def derived_scores(stats: DataFrame) -> DataFrame:
    """Separation, silhouette and effect-size scores beside the statistics."""
    within = F.greatest("ai_ai_mean", "human_human_mean")
    means = F.col("ai_ai_mean").isNotNull() & F.col("human_human_mean").isNotNull()
    separation = F.when(means, F.col("ai_human_mean") - within)
    one = F.col("mw_ai_human_vs_ai_ai_cliffs_delta")
    two = F.col("mw_ai_human_vs_human_human_cliffs_delta")
    both = one.isNotNull() & two.isNotNull()
    return stats.withColumns(
        {
            "mean_separation": separation,
            "normalized_mean_separation": safe_divide(separation, within),
            "silhouette_overall": F.col("silhouette_overall_mean"),
            "cliffs_delta_mean": (one + two) / 2,
            "cliffs_delta_min": F.when(both, F.least(one, two)),
        }
    )


def hard_filter(
    stats: DataFrame, *, significant: bool = False, alpha: float = 0.05
) -> DataFrame:
    """Rows whose classes are apart by every measure; undefined values fail."""
    apart = (
        (F.col("ai_human_mean") > F.col("ai_ai_mean"))
        & (F.col("ai_human_mean") > F.col("human_human_mean"))
        & (F.col("silhouette_overall_mean") > 0)
        & (F.col("mw_ai_human_vs_ai_ai_cliffs_delta") > 0)
        & (F.col("mw_ai_human_vs_human_human_cliffs_delta") > 0)
    )
    for name in ("ai_ai_mean", "human_human_mean", "ai_human_mean", "silhouette_overall_mean"):
        apart = apart & finite(name)
    if significant:
        for test in ("ai_ai", "human_human"):
            p = f"mw_ai_human_vs_{test}_p"
            apart = apart & finite(p) & (F.col(p) < alpha)
    return stats.where(apart)


def drop_duplicates(
    scored: DataFrame, order: Sequence[str], *, digits: int = DIGITS
) -> DataFrame:
    """First row in `order` of every rounded score triple; undefined equals undefined."""
    rounded = [F.round(F.when(finite(c), F.col(c)), digits) for c in CORE]
    cell = F.struct(*order).alias("_order")
    rows = scored.withColumns({f"_k{i}": r for i, r in enumerate(rounded)}).withColumn("_order", cell)
    keys = [f"_k{i}" for i in range(len(CORE))]
    picked = F.min_by(F.struct(*scored.columns), "_order").alias("_row")
    return rows.groupBy(*keys).agg(picked).select("_row.*")


def min_max(rows: DataFrame, columns: Sequence[str] = CORE) -> DataFrame:
    """Scores scaled to 0..1 over all rows; equal scores become 1, undefined stay so."""
    clean = {c: F.when(finite(c), F.col(c)) for c in columns}
    span = rows.agg(
        *[F.min(clean[c]).alias(f"_lo_{c}") for c in columns],
        *[F.max(clean[c]).alias(f"_hi_{c}") for c in columns],
    )
    joined = rows.join(F.broadcast(span))
    out = {}
    for c in columns:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = F.when(high == low, 1.0).otherwise((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))
        out[f"{c}_norm"] = F.when(finite(c), scaled)
    return joined.withColumns(out).select(*rows.columns, *out)


def competition_ranks(rows: DataFrame, columns: Sequence[str] = CORE) -> DataFrame:
    """Descending ranks; equal scores share one, the next distinct score skips ahead.

    Ranks come from the counts per distinct score, so only those are ordered together.
    """
    out = rows
    for c in columns:
        value = F.round(F.col(c), DIGITS)
        counts = rows.where(finite(c)).groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))
        laid = along(counts.withColumn("_down", -F.col("_v")), [], ["_down"])
        upto = laid.running_sum(F.col("_n"), "_upto").frame()
        ranks = upto.select("_v", (F.col("_upto") - F.col("_n") + 1).cast("double").alias(f"{c}_rank"))
        out = out.withColumn("_v", value).join(ranks, "_v", "left").drop("_v")
    return out


def _weighted(suffix: str) -> Column:
    total = F.lit(0.0)
    for c, w in zip(CORE, WEIGHTS):
        total = total + w * F.col(f"{c}_{suffix}")
    return total


def composite(rows: DataFrame) -> DataFrame:
    """Weighted sum of scaled scores and weighted mean rank (lower is better).

    The rows are read once per score and again for the spans, so they are pinned first.
    """
    ranked = competition_ranks(min_max(anchor(rows)))
    return ranked.withColumns(
        {"composite_score": _weighted("norm"), "rank_aggregate_score": _weighted("rank")}
    )


def top_rows(
    rows: DataFrame, score: str, k: int, *, order: Sequence[str], ascending: bool = False
) -> DataFrame:
    """The k best rows with a defined score."""
    by = F.round(F.col(score), DIGITS)
    return rows.where(finite(score)).orderBy(by.asc() if ascending else by.desc(), *order).limit(k)


def rank_series(
    results: DataFrame, key: str, metric: str, *, ascending: bool = False
) -> DataFrame:
    """Result series by their mean metric, with a position."""
    means = results.where(finite(metric)).groupBy(key).agg(
        F.avg(metric).alias("mean"), F.count("*").alias("n")
    )
    by = F.round("mean", DIGITS)
    laid = along(means.withColumn("_by", by if ascending else -by), [], ["_by", key])
    placed = laid.positions("position").frame().drop("_by")
    return placed.withColumn("position", F.col("position") + 1)


def series_quartiles(results: DataFrame, key: str, metric: str) -> DataFrame:
    """The numbers behind a box plot of every series."""
    quartiles = F.percentile(F.col(metric), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = results.where(finite(metric)).groupBy(key).agg(
        F.count("*").alias("n"),
        F.min(metric).alias("min"),
        quartiles.alias("_q"),
        F.max(metric).alias("max"),
        F.avg(metric).alias("mean"),
    )
    named = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return rows.select(key, "n", "min", *named, "max", "mean")


def best_result(
    results: DataFrame, metric: str, *, order: str = "outer_i", largest: bool = True
) -> DataFrame:
    """The result row with the best metric, the first in `order` among equals."""
    by = F.col(metric).desc() if largest else F.col(metric).asc()
    return results.where(finite(metric)).orderBy(by, order).limit(1)


def result_at(results: DataFrame, value: int, *, column: str = "outer_i") -> DataFrame:
    """The one result row of an outer split; none or several are an error."""
    rows = results.where(F.col(column) == value)
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row with {column} = {value}")
    return rows
