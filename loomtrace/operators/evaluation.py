"""Classifier scores from predictions, for any number of runs in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(
    predictions: DataFrame,
    keys: Sequence[str] = ("run_id", "part"),
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Counts of (truth, prediction); with `labels` the whole grid, zeros included."""
    counts = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    names = F.array(*[F.lit(x) for x in sorted(labels)])
    grid = (
        counts.select(*keys)
        .distinct()
        .withColumn("y_true", F.explode(names))
        .withColumn("y_pred", F.explode(names))
    )
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def per_class(
    cells: DataFrame, keys: Sequence[str] = ("run_id", "part")
) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs."""
    ends = F.array(
        F.struct(
            F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    sums = (
        cells.select(*keys, F.inline(ends))
        .groupBy(*keys, "label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    )
    return sums.select(
        *keys,
        "label",
        "support",
        "predicted",
        "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where it is undefined."""
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


def scores(
    predictions: DataFrame, keys: Sequence[str] = ("run_id", "part")
) -> DataFrame:
    """Accuracy, balanced accuracy, MCC, Cohen's kappa and averaged P, R, F1 per key."""
    return scores_of_cells(confusion(predictions, keys), keys)


def scores_of_cells(cells: DataFrame, keys: Sequence[str] = ("run_id", "part")) -> DataFrame:
    """The same from counts (keys.., y_true, y_pred, n)."""
    classes = per_class(cells, keys)
    t, p = F.col("support"), F.col("predicted")
    n, hits = F.sum(t), F.sum("hits")
    tp, tt, pp = F.sum(t * p), F.sum(t * t), F.sum(p * p)
    top = hits * n - tp
    bottom = F.sqrt((n * n - pp).cast("double")) * F.sqrt((n * n - tt).cast("double"))
    expected = tp / (n * n)
    observed = hits / n
    averaged = []
    for name in ("precision", "recall", "f1"):
        averaged.append(F.avg(name).alias(f"{name}_macro"))
        averaged.append((F.sum(F.col(name) * t) / n).alias(f"{name}_weighted"))
    return classes.groupBy(*keys).agg(
        n.alias("n"),
        observed.alias("accuracy"),
        F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.when(bottom > 0, top / bottom).otherwise(0.0).alias("mcc"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).alias("cohen_kappa"),
        *averaged,
    )


SORTS = ("f1_macro", "f1_weighted", "accuracy")


def leaderboard(
    scored: DataFrame, *, sort_by: str = "f1_macro", top_k: int = 10, run: str = "run_id"
) -> DataFrame:
    """The best runs by one score."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}, got {sort_by!r}")
    ordered = scored.select(run, *SORTS).orderBy(F.col(sort_by).desc(), run)
    return ordered.limit(top_k)


def run_summary(
    results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Mean, median and population deviation of test scores over outer splits."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    )
    long = results.select(*keys, F.inline(cells))
    good = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_pop("value").alias("std"),
    )


def majority_label(
    examples: DataFrame, keys: Sequence[str] = (), *, label: str = "label"
) -> DataFrame:
    """Most frequent training label; the first in sorted order among equals."""
    train = examples.where(F.col("part") == "train")
    counts = train.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), label)
    best = counts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1)
    return best.select(*keys, F.col(label).alias("y_pred"))
