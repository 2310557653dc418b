"""One-gram comparison of actors: counts, pair distances, class structure, nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.distributions import long_distances, pair_distances, token_counts
from loomtrace.operators.groupstats import (
    drop_incomplete,
    group_report,
    indexed_assignments,
    sampled_assignments,
    true_assignment,
)
from loomtrace.operators.nulls import empirical_p, metric_series
from loomtrace.session import anchor

MODES = ("word", "char")
METRICS = ("l1", "js")


def one_gram_distances(
    lines: DataFrame,
    *,
    modes: Sequence[str] = MODES,
    group: Sequence[str] = (),
    min_count: int = 1,
) -> DataFrame:
    """The whole sweep (group x mode x metric): (.., mode, actors, metric, distance).

    The text is read once for the counts of all modes, which are pinned; a mode in which
    an actor has no tokens still lists the actor.
    """
    keys = [*group, "actor"]
    counts = None
    for mode in modes:
        one = token_counts(lines, mode, keys).withColumn("mode", F.lit(mode))
        counts = one if counts is None else counts.unionByName(one)
    names = F.array(*[F.lit(m) for m in modes])
    listed = lines.select(*keys).distinct().withColumn("mode", F.explode(names))
    pairs = pair_distances(anchor(counts), listed, [*group, "mode"], min_count=min_count)
    return long_distances(pairs, METRICS)


def observed_report(
    distances: DataFrame, keys: Sequence[str], actors: DataFrame, *, marker: str = "GPT"
) -> DataFrame:
    """Statistics rows for the observed labels."""
    complete = drop_incomplete(anchor(distances), keys)
    return group_report(complete, true_assignment(actors, marker), keys)


def null_report(
    distances: DataFrame,
    keys: Sequence[str],
    actors: DataFrame,
    *,
    marker: str = "GPT",
    sample: int | None = None,
    seed: int = 42,
    p_values: bool = True,
) -> DataFrame:
    """Statistics rows for every null labeling, or for `sample` random ones."""
    if sample is None:
        assignments = indexed_assignments(actors, marker=marker)
    else:
        assignments = sampled_assignments(actors, sample, marker=marker, seed=seed)
    complete = drop_incomplete(anchor(distances), keys)
    return group_report(complete, assignments, keys, p_values=p_values)


def null_significance(
    observed: DataFrame, nulls: DataFrame, keys: Sequence[str], *, tail: str = "right"
) -> DataFrame:
    """Empirical p of every separation metric of every configuration."""
    got = metric_series(observed, keys, name="separation")
    null = metric_series(nulls, keys, name="separation")
    return empirical_p(null, got, [*keys, "separation"], tail=tail)
