"""Session clusters and windowed counts over event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_clusters(
    events: DataFrame,
    *,
    gap: str = "500 milliseconds",
    delay: str = "10 minutes",
    keys: Sequence[str] = ("actor",),
    ts: str = "ts",
) -> DataFrame:
    """Bursts of events per key; a pause above `gap` ends one.

    Late rows are accepted for `delay`; a burst is emitted once it can no longer grow.
    """
    return _sessions(events.withWatermark(ts, delay), gap, keys, ts)


def _sessions(events: DataFrame, gap: str, keys: Sequence[str], ts: str) -> DataFrame:
    grouped = events.groupBy(*keys, F.session_window(F.col(ts), gap).alias("session"))
    return grouped.agg(
        F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n_events")
    ).drop("session")


def open_sessions(
    events: DataFrame,
    closed: DataFrame,
    *,
    gap: str = "500 milliseconds",
    keys: Sequence[str] = ("actor",),
    ts: str = "ts",
) -> DataFrame:
    """Bursts that a stopped stream has not emitted: rows after each key's last closed one."""
    ends = closed.groupBy(*keys).agg(F.max("last").alias("_last"))
    named = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_last")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = events.join(named, same, "left")
    late = joined.where(F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
    return _sessions(late.drop("_last", *[f"_k_{k}" for k in keys]), gap, keys, ts)


def windowed_counts(
    tokens: DataFrame,
    *,
    width: str = "1 hour",
    delay: str = "10 minutes",
    keys: Sequence[str] = ("actor", "token"),
    ts: str = "ts",
) -> DataFrame:
    """Counts per tumbling window and key; rows behind the watermark are dropped."""
    return _windows(tokens.withWatermark(ts, delay), width, keys, ts)


def open_windows(
    tokens: DataFrame,
    closed: DataFrame,
    *,
    width: str = "1 hour",
    keys: Sequence[str] = ("actor", "token"),
    ts: str = "ts",
) -> DataFrame:
    """Windows that a stopped stream has not emitted: rows after the last closed one."""
    last = closed.agg(F.max("end").alias("_end"))
    late = tokens.join(F.broadcast(last)).where(F.col("_end").isNull() | (F.col(ts) >= F.col("_end")))
    return _windows(late.drop("_end"), width, keys, ts)


def _windows(tokens: DataFrame, width: str, keys: Sequence[str], ts: str) -> DataFrame:
    counted = tokens.groupBy(F.window(F.col(ts), width).alias("span"), *keys)
    return counted.agg(F.count("*").alias("cnt")).select(
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "cnt"
    )
