"""Audit events: bundles, interactive commands, time clusters, field distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import fields, timestamps
from loomtrace.plans.ordered import along

EVENT = ("ts", "serial")


def with_event_id(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines with their event (ts, serial); lines without one are skipped."""
    stamped = lines.withColumns(
        {
            "ts": timestamps.audit_epoch(F.col(text)),
            "serial": timestamps.audit_serial(F.col(text)),
        }
    )
    return stamped.where(F.col("ts").isNotNull() & F.col("serial").isNotNull())


def _mentions(line: Column, cmd: str) -> Column:
    """An EXECVE line whose a0 is the command, with or without a folder."""
    a0 = fields.context_field(line, "a0")
    hit = line.startswith("type=EXECVE") & ((a0 == cmd) | (fields.base_name(a0) == cmd))
    return F.coalesce(hit, F.lit(False))


def bundles(
    lines: DataFrame, *, actor: str = "actor", command: str | None = None, text: str = "text"
) -> DataFrame:
    """One row per event: line count, EXECVE flag, and the first SYSCALL line's context.

    Lines are folded into flags while grouping, so an event with very many lines needs
    no more room than any other. With `command`, `matched` says whether the event runs it.
    """
    line = F.col(text)
    syscall = F.min_by(
        F.when(line.contains("type=SYSCALL"), line),
        F.when(line.contains("type=SYSCALL"), F.col("line_no")),
    )
    name = None if command is None else command.rsplit("/", 1)[-1]
    ran = F.lit(False) if name is None else F.bool_or(_mentions(line, name))
    grouped = (
        with_event_id(lines, text)
        .groupBy(actor, *EVENT)
        .agg(
            F.count("*").alias("n_lines"),
            F.bool_or(line.contains("type=EXECVE")).alias("has_execve"),
            syscall.alias("_syscall"),
            ran.alias("_ran"),
        )
    )
    context = {k: fields.context_field(F.col("_syscall"), k) for k in ("tty", "exe", "comm")}
    named = grouped.withColumns(context)
    matched = F.lit(False)
    if name is not None:
        same = (F.col("comm") == name) | (fields.base_name(F.col("exe")) == name)
        matched = F.coalesce(same, F.lit(False)) | F.col("_ran")
    return named.withColumn("matched", matched).drop("_syscall", "_ran")


def bundle_lines(lines: DataFrame, *, actor: str = "actor", text: str = "text") -> DataFrame:
    """Lines with their event and their place in it, in file order."""
    stamped = with_event_id(lines, text)
    return along(stamped, [actor, *EVENT], ["line_no"]).positions("place").frame()


def interactive(events: DataFrame) -> DataFrame:
    """Events that run a command on a terminal."""
    return events.where(
        F.col("has_execve") & F.col("tty").isNotNull() & (F.col("tty") != "(none)")
    )


def clustered(
    events: DataFrame, *, window: float = 0.5, actor: str = "actor"
) -> DataFrame:
    """Events with a cluster number: a gap above `window` seconds starts a new cluster."""
    seen = along(events, [actor], list(EVENT)).previous({"_before": "ts"})
    fresh = F.col("_before").isNull() | (F.col("ts") - F.col("_before") > window)
    numbered = seen.running_sum(fresh.cast("long"), "cluster")
    return numbered.frame().drop("_before")


def clusters(
    events: DataFrame, *, window: float = 0.5, actor: str = "actor"
) -> DataFrame:
    """One row per cluster: start, events, and whether one of them matched."""
    return (
        clustered(events, window=window, actor=actor)
        .groupBy(actor, "cluster")
        .agg(
            F.min("ts").alias("start"),
            F.count("*").alias("n_events"),
            F.bool_or("matched").alias("matched"),
        )
    )


def cluster_deltas(found: DataFrame, *, actor: str = "actor") -> DataFrame:
    """Seconds from one cluster start to the next; `after_match` marks a matched start."""
    seen = along(found, [actor], ["cluster"]).previous(
        {"_before": "start", "after_match": "matched"}
    )
    return seen.frame().where(F.col("_before").isNotNull()).select(
        actor, "cluster", (F.col("start") - F.col("_before")).alias("delta"), "after_match"
    )


def timing_summary(
    events: DataFrame, *, window: float = 0.5, actor: str = "actor"
) -> DataFrame:
    """Total and kept events and clusters per actor."""
    kept = interactive(events)
    counts = events.groupBy(actor).agg(F.count("*").alias("total_bundles"))
    few = clusters(kept, window=window, actor=actor).groupBy(actor).agg(
        F.sum("n_events").alias("kept_bundles"), F.count("*").alias("num_clusters")
    )
    return counts.join(few, actor, "left").na.fill(0, ["kept_bundles", "num_clusters"])


def log_histogram(
    values: DataFrame, *, value: str = "delta", actor: str = "actor", edges: int = 50
) -> DataFrame:
    """Density of positive values per actor over shared log-spaced bins.

    `edges` borders make `edges - 1` bins from the smallest to the largest value of all
    actors; a single distinct value is widened to 0.9 and 1.1 times itself.
    """
    v = F.col(value)
    finite = values.where((v > 0) & ~F.isnan(v) & (v < float("inf")))
    span = finite.agg(F.min(v).alias("_min"), F.max(v).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    span = span.select(
        F.when(flat, F.greatest(F.col("_min") * 0.9, F.lit(1e-12))).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") * 1.1).otherwise(F.col("_max")).alias("_hi"),
    )
    bins = edges - 1
    low = F.log10("_lo")
    step = (F.log10("_hi") - low) / bins
    number = F.least(F.floor((F.log10(v) - low) / step), F.lit(bins - 1))
    counts = (
        finite.join(F.broadcast(span))
        .groupBy(actor, F.greatest(number, F.lit(0)).alias("bin"), "_lo", "_hi")
        .agg(F.count("*").alias("n"))
    )
    total = counts.groupBy(actor).agg(F.sum("n").alias("_n"))
    left = F.pow(F.lit(10.0), low + step * F.col("bin"))
    right = F.pow(F.lit(10.0), low + step * (F.col("bin") + 1))
    return counts.join(total, actor).select(
        actor,
        "bin",
        left.alias("left"),
        right.alias("right"),
        "n",
        (F.col("n") / (F.col("_n") * (right - left))).alias("density"),
    )


# ---- field distributions ----


def audit_rows(
    lines: DataFrame,
    pattern: str,
    keys: Sequence[str],
    *,
    require_all: bool = False,
    ignore_case: bool = False,
    strip_quotes: bool = True,
    keep: Sequence[str] = ("actor", "line_no"),
    text: str = "text",
) -> DataFrame:
    """One column per key for the lines that match `pattern`; an absent key is NULL.

    Columns that nobody reads are pruned together with their regular expressions.
    """
    found = fields.field_columns(
        F.col(text), keys, ignore_case=ignore_case, strip_quotes=strip_quotes
    )
    rows = lines.where(F.col(text).rlike(pattern)).select(
        *keep, *[value.alias(key) for key, value in found.items()]
    )
    return rows.dropna(subset=list(keys)) if require_all else rows


def value_counts(
    rows: DataFrame, target: str, *, given: tuple[str, str] | None = None, actor: str = "actor"
) -> DataFrame:
    """Counts of a field's values, optionally of rows with another field's value."""
    chosen = rows if given is None else rows.where(F.col(given[0]) == given[1])
    counted = chosen.groupBy(actor, F.col(target).alias("item")).agg(F.count("*").alias("cnt"))
    return counted.where(F.col("item").isNotNull())


def pair_counts(rows: DataFrame, key_1: str, key_2: str, *, actor: str = "actor") -> DataFrame:
    """Counts of value pairs of the rows that have both fields."""
    pair = F.concat(F.col(key_1), F.lit(" | "), F.col(key_2))
    counted = rows.groupBy(actor, pair.alias("item")).agg(F.count("*").alias("cnt"))
    return counted.where(F.col("item").isNotNull())


def presence_patterns(
    rows: DataFrame, keys: Sequence[str], *, actor: str = "actor"
) -> DataFrame:
    """Which of the keys occur together, in the given key order; none is a pattern too."""
    present = F.concat_ws(" | ", *[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])
    return rows.groupBy(actor, present.alias("item")).agg(F.count("*").alias("cnt"))


def distribution(counts: DataFrame, *, actor: str = "actor") -> DataFrame:
    """Counts with each item's share of its actor."""
    total = counts.groupBy(actor).agg(F.sum("cnt").alias("_n"))
    return counts.join(total, actor).select(
        *counts.columns, (F.col("cnt") / F.col("_n")).alias("prob")
    )


def top_items(counts: DataFrame, k: int, *, actor: str = "actor") -> DataFrame:
    """The k most frequent items over all actors, with a row for every actor."""
    vocabulary = (
        counts.groupBy("item")
        .agg(F.sum("cnt").alias("_total"))
        .orderBy(F.col("_total").desc(), "item")
        .limit(k)
        .select("item")
    )
    shares = distribution(counts, actor=actor)
    listed = F.broadcast(vocabulary.agg(F.collect_list("item").alias("_items")))
    grid = counts.select(actor).distinct().join(listed).select(actor, F.explode("_items").alias("item"))
    filled = grid.join(shares, [actor, "item"], "left")
    return filled.na.fill(0, ["cnt"]).na.fill(0.0, ["prob"])
