"""Positions, neighbours and running sums along an order, per key.

A plain window puts every row of a key into one task, which is a dead end once one actor
holds a third of the data. So rows are always range-partitioned on (keys, order), which
balances whatever the skew, and the layout is pinned by one checkpoint. Windows run
inside a range; what a range takes over from earlier ones concerns only the first key in
it, so it is one row per range at most, and that is broadcast. NULL keys are keys like
others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import anchor

RANGE = "_range"


@dataclass(frozen=True)
class Along:
    """A pinned frame in ranges of a total order per key."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    ranges: int | None = None

    def _dealt(self) -> Along:
        """Ranges brought to as many tasks as there are of them, once for all windows that follow.

        Left to itself a shuffle is coalesced to as many tasks as cores, however many rows there are.
        """
        if self.ranges is None:
            return self
        return replace(self, df=self.df.repartition(self.ranges, RANGE), ranges=None)

    def _window(self):
        return Window.partitionBy(RANGE, *self.keys).orderBy(*self.order)

    def _with_earlier(self, df: DataFrame, summary: DataFrame, value: Column, name: str) -> DataFrame:
        """Add what the earlier ranges of a row's key give, NULL for a key's first range.

        `summary` has a row per (range, key); `value` is a window expression over them. A
        range shares no key but its first with earlier ranges, so few rows are left.
        """
        seen = Window.partitionBy(*self.keys).orderBy(RANGE)
        carried = summary.select(
            F.col(RANGE).alias("_r"),
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            value.alias(name),
            F.row_number().over(seen).alias("_nth"),
        )
        carried = carried.where(F.col("_nth") > 1).drop("_nth")
        same = F.col(RANGE) == F.col("_r")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = df.join(F.broadcast(carried), same, "left")
        return joined.drop("_r", *[f"_k_{k}" for k in self.keys])

    def running_sum(self, value: Column, name: str) -> Along:
        """Inclusive running sum of a numeric expression."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = self.df.groupBy(RANGE, *self.keys).agg(F.sum(value).alias("_total"))
        earlier = Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        dealt = self._dealt()
        out = dealt.df.withColumn("_value", value).withColumn(name, F.sum("_value").over(upto))
        out = self._with_earlier(out, sums, F.sum("_total").over(earlier), "_carry")
        out = out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0)))
        return replace(dealt, df=out.drop("_value", "_carry"))

    def positions(self, name: str = "pos") -> Along:
        """Zero-based position within the key."""
        counted = self.running_sum(F.lit(1).cast("long"), name)
        return replace(counted, df=counted.df.withColumn(name, F.col(name) - 1))

    def previous(self, columns: dict[str, str]) -> Along:
        """Add the preceding row's values, as {new name: column}; NULL at the start."""
        row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        last = self.df.groupBy(RANGE, *self.keys).agg(F.max_by(row, F.struct(*self.order)).alias("_last"))
        before = Window.partitionBy(*self.keys).orderBy(RANGE)
        dealt = self._dealt()
        lagged = dealt.df.withColumn("_row", row).withColumn("_prev", F.lag("_row").over(self._window()))
        lagged = self._with_earlier(lagged, last, F.lag("_last").over(before), "_edge")
        lagged = lagged.withColumn("_prev", F.coalesce("_prev", "_edge"))
        added = lagged.select(
            *self.df.columns, *[F.col(f"_prev.{n}").alias(n) for n in columns]
        )
        return replace(dealt, df=added)

    def last_known(self, column: str, name: str) -> Along:
        """Add the last value of a column that is not NULL, up to this row; NULL before any."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = F.when(F.col(column).isNotNull(), F.struct(*self.order))
        last = self.df.groupBy(RANGE, *self.keys).agg(F.max_by(column, place).alias("_last"))
        earlier = Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        dealt = self._dealt()
        out = dealt.df.withColumn(name, F.last(column, ignorenulls=True).over(upto))
        out = self._with_earlier(out, last, F.last("_last", ignorenulls=True).over(earlier), "_carry")
        out = out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
        return replace(dealt, df=out)

    def frame(self) -> DataFrame:
        return self.df.drop(RANGE)


def along(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, ranges: int | None = None
) -> Along:
    """Lay a frame out for ordered work; `order` must be total within a key and ascending.

    `ranges` sets how many ranges, and tasks on them, are made; without it the session's
    partitions do.
    """
    columns = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    by = [*[F.col(k) for k in keys], *columns]
    laid = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    pinned = anchor(laid.withColumn(RANGE, F.spark_partition_id()))
    return Along(pinned, tuple(keys), columns, ranges)
