"""Windows over positions: lines, template ids, gaps and text bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import general_format, normalize_bundle
from loomtrace.plans.ordered import along


def _check(size: int, stride: int) -> None:
    if size <= 0:
        raise ValueError("window size must be > 0")
    if stride <= 0:
        raise ValueError("window stride must be > 0")


def _starts(pos: Column, size: Column, stride: Column) -> Column:
    """Numbers of the windows that hold a position; empty where strides leave gaps."""
    low = F.greatest(F.ceil((pos - size + 1) / stride), F.lit(0)).cast("long")
    high = F.floor(pos / stride).cast("long")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def windows(
    positioned: DataFrame,
    keys: Sequence[str],
    item: str,
    *,
    size: int,
    stride: int | None = None,
    drop_last: bool = True,
    anchor: str | None = None,
    pos: str = "pos",
    tasks: int | None = None,
) -> DataFrame:
    """Windows of `size` consecutive items, as (keys.., window, n, items[, anchor]).

    Window w covers positions w * stride up to w * stride + size - 1. Without
    `drop_last` every remaining start gives one shorter window.
    """
    stride = size if stride is None else stride
    _check(size, stride)
    return swept_windows(
        positioned, keys, item, [(size, stride)], drop_last=drop_last, anchor=anchor, pos=pos, tasks=tasks
    ).drop("size", "stride")


def swept_windows(
    positioned: DataFrame,
    keys: Sequence[str],
    item: str,
    settings: Sequence[tuple[int, int]],
    *,
    drop_last: bool = True,
    anchor: str | None = None,
    pos: str = "pos",
    tasks: int | None = None,
) -> DataFrame:
    """Windows for several (size, stride) settings in one pass over the positions.

    `tasks` sets how many tasks gather the items; without it the session's partitions do.
    """
    for size, stride in settings:
        _check(size, stride)
    listed = F.array(
        *[
            F.struct(F.lit(s).cast("long").alias("size"), F.lit(t).cast("long").alias("stride"))
            for s, t in settings
        ]
    )
    extra = [] if anchor is None else [F.col(anchor).alias("_anchor")]
    cells = positioned.select(
        *keys, F.col(pos).alias("_pos"), F.col(item).alias("_item"), *extra, F.inline(listed)
    )
    placed = cells.withColumn(
        "window", F.explode(_starts(F.col("_pos"), F.col("size"), F.col("stride")))
    )
    if tasks is not None:
        # an item comes in few windows, so gathering before the shuffle would save nothing
        placed = placed.repartition(tasks, *keys, "size", "stride", "window")
    aggregates = [
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_cells"),
    ]
    if anchor is not None:
        aggregates.append(F.min_by("_anchor", "_pos").alias("anchor"))
    grouped = placed.groupBy(*keys, "size", "stride", "window").agg(*aggregates)
    if drop_last:
        grouped = grouped.where(F.col("n") == F.col("size"))
    items = F.transform("_cells", lambda c: c["_item"]).alias("items")
    tail = [] if anchor is None else ["anchor"]
    return grouped.select(*keys, "size", "stride", "window", "n", items, *tail)


def line_windows(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    size: int,
    stride: int | None = None,
    drop_last: bool = True,
    join_token: str = " <EOL> ",
    text: str = "text",
    anchor: str = "line_no",
    tasks: int | None = None,
    shown: Column | None = None,
) -> DataFrame:
    """Texts of consecutive lines joined; `anchor` is the first line's number.

    `shown` is made of a line in place of its text, after the lines are laid in order:
    laying them reads them twice.
    """
    placed = along(lines, keys, order, ranges=tasks).positions().frame()
    if shown is not None:
        placed = placed.withColumn(text, shown)
    cut = windows(
        placed, keys, text, size=size, stride=stride, drop_last=drop_last, anchor=anchor, tasks=tasks
    )
    return cut.select(
        *keys, "window", F.col("anchor").alias(anchor), "n",
        F.array_join("items", join_token).alias("text"),
    )


def merged_lines(
    lines: DataFrame, *, actor: str = "actor", file: str = "path", line: str = "line_no", time: str = "ts"
) -> DataFrame:
    """Lines with `as_of`, by which the files of an actor merge: their own time or the last one known.

    A line without a time happened when the last line of its file that has one did; lines
    before a file's first time have none and come first.
    """
    return along(lines, [actor, file], [line]).last_known(time, "as_of").frame()


def cross_file_windows(
    lines: DataFrame,
    *,
    size: int,
    stride: int | None = None,
    drop_last: bool = True,
    join_token: str = " <EOL> ",
    text: str = "text",
    actor: str = "actor",
    file: str = "path",
    line: str = "line_no",
    time: str = "ts",
) -> DataFrame:
    """Windows over all files of an actor at once, in the order of (time, file, line).

    (actor, window, file, line_no, n, text): file and line are those of the first line.
    """
    merged = merged_lines(lines, actor=actor, file=file, line=line, time=time)
    merged = merged.withColumn("_first", F.struct(F.col(file).alias("file"), F.col(line).alias("line_no")))
    cut = line_windows(
        merged, [actor], ["as_of", file, line], size=size, stride=stride, drop_last=drop_last,
        join_token=join_token, text=text, anchor="_first",
    )
    return cut.select(actor, "window", "_first.file", "_first.line_no", "n", "text")


def id_windows(
    ids: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    size: int,
    stride: int | None = None,
    drop_last: bool = True,
    prefix: str = "CID",
    cid: str = "cid",
    anchor: str = "line_no",
) -> DataFrame:
    """Template ids of consecutive lines, printed `CID4 CID9 ..`."""
    printed = ids.withColumn("_id", F.concat(F.lit(prefix), F.col(cid).cast("string")))
    return line_windows(
        printed, keys, order, size=size, stride=stride, drop_last=drop_last,
        join_token=" ", text="_id", anchor=anchor,
    )


def gap_windows(
    gaps: DataFrame,
    keys: Sequence[str],
    *,
    size: int,
    stride: int | None = None,
    drop_last: bool = True,
    value: str = "gap",
    pos: str = "gap_pos",
    tasks: int | None = None,
) -> DataFrame:
    """Windows over inter-event gaps, as numbers and as space-separated text."""
    cut = windows(gaps, keys, value, size=size, stride=stride, drop_last=drop_last, pos=pos, tasks=tasks)
    text = F.array_join(F.transform("items", lambda v: general_format(v, 6)), " ")
    return cut.select(*keys, "window", "n", F.col("items").alias("gaps"), text.alias("text"))


STRATEGIES = ("fixed", "sliding")


def bundle_texts(
    texts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    size: int,
    stride: int = 1,
    strategy: str = "fixed",
    drop_last: bool = False,
    text: str = "text",
) -> DataFrame:
    """Consecutive texts of one class joined by line ends; empty bundles are dropped.

    `fixed` bundles do not overlap. `sliding` ones are always whole, except that a
    class shorter than `size` gives one short bundle unless `drop_last`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    placed = along(texts, keys, order).positions().frame()
    step = size if strategy == "fixed" else max(1, stride)
    cut = windows(placed, keys, text, size=size, stride=step, drop_last=False)
    if drop_last or strategy == "sliding":
        whole = F.col("n") == size
        if strategy == "sliding" and not drop_last:
            counts = texts.groupBy(*keys).agg(F.count("*").alias("_total"))
            cut = cut.join(F.broadcast(counts), list(keys))  # one row per class
            whole = whole | ((F.col("_total") < size) & (F.col("window") == 0))
        cut = cut.where(whole)
    bundled = cut.select(
        *keys, "window", "n", normalize_bundle(F.array_join("items", "\n")).alias("text")
    )
    return bundled.where(F.col("text") != "")
