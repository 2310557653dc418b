"""Text-file scans with line numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import is_blank
from loomtrace.sources.catalog import log_type_of_file


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    max_lines: int | None = None,
    drop_blank: bool = True,
) -> DataFrame:
    """Lines of log files as (path, actor, log_type, line_no, text).

    Files may be split over many tasks, so a number is made of the place inside one
    file block plus the lines of the blocks before it. A task holds one block, never
    one file. `max_lines` keeps the first lines of every file, counted before blank
    lines are dropped. Bytes that are not UTF-8 become U+FFFD.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    blocks = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
        F.make_valid_utf8("value").alias("text"),
    )
    inside = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_seen"))
    before = (
        Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        raw.groupBy(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .count()
        .select("path", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    )
    numbered = (
        blocks.withColumn("_in", inside)
        .join(offsets, ["path", "_block"])
        .select(
            "path",
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("actor"),
            log_type_of_file(F.substring_index("path", "/", -1)).alias("log_type"),
            (F.col("_in") + F.col("_off")).cast("long").alias("line_no"),
            F.regexp_replace("text", r"^[\r\n]+|[\r\n]+$", "").alias("text"),
        )
    )
    if max_lines is not None:
        numbered = numbered.where(F.col("line_no") <= max_lines)
    if drop_blank:
        numbered = numbered.where(~is_blank(F.col("text")))
    return numbered
