"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; null counts as empty. SHA-256
digests stand for them. A Misra-Gries summary (Spark's freqItems) names every digest
that more than SUPPORT of the rows hold, and perhaps others; their exact counts and
winners are then verified by a grouped maximum, combined before the shuffle. The winners
are at most 1 / SUPPORT rows, so they are broadcast and settle their copies where these
are read. All other digests have few rows each and go through an ordinary shuffle. The
texts are read once; a table of ids and digests is pinned.

Of equal texts the row of the largest doc_id stays; a null doc_id only if there is no
other. Of rows that repeat this doc_id one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import anchor

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the rows beyond which a digest is sure to be handled as frequent.
SUPPORT = 1e-4


def lowered(text: Column) -> Column:
    """A-Z in lower case; lower() is the same, and faster, on texts without other scripts."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    digest = F.sha2(lowered(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    rows = anchor(docs.select("doc_id", digest.alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    frequent = rows.stat.freqItems(["text_sha256"], support)
    frequent = frequent.select(F.explode(F.col(frequent.columns[0])).alias("text_sha256"))
    best = F.max(F.struct("doc_id", "_row"))
    winners = rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size"))
    winners = F.broadcast(anchor(winners))
    settled = rows.join(winners, "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = rows.join(winners, "text_sha256", "left_anti").withColumn("_best", best.over(same)).withColumn("group_size", F.count("*").over(same))
    return settled.unionByName(rest).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256"
    )
