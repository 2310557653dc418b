"""Shards of equal row counts with linked documents together: balanced label propagation.

Links are (row, key) pairs: rows that share a key are neighbours. No pair of rows is ever
made; a key's rows are counted by label. Each round every linked row votes for the label
most of its neighbours have and asks to move there. Requests between two shards are
granted as far as they balance each other, and beyond that as far as the target has room
in its quota; rows win by a hash. Rounds stop when nothing moves.

Landing then gives exact sizes. Linked rows of a shard keep their order by label and key
up to the quota; what is over, and all rows without links, fill the free places from one
line, group after group. Keys of more rows than a shard takes have no votes; their rows
come first in this line and fill shard after shard. The counts of two shards differ by
one at most ("rows" is the law that holds).

Ranks come from a range partitioning on hashes, pinned, with one count per partition; no
window spans a shard. Sizes per shard and flows between shards are small: shards and
shards squared. Everything is columns and joins.

Rows with equal texts share a key. A null text has no key and size 8. Null and repeated
doc_ids are rows like others; rows equal in id and text are interchangeable. Fewer rows
than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import anchor

SHARDS, MOST_ROUNDS, OVERHEAD = 24, 6, 8
_UNIT = 1 << 20


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with nth: their place in this order, from 0."""
    laid = anchor(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = laid.withColumn("_spot", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_spot", 33)).withColumn("_at", F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn("nth", F.col("_before") + F.col("_at")).drop("_spot", "_part", "_at", "_before")


def _quota(rows: int, shards: int, shard: Column) -> Column:
    return F.lit(rows // shards) + (shard < rows % shards).cast("long")


def propagated(links: DataFrame, rows: int, shards: int, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(row, key, chance, label) after the rounds, from (row, key, chance).

    chance is a hash of the row that decides on its start and who wins a place; ``rows``
    counts all rows, linked or not, and sets the quotas.
    """
    state = anchor(links.withColumn("label", F.pmod("chance", F.lit(shards)).cast("int")))
    for turn in range(rounds):
        cells = state.groupBy("key", "label").agg(F.count("*").alias("n"))
        votes = state.select("row", "key").join(cells, "key").groupBy("row", "label").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
        wish = votes.groupBy("row").agg(F.max_by("label", F.struct("n", F.xxhash64("key", "label"))).alias("wish"))
        asked = anchor(state.join(wish, "row"))
        one_each = asked.groupBy("row").agg(F.first("label").alias("label"), F.first("wish").alias("wish"))
        flows = one_each.groupBy("label", "wish").agg(F.count("*").alias("n"))
        moves = flows.filter("label <> wish")
        back = moves.select(F.col("wish").alias("label"), F.col("label").alias("wish"), F.col("n").alias("back"))
        load = flows.groupBy("label").agg(F.sum("n").alias("load")).select(F.col("label").alias("wish"), "load")
        moves = moves.join(back, ["label", "wish"], "left").join(load, "wish", "left")
        moves = moves.withColumn("even", F.least("n", F.coalesce("back", F.lit(0))))
        room = F.greatest(F.lit(0), _quota(rows, shards, F.col("wish")) - F.coalesce("load", F.lit(0)))
        more = F.sum(F.col("n") - F.col("even")).over(Window.partitionBy("wish"))
        share = (F.col("even") + (F.col("n") - F.col("even")) * F.least(F.lit(1.0), room / F.greatest(more, F.lit(1)))) / F.col("n")
        granted = anchor(moves.select("label", "wish", share.alias("share")))
        luck = F.pmod(F.xxhash64("chance", F.lit(turn)), F.lit(_UNIT)) < F.col("share") * _UNIT
        goes = F.coalesce(luck, F.lit(False))
        state = asked.join(F.broadcast(granted), ["label", "wish"], "left").select(
            "row", "key", "chance", F.when(goes, F.col("wish")).otherwise(F.col("label")).alias("label"), goes.alias("moved")
        )
        state = anchor(state)
        moved = state.filter("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            break
    return state


def sharded(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``rows`` (row, chance, ...) with shard and slot; ``links`` are (row, key) pairs.

    Both must be pinned or files, so that a row keeps its number.
    """
    total = rows.count()
    sizes = links.groupBy("key").agg(F.count("*").alias("n"))
    large = links.join(sizes.filter(F.col("n") > total // shards).select("key"), "key")
    small = links.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= total // shards)).select("key"), "key")
    state = propagated(small.join(rows.select("row", "chance"), "row"), total, shards, rounds)
    linked = state.groupBy("row").agg(F.first("label").alias("label"), F.min("key").alias("key"))
    linked = numbered(rows.join(linked, "row"), "label", "key", "chance")
    held = {r["label"]: (r["n"], r["first"]) for r in linked.groupBy("label").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()}
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    stay = [min(quota[k], held.get(k, (0, 0))[0]) for k in range(shards)]
    first = F.element_at(_longs([held.get(k, (0, 0))[1] for k in range(shards)]), F.col("label") + 1)
    linked = linked.withColumn("slot", F.col("nth") - first).drop("nth")
    settled = F.col("slot") < F.element_at(_longs(stay), F.col("label") + 1)
    here = linked.filter(settled).withColumn("shard", F.col("label")).drop("label", "key")

    over = linked.filter(~settled).withColumn("late", F.lit(1)).drop("slot")
    free = rows.join(state.select("row").distinct(), "row", "left_anti").withColumn("label", F.lit(0))
    free = free.join(large.groupBy("row").agg(F.min("key").alias("key")), "row", "left")
    free = free.withColumn("late", F.when(F.col("key").isNull(), 2).otherwise(0)).withColumn("key", F.coalesce("key", F.lit(0).cast("long")))
    line = numbered(over.unionByName(free), "late", "label", "key", "chance")
    begin = [sum(quota[:k]) - sum(stay[:k]) for k in range(shards)]
    shard = F.size(F.filter(_longs(begin), lambda x: x <= F.col("nth"))) - 1
    line = line.withColumn("shard", shard)
    slot = F.col("nth") - F.element_at(_longs(begin), F.col("shard") + 1) + F.element_at(_longs(stay), F.col("shard") + 1)
    filled = line.withColumn("slot", slot).drop("late", "label", "key", "nth")
    return here.unionByName(filled)


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD
    rows = anchor(
        docs.select(
            "doc_id",
            size.cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("key"),
            F.xxhash64("doc_id", "text").alias("chance"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    links = rows.filter("key IS NOT NULL").select("row", "key")
    out = sharded(rows.drop("key"), links, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
