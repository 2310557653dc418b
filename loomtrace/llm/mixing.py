"""Mixing sources to target weights by cube-method balanced sampling.

Sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2, ... and share 150 % of
all words. No target exceeds twice its source's words; what a source cannot take is
shared again by weight until none is above.

A document of a source with target share p is taken floor(p) times, and once more with
inclusion probability p - floor(p). The cube method draws the extra copies: the vector
of probabilities moves inside the unit cube along directions that keep both the words
and the documents of the source as they are, so each move fixes at least one document at
0 or 1. Blocks of a source fly side by side; each leaves at most two open documents,
which go on in larger blocks, until few enough are left for one block per source. There
the landing decides the last two by the nearest total of words.

Blocks hold rows of one source and hash range; their number follows the source's rows,
so a source with a third of all rows is many blocks. Rows are (id, size, probability),
never texts. All random choices are hashes of the ids and a seed, so reruns agree.

Defined results: a null text has no words and may be taken or not at no cost in words.
Repeated rows are drawn each for itself, in the order of their sizes. Sources without
words have target 0 and nothing is taken. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm import words as W
from loomtrace.llm.apart import set_apart
from loomtrace.session import anchor

WEIGHTS = (3, 1, 2)
SHARE, MOST_TIMES, SEED = 1.5, 2, 17
#: Documents that one flight handles, about.
BLOCK_ROWS = 4096
#: Blocks that become one after a flight.
FAN_IN = 512


def _sizes(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns asked for, and the words of each text."""
    source = docs.select(*extra, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            n = np.diff(W.words_of(W.texts_of(batch.column("text"))).first)
            yield pa.record_batch([*(batch.column(c) for c in extra), pa.array(n)], [*extra, "size"])

    return source.mapInArrow(count, source.drop("text").schema.add("size", "long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("most", MOST_TIMES * F.col("source_size").cast("double"))
    # Sources fill up in the order of most / weight; those before the first that does not are full.
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(up)).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(final * F.col("weight"))
    return filled.select("source", "source_size", "n_rows", target.alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are inside (0, 1); words and documents stay balanced."""
    chance, draws = chance.tolist(), draws.tolist()
    size = (size / max(float(size.max(initial=1)), 1.0)).tolist()
    eps = 1e-9
    held: list[int] = []
    for i, p in enumerate(chance):
        if not eps < p < 1 - eps:
            chance[i] = float(round(p))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # The direction u with sum(u) = 0 and sum(u * size) = 0.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min((1 - chance[j]) / x if x > 0 else chance[j] / -x for j, x in zip(held, u, strict=True) if x)
        down = min(chance[j] / x if x > 0 else (1 - chance[j]) / -x for j, x in zip(held, u, strict=True) if x)
        step = up if draws[i] * (up + down) < down else -down
        for j, x in zip(held, u, strict=True):
            chance[j] += step * x
            if chance[j] < eps:
                chance[j] = 0.0
            elif chance[j] > 1 - eps:
                chance[j] = 1.0
        held = [j for j in held if 0 < chance[j] < 1]
    return np.array(chance)


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide what a flight has left open: the choice whose words come nearest."""
    out = chance.copy()
    left = np.flatnonzero((chance > 0) & (chance < 1))
    wanted = float((size[left] * chance[left]).sum())
    ways = np.array(np.meshgrid(*[[0.0, 1.0]] * len(left))).reshape(len(left), -1).T if len(left) else np.zeros((1, 0))
    off = np.abs(ways @ size[left] - wanted)
    docs = np.abs(ways.sum(1) - chance[left].sum())
    out[left] = ways[np.lexsort((docs, off))[0]]
    return out


def _fly(last: bool):
    def fly(table: pa.Table) -> pa.Table:
        table = table.sort_by([("spot", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        size = table.column("size").to_numpy().astype(float)
        seed = int(np.bitwise_xor.reduce(table.column("spot").to_numpy().view(np.uint64)))
        chance = flight(size, table.column("chance").to_numpy(), np.random.default_rng([SEED, seed]).random(len(size)))
        if last:
            chance = landing(size, chance)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance))

    return fly


def drawn(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (source, doc_id, size, chance, n_open, ...) with chance moved to 0 or 1.

    n_open is a bound on the rows of the source; it sets the number of blocks.
    """
    spot = F.xxhash64(F.lit(SEED), "doc_id", "size")
    rows = rows.withColumn("spot", spot).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_open") / block_rows)).cast("long"))
    is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
    done = [rows.filter(~is_open)]
    rows = rows.filter(is_open)
    blocks = rows.agg(F.max("n_blocks")).first()[0] or 1
    while True:
        rows = rows.withColumn("block", F.pmod("spot", "n_blocks"))
        flown = rows.groupBy("source", "block").applyInArrow(_fly(blocks == 1), rows.schema).drop("block")
        if blocks == 1:
            done.append(flown)
            break
        flown = anchor(flown)
        done.append(flown.filter(~is_open))
        # A source that is one block already flies once more without change and lands last.
        rows = flown.filter(is_open).withColumn("n_blocks", F.ceil(F.col("n_blocks") / fan_in).cast("long"))
        blocks = -(-blocks // fan_in)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(out.columns))
    return out.drop("spot", "n_blocks", "n_open")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and times (0, 1 or 2) of every row."""
    sizes = anchor(_sizes(docs, "doc_id", "source"))
    goal = targets(sizes)
    rows = sizes.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(share).cast("int")).withColumn("chance", share - F.col("whole"))
    out = drawn(rows.withColumnRenamed("n_rows", "n_open"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("int")).alias("times"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Rows that agree in doc_id, source and size may stand for each other; what is taken of
    them is dealt out in the order of their texts' hashes.
    """
    kept = set_apart(docs, ("doc_id", "source", "text"))
    return kept.back(_mixed(kept.docs))


def _mixed(docs: DataFrame) -> DataFrame:
    key = ["doc_id", "source", "size"]
    taken = copies(docs).groupBy(*key).agg(F.sum("times").alias("_times"), F.count("*").alias("_of"))
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in key), "_times", "_of")
    own = [F.col("doc_id"), F.col("source"), F.col("_n")]
    met = _with_size(docs).join(taken, [x.eqNullSafe(F.col(f"_{c}")) for x, c in zip(own, key, strict=True)])
    alike = Window.partitionBy(*(f"_{c}" for c in key)).orderBy(F.xxhash64("text"))
    one = met.filter("_of = 1").withColumn("_nth", F.lit(1))
    more = met.filter("_of > 1").withColumn("_nth", F.row_number().over(alike))
    times = F.floor(F.col("_times") / F.col("_of")) + (F.col("_nth") <= F.col("_times") % F.col("_of")).cast("int")
    rows = one.unionByName(more).withColumn("_copies", F.array_repeat(F.lit(1), times.cast("int")))
    return rows.select(*docs.columns, F.explode("_copies").alias("_copy")).drop("_copy")


def _with_size(docs: DataFrame) -> DataFrame:
    """``docs`` and the words of each text as _n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            n = np.diff(W.words_of(W.texts_of(batch.column(batch.schema.get_field_index("text")))).first)
            yield batch.append_column("_n", pa.array(n))

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType())]))
