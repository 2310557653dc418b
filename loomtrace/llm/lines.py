"""Line dedup with sharded cuckoo filters over exact reference counts; reversible.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at
least ``least_chars`` code points held by at least ``least_docs`` documents are common:
their lines go from all documents but the one of the largest doc_id.

The index has one row per shard of keys: the exact number of documents that hold each
key, and a cuckoo filter of the common ones. Inserting documents adds counts, deleting
them takes counts away; keys that cross the threshold enter or leave the filter, so
deleting documents gives the index that would have been built without them. The index
also keeps its references, those of deleted documents with a minus sign. The filter is
small, so it travels to the references; what it lets through (all of the common keys, few
others) is counted exactly over the whole index, which also says who keeps the line. So a
batch can be cleaned alone: documents that are in the index lose what they would lose
beside all others, and documents that are not lose every common line. Shuffled: one packed row per batch and shard with
each key once, the references, and the documents by id to meet the lines they lose.

Each row counts as a document, also rows that repeat a doc_id; a key stays in all rows
of its largest doc_id. A null doc_id is smaller than any other. A null or empty text is
one empty line. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm import words as W
from loomtrace.llm.apart import set_apart
from loomtrace.session import anchor

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Text bytes whose keys one shard holds.
SHARD_BYTES = 8 << 20
_CHARACTER = (np.arange(256) & 0xC0) != 0x80


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket; each key has two buckets.

    Two 64-bit hashes stand for a key. Work is on arrays of keys; keys that want the same
    bucket in one step take turns.
    """

    SLOTS, MOST_STEPS = 4, 400

    def __init__(self, table: np.ndarray) -> None:
        self.table = table.reshape(-1, self.SLOTS)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(n, 1) / cls.SLOTS / 0.8))))
        return cls(np.zeros(buckets * cls.SLOTS, np.uint16))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (h2 >> np.uint64(48)).astype(np.uint16)
        return np.maximum(mark, 1), (W.mixed(h1) % np.uint64(len(self.table))).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (W.mixed(mark.astype(np.uint64)) % np.uint64(len(self.table))).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True for every key inside, and by chance for about one other in 8,000."""
        mark, at = self._places(h1, h2)
        found = (self.table[at] == mark[:, None]).any(1)
        return found | (self.table[self._other(mark, at)] == mark[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False when the table is too full; it is then to be built anew, larger."""
        mark, at = self._places(h1, h2)
        tried = np.zeros(len(mark), bool)
        for step in range(self.MOST_STEPS):
            if not len(mark):
                return True
            _, turn = np.unique(at, return_index=True)
            free = self.table[at[turn]] == 0
            fits = free.any(1)
            self.table[at[turn[fits]], free[fits].argmax(1)] = mark[turn[fits]]
            full = turn[~fits]
            kick = full[tried[full]]
            slot = (step + kick) % self.SLOTS
            mark[kick], self.table[at[kick], slot] = self.table[at[kick], slot], mark[kick].copy()
            at[full] = self._other(mark[full], at[full])
            tried[full] = True
            rest = np.ones(len(mark), bool)
            rest[turn[fits]] = False
            mark, at, tried = mark[rest], at[rest], tried[rest]
        return not len(mark)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that are inside."""
        mark, at = self._places(h1, h2)
        for first in (True, False):
            bucket = at if first else self._other(mark, at)
            gone = np.zeros(len(mark), bool)
            left = np.arange(len(mark))
            while len(left):
                _, turn = np.unique(bucket[left], return_index=True)
                turn = left[turn]
                same = self.table[bucket[turn]] == mark[turn, None]
                hit = same.any(1)
                self.table[bucket[turn[hit]], same[hit].argmax(1)] = 0
                gone[turn[hit]] = True
                left = np.setdiff1d(left, turn)
            mark, at = mark[~gone], at[~gone]
        if len(mark):
            raise ValueError("a key to delete is not in the filter")


class LineIndex(NamedTuple):
    """state: (shard, counts, filter), one row per shard that has keys.

    added and taken: (shard, keys, refs) of the documents inserted and deleted so far.
    """

    state: DataFrame
    shards: int
    least_chars: int = LEAST_CHARS
    least_docs: int = LEAST_DOCS
    added: DataFrame | None = None
    taken: DataFrame | None = None


_STATE = "shard long, counts binary, filter binary"
_PARTS = "shard long, keys binary, refs binary"


def _keys(texts: W.Texts, least_chars: int) -> tuple[W.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """All lines, which of them are long enough, and both hashes of every key."""
    lines = W.lines_of(texts)
    bare = W.stripped(texts, lines)
    low = W.LOWER[texts.data]
    long = np.flatnonzero(W.sums(_CHARACTER[texts.data], bare.start, bare.end) >= least_chars)
    start, end = bare.start[long], bare.end[long]
    return lines, long, W.hashes(low, start, end), W.hashes(low, start, end, 1)


def references(docs: DataFrame, shards: int, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(shard, keys, refs) per batch: each key with its documents counted, and who holds it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            lines, long, h1, h2 = _keys(W.texts_of(batch.column("text")), least_chars)
            if not len(long):
                continue
            doc = lines.text[long]
            order = np.lexsort((doc, h2, h1, h1 % np.uint64(shards)))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new_key = np.ones(len(order), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_ref = new_key.copy()
            new_ref[1:] |= doc[1:] != doc[:-1]
            key = (np.cumsum(new_key) - 1)[new_ref]
            doc = W.ids_of(batch.column("doc_id"))[doc[new_ref]]
            h1, h2 = h1[new_key], h2[new_key]
            held = np.bincount(key, minlength=len(h1))
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            keys, refs = [], []
            for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
                i, j = np.searchsorted(key, (a, b))
                keys.append(W.packed(h1[a:b], h2[a:b], held[a:b]))
                refs.append(W.packed((key[i:j] - a).astype(np.int32), doc[i:j]))
            yield pa.record_batch([pa.array(shard[cut]), pa.array(keys, pa.binary()), pa.array(refs, pa.binary())], ["shard", "keys", "refs"])

    return docs.select("doc_id", "text").mapInArrow(send, _PARTS)


def empty_index(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_bytes: int = SHARD_BYTES) -> LineIndex:
    """An index without documents, with shards for tables of about this size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return LineIndex(docs.sparkSession.createDataFrame([], _STATE), max(1, -(-size // shard_bytes)), least_chars, least_docs)


def _updated(sign: int, least_docs: int):
    def update(state: pa.Table, parts: pa.Table) -> pa.Table:
        loads = [W.unpacked(x) for x in parts.column("keys").to_pylist()]
        shard = (state if state.num_rows else parts).column("shard")[0].as_py()
        old = W.unpacked(state.column("counts")[0].as_py()) if state.num_rows else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
        h1, h2 = (np.concatenate([old[i], *(x[i] for x in loads)]) for i in (0, 1))
        change = np.concatenate([old[2], *(sign * x[2] for x in loads)])
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        at = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else order
        before = np.add.reduceat(np.where(order < len(old[0]), change[order], 0), at) if len(at) else at
        now = np.add.reduceat(change[order], at) if len(at) else at
        if (now < 0).any():
            raise ValueError("documents to delete are not in the index")
        h1, h2 = h1[at], h2[at]
        common = now >= least_docs
        up, down = common & (before < least_docs), ~common & (before >= least_docs)
        cuckoo = CuckooFilter(W.unpacked(state.column("filter")[0].as_py())[0].copy()) if state.num_rows else CuckooFilter.sized(0)
        cuckoo.delete(h1[down], h2[down])
        n = max(int(common.sum()), 1)
        while common.sum() > 0.9 * cuckoo.table.size or not cuckoo.insert(h1[up], h2[up]):
            cuckoo, up = CuckooFilter.sized(n), common
            n *= 2
        left = now > 0
        row = [[shard], [W.packed(h1[left], h2[left], now[left])], [W.packed(cuckoo.table.ravel())]]
        return pa.table([pa.array(row[0], pa.int64()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], ["shard", "counts", "filter"])

    return update


def _changed(index: LineIndex, parts: DataFrame, sign: int) -> LineIndex:
    keys = parts.select("shard", "keys")
    state = index.state.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(_updated(sign, index.least_docs), _STATE)
    log = "added" if sign > 0 else "taken"
    old = getattr(index, log)
    return index._replace(state=anchor(state), **{log: parts if old is None else old.unionByName(parts)})


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    return _changed(index, anchor(references(docs, index.shards, index.least_chars)), 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without these documents, which it must hold."""
    return _changed(index, anchor(references(docs, index.shards, index.least_chars)), -1)


def _common_references(index: LineIndex, parts: DataFrame) -> DataFrame:
    """(h1, h2, doc) of the references to keys that the filters let through."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, refs, table in zip(*(batch.column(c).to_pylist() for c in ("keys", "refs", "filter")), strict=True):
                h1, h2, _ = W.unpacked(keys)
                hit = CuckooFilter(W.unpacked(table)[0]).holds(h1, h2)
                if not hit.any():
                    continue
                key, doc = W.unpacked(refs)
                mine = hit[key]
                yield pa.record_batch(
                    [pa.array(h1[key[mine]].view(np.int64)), pa.array(h2[key[mine]].view(np.int64)), pa.array(doc[mine])], ["h1", "h2", "doc"]
                )

    probed = parts.join(index.state.select("shard", "filter"), "shard").select("keys", "refs", "filter")
    return probed.mapInArrow(probe, "h1 long, h2 long, doc long")


def lost_lines(index: LineIndex, parts: DataFrame) -> DataFrame:
    """(doc_id, lost): the keys that each document of ``parts`` loses, as hash pairs."""
    held = _common_references(index, parts)
    if index.added is None:
        return held.select(F.nullif("doc", F.lit(W.NULL_ID)).alias("doc_id"), F.array(F.struct("h1", "h2")).alias("lost")).limit(0)
    every = (held if index.added is parts else _common_references(index, index.added)).withColumn("n", F.lit(1))
    if index.taken is not None:
        gone = _common_references(index, index.taken).withColumn("n", F.lit(-1))
        every = every.unionByName(gone).groupBy("h1", "h2", "doc").agg(F.sum("n").alias("n"))
    holders = every.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("doc"))).alias("stays"))
    holders = holders.filter(F.col("n") >= index.least_docs)
    gone = held.join(holders, ["h1", "h2"]).filter(F.col("doc") != F.col("stays"))
    return gone.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")).select(F.nullif("doc", F.lit(W.NULL_ID)).alias("doc_id"), "lost")


def without_common_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with their kept lines as text, beside n_lines and n_dropped.

    Without an index, one of these documents is made. Columns of ``docs`` stay, but for
    those named n_lines or n_dropped.
    """
    kept = set_apart(docs.drop("n_lines", "n_dropped"), ("doc_id", "text"))
    return kept.back(_cleaned(kept.docs, index), "n_lines", "n_dropped")


def _cleaned(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    empty = empty_index(docs) if index is None else index
    parts = anchor(references(docs, empty.shards, empty.least_chars))
    index = _changed(empty, parts, 1) if index is None else index
    lost = lost_lines(index, parts).select(F.col("doc_id").alias("_id"), F.col("lost").alias("_lost"))
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    least_chars = index.least_chars

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            text_at, lost_at = (batch.schema.get_field_index(c) for c in ("text", "_lost"))
            column, lost = batch.column(text_at), batch.column(lost_at)
            texts = W.texts_of(column)
            lines, long, h1, h2 = _keys(texts, least_chars)
            row = lines.text[long].astype(np.uint64)
            sizes = np.diff(np.concatenate([[0], np.cumsum(lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
            pairs = lost.flatten()
            of = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            mark = lambda a, b, r: W.mixed(a ^ W.mixed(b ^ W.mixed(r + np.uint64(1))))
            there = mark(*(pairs.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)), of)
            keep = np.ones(len(lines.start), bool)
            keep[long[np.isin(mark(h1, h2, row), there)]] = False
            dropped = W.sums(~keep, lines.first[:-1], lines.first[1:])
            flat, new = texts.data.tobytes(), column.to_pylist()
            for i in np.flatnonzero(dropped):
                a, b = lines.first[i : i + 2]
                new[i] = b"\n".join(flat[lines.start[j] : lines.end[j]] for j in np.arange(a, b)[keep[a:b]]).decode()
            out = batch.set_column(text_at, "text", pa.array(new, pa.string())).drop_columns(["_lost"])
            out = out.append_column("n_lines", pa.array(np.diff(lines.first)))
            yield out.append_column("n_dropped", pa.array(dropped))

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(clean, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text, of all documents."""
    kept = _cleaned(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
