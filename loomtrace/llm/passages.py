"""Substring dedup over windows of words, partitioned by super-k-mers.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash
of ``m`` consecutive words inside it. Neighbouring windows mostly share a minimiser;
such a run (a super-k-mer, at most 2k - m words) travels as one packed string to the
bucket of its minimiser. Equal windows have equal minimisers, so they always meet. A
bucket sorts the windows it gets; each but the earliest of equal windows is a repeat.

Shuffled: about three words for each window that is the first of its kind in its batch.
Windows that repeat an earlier one of the same batch are settled there and never
travel, so a window that a third of all documents share reaches its bucket once per
batch. Settled spans go along with the strings, so the texts are cut up once. Then the
documents meet the spans found in them, by id.

The order of starts is (doc_id, hash of the text, position); null ids come first. Rows
equal in id and text are one document stated twice: neither removes words from the
other, and both get the same result. Texts without words, null texts and empty tables
give zero counts and the digest of an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm import words as W

WINDOW, MINIMISER = 20, 3
#: Effort of compressing the packed strings, which are most of what is shuffled.
LEVEL = 6
#: Text bytes whose windows are compared before any is sent.
BATCH_BYTES = 6 << 20
#: Text bytes that one bucket stands for; about three times as many reach it.
BUCKET_BYTES = 3 << 20


def _identity(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def _minimisers(part: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
    """The smallest of ``wide`` values from each place on, by doubling."""
    low, width = part, 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[at], low[at + wide - width])


def _earlier(keys: list[np.ndarray], rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries have an equal key at a smaller (rank, start)."""
    count, _ = W.groups(keys[0])
    some = np.flatnonzero(count > 1)
    order = some[np.lexsort([start[some], rank[some], *(k[some] for k in reversed(keys))])]
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    group = np.cumsum(~same)
    first = order[np.flatnonzero(~same)][group - 1] if len(order) else order
    out = np.zeros(len(start), bool)
    out[order] = (rank[first] != rank[order]) | (start[first] != start[order])
    return out


def _ranks(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Dense ranks of the documents in (id, mark) order; equal ones share a rank."""
    order = np.lexsort((mark, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _found(buckets: int, ids: np.ndarray, mark: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans of words to remove, one row per document; any bucket passes them on."""
    order = np.lexsort((begin, doc))
    doc, spans = doc[order], np.stack([begin[order], end[order]], axis=1).astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
    cut = [x.tobytes() for x in np.split(spans, at[1:])] if len(doc) else []
    own = doc[at]
    return pa.record_batch(
        [pa.array(mark[own] % buckets), W.ids_back(ids[own]), pa.array(mark[own]), pa.array(cut, pa.binary())],
        ["bucket", "doc_id", "mark", "load"],
    )


_PARTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("bucket", "doc_id", "mark")] + [T.StructField("load", T.BinaryType())]
)

def _send(buckets: int, k: int, m: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BATCH_BYTES):
            texts = W.texts_of(batch.column("text"))
            words = W.words_of(texts)
            at = W.windows(words, k)
            if not len(at):
                continue
            ids, mark = W.ids_of(batch.column("doc_id")), batch.column("mark").to_numpy()
            rank = _ranks(ids, mark)
            key = W.hashes(texts.data, words.start, words.end)
            other = W.hashes(texts.data, words.start, words.end, 1)
            both = [W.window_hashes(key, k)[at], W.window_hashes(other, k)[at]]
            doc = words.text[at]
            place = at - words.first[doc]
            settled = _earlier(both, rank[doc], place)
            begin, end = _runs_of(settled, doc, at)
            if len(begin):
                yield _found(buckets, ids, mark, doc[begin], place[begin], place[end - 1] + k)
            low = _minimisers(W.window_hashes(key, m), at, k - m + 1)
            go = np.flatnonzero(~settled)
            if not len(go):
                continue
            new = np.ones(len(go), bool)
            new[1:] = (low[go[1:]] != low[go[:-1]]) | (at[go[1:]] != at[go[:-1]] + 1) | (doc[go[1:]] != doc[go[:-1]])
            head = go[new]
            tail = go[np.append(np.flatnonzero(new)[1:], len(go)) - 1]
            bucket = (W.mixed(low[head]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            head, tail, bucket = head[order], tail[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            loads = []
            for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
                own, index = np.unique(doc[head[a:b]], return_inverse=True)
                strings = W.gather(texts.data, words.start[at[head[a:b]]], words.end[at[tail[a:b]] + k - 1])
                loads.append(W.packed(ids[own], mark[own], index.astype(np.int32), place[head[a:b]].astype(np.int32), strings.bounds.astype(np.int32), strings.data, level=LEVEL))
            nothing = pa.nulls(len(cut), pa.int64())
            yield pa.record_batch([pa.array(bucket[cut]), nothing, nothing, pa.array(loads, pa.binary())], ["bucket", "doc_id", "mark", "load"])

    return send


def _runs_of(flags: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set flags over neighbouring windows of one document."""
    set_at = np.flatnonzero(flags)
    if not len(set_at):
        return set_at, set_at
    new = np.ones(len(set_at), bool)
    new[1:] = (set_at[1:] != set_at[:-1] + 1) | (doc[set_at[1:]] != doc[set_at[:-1]]) | (at[set_at[1:]] != at[set_at[:-1]] + 1)
    return set_at[new], set_at[np.append(np.flatnonzero(new)[1:], len(set_at)) - 1] + 1


def _settle(k: int):
    def settle(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.is_valid(table.column("mark"))).select(["doc_id", "mark", "load"])
        table = table.filter(pc.is_null(table.column("mark")))
        if not table.num_rows:
            return passed
        ids, marks, docs, places, data, bounds = [], [], [], [], [], [np.zeros(1, np.int64)]
        n_docs = n_bytes = 0
        for load in table.column("load").to_pylist():
            i, mark, index, place, cut, flat = W.unpacked(load)
            ids.append(i)
            marks.append(mark)
            docs.append(index + n_docs)
            places.append(place)
            bounds.append(cut[1:] + np.int64(n_bytes))
            data.append(flat)
            n_docs, n_bytes = n_docs + len(i), n_bytes + len(flat)
        ids, marks, docs, places = map(np.concatenate, (ids, marks, docs, places))
        texts = W.Texts(np.concatenate(data), np.concatenate(bounds))
        del data
        words = W.words_of(texts)
        at = W.windows(words, k)
        doc = docs[words.text[at]]
        place = places[words.text[at]] + (at - words.first[words.text[at]])
        both = [W.window_hashes(W.hashes(texts.data, words.start, words.end, seed), k)[at] for seed in (0, 1)]
        again = _earlier(both, _ranks(ids, marks)[doc], place)
        begin, end = _runs_of(again, words.text[at], at)
        out = _found(1, ids, marks, doc[begin], place[begin], place[end - 1] + k)
        return pa.concat_tables([passed, pa.Table.from_batches([out]).select(["doc_id", "mark", "load"])])

    return settle


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, mark, spans): for each document with repeats the word spans they cover.

    mark is the xxhash64 of the text. spans is a list of int32 pairs, begin and end of
    each span in words; spans may overlap.
    """
    source = _identity(docs)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = source.mapInArrow(_send(max(1, -(-size // bucket_bytes)), k, m), _PARTS)
    met = parts.groupBy("bucket").applyInArrow(_settle(k), T.StructType(_PARTS.fields[1:]))
    return met.groupBy("doc_id", "mark").agg(F.collect_list("load").alias("spans"))


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words outside repeats, joined by one space."""
    return _cleaned(docs, repeated_spans(docs, k, m, bucket_bytes), digest=False)


def repeat_digests(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The same, with kept_sha256 in place of the text."""
    return _cleaned(docs, repeated_spans(docs, k, m, bucket_bytes), digest=True)


def _cleaned(docs: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    source = _identity(docs).alias("d")
    spans = spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.mark").eqNullSafe(F.col("s.mark"))
    joined = source.join(spans, same, "left").select("d.doc_id", "d.text", "s.spans")
    last = T.StructField("kept_sha256", T.StringType()) if digest else RESULT[2]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = W.texts_of(batch.column("text"))
            flat = texts.data.tobytes()
            for a, b, found in zip(texts.bounds[:-1], texts.bounds[1:], batch.column("spans").to_pylist(), strict=True):
                words = flat[a:b].split()
                n = len(words)
                if found:
                    keep = np.ones(n, bool)
                    for begin, end in np.frombuffer(b"".join(found), np.int32).reshape(-1, 2):
                        keep[begin:end] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                text = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", last.name],
            )

    return joined.mapInArrow(clean, T.StructType([docs.schema["doc_id"], *RESULT[:2], last]))
