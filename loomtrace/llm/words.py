"""Words, lines and their hashes for whole Arrow batches of texts.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Everything works on the
UTF-8 bytes of many texts laid back to back, so cost is per batch and not per word.
Batches are cut by bytes, never texts: a text of any length stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LINE_END = 10
#: Text bytes handled at once in a task; bounds the memory of the arrays beside them.
SLICE_BYTES = 3 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


class Texts(NamedTuple):
    """Bytes of some texts back to back; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray


class Spans(NamedTuple):
    """Pieces of texts: byte offsets, the text of each, and each text's first piece."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Texts:
    """The bytes of a string column; null counts as empty. lower: A-Z only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if offsets else np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    flat = flat[bounds[0] : bounds[-1]]
    return Texts(LOWER[flat] if lower else flat, bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut into runs of rows of about ``most`` bytes of one column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = texts_of(batch.column(batch.schema.get_field_index(column))).bounds[1:]
        parts = np.flatnonzero(np.diff(ends // most)) + 1
        for a, b in zip([0, *parts], [*parts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def words_of(texts: Texts) -> Spans:
    data, bounds = texts
    inside = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return _spans(np.flatnonzero(begins), np.flatnonzero(ends) + 1, bounds)


def lines_of(texts: Texts) -> Spans:
    """Lines split at \\n; a text of k line ends has k + 1 lines, an empty text one."""
    data, bounds = texts
    breaks = np.flatnonzero(data == LINE_END)
    start = np.concatenate([breaks + 1, bounds[:-1]])
    end = np.concatenate([breaks, bounds[1:]])
    text = np.searchsorted(bounds, breaks, "right") - 1
    n = len(bounds) - 1
    order_start = np.lexsort((start, np.concatenate([text, np.arange(n)])))
    order_end = np.lexsort((end, np.concatenate([text, np.arange(n)])))
    lines_in = np.bincount(text, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(lines_in)])
    return Spans(start[order_start], end[order_end], np.repeat(np.arange(n), lines_in), first)


def _spans(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> Spans:
    return Spans(start, end, np.searchsorted(bounds, start, "right") - 1, np.searchsorted(start, bounds))


def stripped(texts: Texts, spans: Spans) -> Spans:
    """Spans without white space at both ends."""
    inside = np.flatnonzero(~SPACES[texts.data])
    at = np.searchsorted(inside, spans.start)
    to = np.searchsorted(inside, spans.end)
    full = at < to
    start, end = spans.start.copy(), spans.start.copy()
    start[full] = inside[at[full]]
    end[full] = inside[to[full] - 1] + 1
    return spans._replace(start=start, end=end)


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = (end - start).astype(np.int64)
    h = mixed(left.astype(np.uint64) + np.uint64(seed) * _B)
    h = mixed(h ^ (eight[start] & _MASKS[np.minimum(left, 8)]))
    live, at = np.flatnonzero(left > 8), start
    step = 8
    while len(live):
        rest = left[live] - step
        h[live] = mixed(h[live] ^ (eight[at[live] + step] & _MASKS[np.minimum(rest, 8)]))
        step += 8
        live = live[rest > 8]
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive values; one per start, len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, power = None, 0, h, 1, _A
    while True:
        if k & width:
            if out is None:
                out = block
            else:
                out = out[: len(block) - done] * power + block[done:] if len(block) > done else out[:0]
            done += width
        if done == k:
            return mixed(out[:n])
        block = block[:-width] * power + block[width:] if len(block) > width else block[:0]
        power = np.uint64(int(power) ** 2 % 2**64)
        width *= 2


def windows(spans: Spans, k: int) -> np.ndarray:
    """Indexes of the pieces at which a window of k pieces of one text starts."""
    n = len(spans.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(spans.text[:n] == spans.text[k - 1 :])


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs, and the first index at which it does."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(at, len(keys)))
    count, first = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    count[order] = np.repeat(size, size)
    first[order] = np.repeat(np.minimum.reduceat(order, at), size)
    return count, first


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of k places from one of the starts."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Texts:
    """Copies of spans, back to back."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    return Texts(data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds)


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Some arrays as one compressed value; bytes of equal weight stand together."""
    head = np.array([[ord(a.dtype.char), len(a)] for a in arrays], np.int64)
    flat = (np.ascontiguousarray(a) for a in arrays)
    body = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in flat)
    small = pa.Codec("zstd", compression_level=level).compress(body, asbytes=True)
    return np.array([len(arrays), len(body)], np.int64).tobytes() + head.tobytes() + small


def unpacked(value: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(value, np.int64, 2)
    head = np.frombuffer(value, np.int64, 2 * n, 16).reshape(-1, 2)
    body = pa.decompress(value[16 + 16 * n :], int(size), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind, length in head:
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(body, np.uint8, dtype.itemsize * length, at).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += dtype.itemsize * length
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids; null becomes the smallest value, so that it sorts first."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


NULL_ID = -(1 << 63)
