import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é漢\n\t\x0b ", max_size=40)), max_size=8)


def pieces(texts, spans):
    return [bytes(texts.data[a:b]).decode() for a, b in zip(spans.start, spans.end)]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_lines(rows):
    texts = W.texts_of(pa.array(rows, pa.string()))
    words, lines = W.words_of(texts), W.lines_of(texts)
    assert pieces(texts, words) == [w.decode() for t in rows for w in (t or "").encode().split()]
    assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in rows]
    assert pieces(texts, lines) == [x for t in rows for x in (t or "").split("\n")]
    bare = W.stripped(texts, lines)
    assert pieces(texts, bare) == [x.strip(" \t\n\r\x0b\x0c") for t in rows for x in (t or "").split("\n")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=30), st.integers(1, 24))
def test_equal_runs_have_equal_hashes_and_others_not(values, k):
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    h = W.hashes(data, bounds[:-1], bounds[1:])
    assert len(set(h.tolist())) == len(set(values))
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    found = W.window_hashes(h, k).tolist()
    assert len(found) == len(runs)
    assert len(set(found)) == len(set(runs))
    assert len(set(zip(found, runs))) == len(set(runs))


def test_packing_gives_arrays_back():
    arrays = [np.arange(5), np.zeros(0, np.uint8), np.array([1.5, -2]), np.array([2**63], np.uint64), np.arange(3, dtype=np.int8)]
    back = W.unpacked(W.packed(*arrays, level=3))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True))


def test_slices_keep_rows_whole_and_in_order():
    rows = ["x" * n for n in (0, 5, 300, 1, 1, 1, 80, 0, 40)]
    batch = pa.record_batch([pa.array(range(9)), pa.array(rows)], ["i", "text"])
    parts = list(W.slices(iter([batch, batch.slice(0, 0)]), "text", 64))
    assert [r for p in parts for r in p.column("text").to_pylist()] == rows
    assert len(parts) == 3


@pytest.mark.parametrize("k", [1, 3, 5])
def test_covered(k):
    starts = np.array([0, 2, 7])
    want = [any(s <= i < s + k for s in starts) for i in range(12)]
    assert W.covered(starts, k, 12).tolist() == want


def test_null_ids_come_back_as_nulls():
    ids = W.ids_of(pa.array([3, None, -5]))
    assert ids[1] < -5
    assert W.ids_back(ids).to_pylist() == [3, None, -5]
