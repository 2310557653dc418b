import random
from collections import Counter

import numpy as np
import pytest

from loomtrace.llm import lines


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))


def brute(rows):
    """(id, n_lines, n_dropped, text) with every row a document."""
    held = {}
    for n, r in enumerate(rows):
        for key in {key_of(x) for x in (r[1] or "").split("\n")}:
            held.setdefault(key, []).append((r[0] is not None, r[0] or 0))
    common = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for r in rows:
        me = (r[0] is not None, r[0] or 0)
        parts = (r[1] or "").split("\n")
        left = [x for x in parts if common.get(key_of(x), me) == me]
        out.append((r[0], len(parts), len(parts) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    bank = [f"Line {i} " + "é" * rng.randrange(25, 45) for i in range(40)]
    rows = []
    for i in range(80):
        parts = [rng.choice(bank) for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  "]) for x in parts)))
    return rows


def ours(docs, index=None):
    got = lines.without_common_lines(docs, index).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(((r[0], r[1], r[2], r[3] or "") for r in got), key=str)


def test_equals_brute_force(documents):
    rows = corpus()
    assert ours(documents(rows)) == brute(rows)


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(i, "\n\n Same text here on one line of more than forty characters, twice.\n") for i in range(20, 24)]
    assert ours(documents(rows)) == brute(rows)


def test_empty_table(documents):
    assert ours(documents([], 1)) == []


def test_columns_stay_and_clashing_names_give_way(documents):
    docs = documents(corpus()[:5]).selectExpr("*", "1 AS n_lines", "2 AS shard", "3 AS h1", "4 AS doc")
    assert lines.without_common_lines(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "h1", "doc", "n_lines", "n_dropped"]


def counts(index):
    found = {}
    for r in index.state.collect():
        h1, h2, n = lines.W.unpacked(r.counts)
        found |= dict(zip(zip(h1.tolist(), h2.tolist()), n.tolist()))
    return found


def test_deleting_documents_undoes_inserting_them(documents):
    rows = corpus()
    first, later = documents(rows[:50]), documents(rows[50:])
    empty = lines.empty_index(first, shard_bytes=500)
    half = lines.insert(empty, first)
    full = lines.insert(half, later)
    assert counts(full) == counts(lines.insert(empty, documents(rows)))
    back = lines.delete(full, later)
    assert counts(back) == counts(half)
    assert ours(first, back) == brute(rows[:50])
    assert ours(documents(rows), full) == brute(rows)
    assert counts(lines.delete(back, first)) == {}


def test_deleting_what_is_not_there_fails(documents):
    index = lines.insert(lines.empty_index(documents([(1, "x")])), documents([(1, "y" * 50)]))
    with pytest.raises(Exception, match="not in the index"):
        lines.delete(index, documents([(2, "z" * 50)]))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cuckoo = lines.CuckooFilter.sized(12_000)
    assert cuckoo.insert(h[0, :8_000], h[1, :8_000])
    assert cuckoo.insert(h[0, 8_000:12_000], h[1, 8_000:12_000])
    assert (cuckoo.table > 0).sum() == 12_000
    assert cuckoo.holds(h[0, :12_000], h[1, :12_000]).all()
    assert cuckoo.holds(h[0, 12_000:], h[1, 12_000:]).mean() < 0.005
    cuckoo.delete(h[0, :7_000], h[1, :7_000])
    assert cuckoo.holds(h[0, 7_000:12_000], h[1, 7_000:12_000]).all()
    assert cuckoo.holds(h[0, :7_000], h[1, :7_000]).mean() < 0.005
    assert Counter((cuckoo.table > 0).ravel().tolist())[True] == 5_000


def test_a_full_filter_says_so():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert not lines.CuckooFilter.sized(1).insert(h, h)


def test_a_batch_is_cleaned_alone_by_the_whole_index(documents):
    line = "A line that is longer than forty characters, held by many documents"
    rows = corpus() + [(100 + i, line + f"\nown line {i}") for i in range(6)]
    old, new = documents(rows[:-2]), documents(rows[-2:])
    empty = lines.empty_index(documents(rows), shard_bytes=500)
    index = lines.insert(lines.insert(empty, old), new)
    whole = {r[0]: r for r in brute(rows)}
    assert ours(new, index) == [whole[104], whole[105]]
    assert ours(documents(rows[40:60]), index) == sorted((whole[i] for i in range(40, 60)), key=str)
    # Without its largest document, the line stays in the one before.
    index = lines.delete(index, documents(rows[-1:]))
    left = {r[0]: r for r in brute(rows[:-1])}
    assert ours(documents(rows[-2:-1]), index) == [left[104]]
    assert left[104] != whole[104]
    assert ours(documents(rows[40:60]), index) == sorted((left[i] for i in range(40, 60)), key=str)
    # Below the threshold nothing is lost; inserted again, all is as before.
    few = lines.delete(index, documents(rows[-3:-1]))
    assert ours(documents(rows[-4:-3]), few) == [(102, 2, 0, line + "\nown line 2")]
    again = lines.insert(few, documents(rows[-3:]))
    assert ours(new, again) == [whole[104], whole[105]]
