import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import mixing


def filled(sizes):
    """Targets by sharing again until no source is above twice its words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] >= 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
            left.discard(s)
    return out


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "c", "B"]
    return [(i, "x " * rng.randrange(200), rng.choice(names) if i % 3 else "a") for i in range(n)]


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_mixture(documents, monkeypatch, block_rows):
    rows = corpus()
    monkeypatch.setattr(mixing.drawn, "__defaults__", (block_rows, 4))
    got = mixing.mixture(documents(rows)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want = filled(total)
    assert len(got) == len(rows)
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 200
    again = mixing.mixture(documents(rows, 7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_a_flight_keeps_words_and_documents():
    rng = np.random.default_rng(2)
    size, chance = rng.integers(0, 500, 300).astype(float), rng.random(300)
    flown = mixing.flight(size, chance, rng.random(300))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(chance.sum())
    assert (flown * size).sum() == pytest.approx((chance * size).sum())


def test_flights_keep_inclusion_probabilities_on_average():
    rng = np.random.default_rng(3)
    size, chance = rng.integers(1, 50, 20).astype(float), rng.random(20)
    mean = np.mean([mixing.flight(size, chance, rng.random(20)) for _ in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.04


def test_documents_are_repeated_as_taken(documents, odd_rows):
    docs = documents(odd_rows + [(6, odd_rows[5][1]), (6, odd_rows[5][1])])
    words = mixing.mixture(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), x -> x <> '')")))).first()[0] == words


def test_odd_rows(documents, odd_rows):
    got = mixing.mixture(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_empty_and_wordless_tables(documents):
    assert mixing.mixture(documents([], 1)).collect() == []
    assert mixing.mixed_documents(documents([], 1)).collect() == []
    assert [(r.target, r.taken) for r in mixing.mixture(documents([(1, None), (2, "")])).collect()] == [(0.0, 0)] * 2
