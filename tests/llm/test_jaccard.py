import random

import pytest

from loomtrace.llm import jaccard
from loomtrace.llm.graph import components


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                of[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, vocabulary=30, spread=0.04):
    """Families of copies with edits of all strengths, from a small vocabulary."""
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 14)):
            words = [f"v{rng.randrange(99)}" if rng.random() < spread else w for w in base]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(documents, seed):
    rows = corpus(seed, [30, 4, 400, 30][seed], [0.02, 0.01, 0.05, 0.1][seed])
    got = jaccard.link_components(documents(rows), bucket_bytes=2000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 3])
def test_rounds_of_leads_and_dealt_pairs(documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "PART", 3)
    rows = corpus(seed + 10, 4, 0.03 * seed) + [(5000, "a b c d e f g"), (5000, "a b c d e f g"), (5001, "a b c d e f g h")]
    got = jaccard.link_components(documents(rows), bucket_bytes=2000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_many_documents_that_share_a_passage(documents):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"x{rng.randrange(9999)}" for _ in range(rng.randrange(4, 30)))) for i in range(90)]
    got = jaccard.link_components(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pairs_to_try_are_pinned(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    plans, tried = [], jaccard._tried

    def seen(pairs, *rest):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return tried(pairs, *rest)

    monkeypatch.setattr(jaccard, "_tried", seen)
    jaccard.link_components(documents(corpus(11, 4)), bucket_bytes=2000)
    assert len(plans) > 1
    assert all("Join" not in p and "Aggregate" not in p for p in plans)


def test_odd_rows(documents, odd_rows):
    got = jaccard.link_components(documents(odd_rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_empty_table(documents):
    assert jaccard.link_components(documents([], 1)).collect() == []


def test_one_of_each_component_stays(documents, odd_rows):
    rows = corpus(3) + [(1000 + i, t) for i, (_, t, *_) in enumerate(odd_rows)] + [(1004, odd_rows[4][1])] * 2
    want = {}
    for row, (i, n, c) in zip(sorted(rows, key=str), sorted(brute(rows), key=str)):
        want[c if n else (i, "empty")] = 1
    got = jaccard.first_of_each(documents(rows))
    assert got.columns == documents([]).columns
    assert got.count() == len({c for _, n, c in brute(rows) if n}) + sum(n == 0 for _, n, _ in brute(rows))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
