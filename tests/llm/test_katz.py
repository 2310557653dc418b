import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomtrace.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def brute(rows):
    """Katz with Good-Turing discounts, one token at a time."""
    texts = [(i, tokens(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    words, pairs = Counter(), Counter()
    for _, ws, held in texts:
        if not held:
            words.update(ws)
            pairs.update(zip(["<"] + ws[:-1], ws))
    total, types = sum(words.values()), len(words)

    def discounts(counts):
        n = Counter(counts.values())
        out = [1.0] * 6
        if n[1]:
            rest = 6 * n[6] / n[1]
            for r in range(1, 6):
                if n[r] and rest < 1:
                    d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
                    out[r] = d if 0 < d < 1 else 1.0
        return lambda c: c * (out[c] if c <= 5 else 1.0)

    cut, cut2 = discounts(words), discounts(pairs)
    kept = sum(cut(c) for c in words.values())
    scale = 1.0 if kept < total else total / (total + 1)
    unknown = 1 - scale * kept / total if total else 1.0
    one = lambda w: scale * cut(words[w]) / total if words[w] else unknown
    after = {}
    for (h, w), c in pairs.items():
        after.setdefault(h, {})[w] = c

    def two(h, w):
        seen = after.get(h)
        if not seen:
            return one(w)
        n, left = sum(seen.values()), sum(cut2(c) for c in seen.values())
        s = 1.0 if left < n * (1 - 1e-12) else n / (n + 1)
        if w in seen:
            return s * cut2(seen[w]) / n
        return (1 - s * left / n) / (1 - sum(one(x) for x in seen)) * one(w)

    out = []
    for i, ws, held in texts:
        base = sum(math.log10((words[w] + 1) / (total + types + 1)) for w in ws)
        score = sum(math.log10(two(h, w)) for h, w in zip(["<"] + ws[:-1], ws))
        out.append((i, held, len(ws), sum(words[w] > 0 for w in ws), total, base, score))
    return out, two, words


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    bank = [f"W{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [(i, " ".join(rng.choice(bank) for _ in range(rng.randrange(60)))) for i in range(n)]


def check(got, rows):
    want, _, _ = brute(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(documents, monkeypatch, small):
    if small:
        for name in ("BATCH_BYTES", "WORD_BYTES", "PAIR_BYTES"):
            monkeypatch.setattr(katz, name, 700)
    rows = corpus()
    check(katz.scores(documents(rows)).collect(), rows)


def test_odd_rows(documents, odd_rows):
    rows = [r[:2] for r in odd_rows]
    check(katz.scores(documents(rows)).collect(), rows)


def test_empty_table(documents):
    assert katz.scores(documents([], 1)).collect() == []


def test_contexts_sum_to_one():
    """Over all known words, the end, and one word for the unknown."""
    _, two, words = brute(corpus())
    for h in ["<", "w1", "w2", "no such word"]:
        assert sum(two(h, w) for w in [*words, "no such word"]) == pytest.approx(1)


def test_beats_the_base_on_held_out_text(spark):
    from loomtrace.llm.queries import QUERIES

    rows = QUERIES["op6_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
