import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_to(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=V.EVERY, least_chars=V.LEAST_CHARS, least_n=V.LEAST_N, ratio=V.RATIO):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= least_chars and k >= least_n}
    near = {w: [x for x in n if near_to(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(docs, **more):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in V.variants(docs, **more).collect())


def misspelt(rng, word, letters):
    i = rng.randrange(len(word))
    kind = rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind < 2 else "") + word[i + (kind > 0) :]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = ["analysis", "boundary", "caféteria", "straßenbahn", "aaaaaaa", "aaaaaaaa", "ababababab", "ñandúes" * 2]
    out = []
    for i in range(120):
        words = rng.choices(base, k=30)
        words += [misspelt(rng, rng.choice(base), "abéß") for _ in range(12)]
        words += [misspelt(rng, misspelt(rng, rng.choice(base), "ab"), "ab") for _ in range(6)]
        out.append((i % 100, " ".join(w.title() if rng.random() < 0.1 else w for w in words)))
    return out


@pytest.mark.parametrize("most_words", [V.MOST_WORDS, 8, 1])
def test_equals_brute_force_with_and_without_splits(documents, rows, most_words):
    assert found(documents(rows), most_words=most_words) == brute(rows)


def test_other_parameters(documents, rows):
    asked = {"every": 3, "least_chars": 4, "least_n": 1, "ratio": 2}
    assert found(documents(rows[:40]), **asked) == brute(rows[:40], **asked)


def test_hot_end(documents):
    """A third of the vocabulary shares its front, another its back."""
    rng = random.Random(2)
    tail = lambda: "".join(rng.choices("abc", k=4))
    words = [w for _ in range(300) for w in ("front" + tail(), tail() + "behind", tail() + tail())]
    rows = [(1, " ".join(words)), (2, " ".join(words))]
    assert found(documents(rows), most_words=16) == brute(rows)


def test_groups_are_split_and_hold_each_pair_once(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.choice([7, 8, 9]))) for _ in range(250)})
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for most in (1000, 12):
        rows = V.groups(vocab, 7, most).toPandas()
        size = rows.groupby("key").size()
        left = (rows.m - rows.front - rows.back)[rows.key.map(size) > most]
        assert (left <= 1).all()
        met = Counter()
        for _, g in rows.groupby("key"):
            for _, a in g.iterrows():
                for _, b in g.iterrows():
                    shorter = min(len(a.word), len(b.word))
                    if a.word < b.word and shorter == a.m and near_to(a.word, b.word):
                        met[a.word, b.word] += not (a.bar and a.word[: a.bar] == b.word[: a.bar])
        want = [(a, b) for a in words for b in words if a < b and near_to(a, b)]
        assert sorted(met) == want and set(met.values()) == {1}


def test_crc_of_many_spans():
    words = [b"", b"a", "straße".encode(), b"x" * 300]
    data = np.frombuffer(b"".join(words), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    heads = np.array([zlib.crc32(b"12:"), zlib.crc32(b":"), zlib.crc32(b"7:"), 0], np.uint32)
    got = V.crc32_after(heads, data, bounds[:-1], bounds[1:])
    assert got.tolist() == [zlib.crc32(w, int(h)) for w, h in zip(words, heads, strict=True)]


def test_long_words_and_bitset_borders():
    rng = random.Random(9)
    base = "".join(rng.choices("abcdef", k=400))
    words = [base] + sorted({misspelt(rng, base, "abcdef") for _ in range(200)} - {base})
    words = [w for w in words if len(w) in (400, 401)]
    rank = np.arange(len(words))
    n_near, best = V.near(pa.array(words), rank, np.zeros(len(words), np.int64), np.full(len(words), 400), np.zeros(len(words), np.int64))
    for i, w in enumerate(words):
        others = [j for j, x in enumerate(words) if near_to(w, x) and min(len(w), len(x)) == 400]
        assert n_near[i] == len(others) and best[i] == min(others, default=-1)


def test_odd_rows_and_columns(spark, documents, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + [(50, "Ordinary ordinary ordinari ×÷ÿĀordinary"), (50, "ordinary " * 12)] * 9
    docs = documents(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS key", "5 AS m", "6 AS root")
    got = found(docs)
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_empty_table(documents):
    assert found(documents([], 1)) == [] and found(documents([(1, None), (2, "")])) == []
