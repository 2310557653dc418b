import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def brute_counts(text):
    """Feature counts of a text by words and prefixes, as strings."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", low.encode())
    out = {}
    for w in words:
        for f in [(w, 0), *((w[:n], 1) for n in X.PREFIXES if len(w) >= n)]:
            out[f] = out.get(f, 0) + 1
    return out, len(words)


def test_counts_equal_brute_force():
    texts = ["Idiot idiots, IDIOT!", None, "", "é à ñandú Ñandú 漢字漢字", "one two one two three", "x" * 5000 + " end"]
    found = X.counted(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want, n = brute_counts(text)
        mine = found.text == i
        assert sorted(found.count[mine]) == sorted(want.values())
        assert found.n_words[i] == n
    some = found.keys[::3]
    again = X.counted(pa.array(texts, pa.string()), some)
    keep = np.isin(found.keys[found.feature], some)
    assert (again.keys[again.feature] == found.keys[found.feature[keep]]).all()
    assert (again.count == found.count[keep]).all() and (again.text == found.text[keep]).all()


def test_swaps_stay_in_their_kind():
    swapper = X.Swapper([("muslim", "jewish", "hindu"), ("women", "men")])
    pairs = swapper.pairs("A Muslim man came. Nothing here. women and men won")
    assert len(pairs) == 2 * X.SWAPS
    for before, after in pairs:
        a, b = before.lower().split(), after.lower().split()
        changed = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        assert changed and all((x, y) in {("muslim", "jewish"), ("muslim", "hindu"), ("women", "men"), ("men", "women")} for x, y in changed)
    ((before, after),) = swapper.pairs("nothing of the kind")
    assert set(after.split()) - set(before.split()) <= {"muslim", "jewish", "hindu", "women", "men"}
    assert X.Swapper([]).pairs("a muslim") == [] and swapper.pairs("") == []


def _biased(rng, n):
    """Toxic texts name one group far more often than clean ones."""
    vocabulary = [f"word{k}" for k in range(60)]
    out = []
    for i in range(n):
        toxic = i % 2
        words = rng.choices(vocabulary, k=20)
        if toxic:
            words[rng.randrange(20)] = rng.choice(["scum", "moron", "trash"])
        if rng.random() < (0.9 if toxic else 0.05):
            words[rng.randrange(20)] = "muslims"
        out.append((i, " ".join(words) + ".", toxic))
    return out


def _trains(doc_id):
    return zlib.crc32(str(doc_id).encode()) % X.FOLDS != X.HELD_OUT


def test_penalty_frees_neutral_mentions(spark, documents):
    rows = _biased(random.Random(3), 600)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = pa.array([f"word1 word2 {g} word3 word4 word5 word6 word7 word8 word9." for g in ("muslims", "jews", "word10")])
    insult = pa.array(["word1 word2 scum word3 word4 word5 word6 word7 word8 word9."])
    free, bound = (X.fit(docs, labels, penalty=p) for p in (0.0, X.PENALTY))
    change = [X.linear(m, neutral)[0] - X.linear(m, neutral)[2] for m in (free, bound)]
    assert change[0] > 1 and abs(change[1]) < 0.2 * change[0]
    assert X.logistic(X.linear(free, neutral))[0] >= X.THRESHOLD > X.logistic(X.linear(bound, neutral))[0]
    assert X.logistic(X.linear(bound, insult))[0] >= X.THRESHOLD


def test_train_meets_a_stationary_point():
    rng = np.random.default_rng(1)
    n, k = 40, 3
    value = rng.random(n * k)
    row, feature = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    label = (rng.random(n) < 1 / (1 + np.exp(-3 * (value.reshape(n, k)[:, 0] - 0.5)))).astype(float)
    pairs = np.array([0, 0, 1]), np.array([0, 1, 2]), np.array([1.0, -1.0, 0.5])
    w, b = X.train(feature, row, value, label, pairs, k, 0.5, steps=4000, rate=0.02, ridge=1e-3)
    scale = 3 * np.sqrt((value.reshape(n, k) ** 2).sum(0) / n).mean()
    weight = np.where(label == 1, 1 / (3 * label.sum()), 2 / (3 * (n - label.sum())))

    def loss(t):
        v = t[:k] / scale
        z = value.reshape(n, k) @ v + t[k]
        change = np.array([v[0] - v[1], 0.5 * v[2]])
        return (weight * np.logaddexp(0, np.where(label == 1, -z, z))).sum() + 0.5e-3 * (t[:k] ** 2).sum() + 0.5 * (change**2).mean()

    best = np.append(w * scale, b)
    for j in range(k + 1):
        for step in (-1e-2, 1e-2):
            moved = best.copy()
            moved[j] += step
            assert loss(moved) > loss(best)


def test_odd_rows_labels_and_columns(spark, documents, odd_rows):
    rows = [*odd_rows, *((100 + i, "you are scum and trash" if i % 3 else "a fine day to walk") for i in range(60))]
    marks = [(100 + i, int(i % 3 > 0)) for i in range(60)] + [(100, None), (101, 0), (5, 7), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = documents(rows).selectExpr("*", "1 AS toxic", "2 AS score", "3 AS held_out", "4 AS key", "5 AS label", "6 AS count")
    got = X.scores(docs, X.fit(docs, labels)).collect()
    assert len(got) == len(rows) and [f for f in got[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    bare = {r.score for r in got if r.doc_id in (1, 2, 3, 11)}
    assert len(bare) == 1
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and not _trains(r.doc_id))
        if r.doc_id and r.doc_id >= 100:
            assert r.predicted == int((r.doc_id - 100) % 3 > 0)
    assert len({r.score for r in got if r.doc_id == 6}) == 1


@pytest.mark.parametrize(("marks", "share"), [([], 0.0), ([(0, 0), (1, 0)], 0.0), ([(0, 1), (1, 1), (3, 1)], 1.0)])
def test_missing_classes(spark, documents, marks, share):
    docs = documents([(i, f"text {i}") for i in range(6)])
    got = X.scores(docs, X.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))).collect()
    assert len(got) == 6 and all(abs(r.score - share) < 1e-6 for r in got)


def test_empty_table(spark, documents):
    docs = documents([], 1)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.scores(docs, X.fit(docs, labels)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.scores(docs, X.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.01 * len(clean)
