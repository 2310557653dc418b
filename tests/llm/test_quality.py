import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtrace.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def field(seed=0):
    rng = np.random.default_rng(seed)
    return Q.Field(rng.normal(size=(2, Q.N_FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(["a", "bb", "é#", "c|d", "THE", "x9!"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(7))]
        rows.append((i, "\n".join(parts)))
    return rows


def test_counts_equal_brute_force(documents, odd_rows):
    rows = corpus() + [(1000 + n, r[1]) for n, r in enumerate(odd_rows)]
    got = {r.doc_id: tuple(r)[1:6] for r in Q.verdicts(documents(rows), field()).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_base_rule_and_content_share(documents, odd_rows):
    for r in Q.verdicts(documents(corpus() + odd_rows), field()).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_words >= Q.CONTENT_SHARE * r.n_words)


def test_viterbi_finds_the_best_sequence():
    from itertools import product

    f, rng = field(1), np.random.default_rng(4)
    first = np.array([0, 5, 5, 6, 13])
    x = rng.normal(size=(13, Q.N_FEATURES))
    got = Q.viterbi(f, x, first)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        score = x[a:b] @ f.emit.T

        def value(y):
            return f.begin[y[0]] + sum(score[t, s] for t, s in enumerate(y)) + sum(f.move[s, t] for s, t in zip(y, y[1:]))

        assert tuple(got[a:b]) == max(product((0, 1), repeat=b - a), key=value)


def test_training_separates_runs_of_lines():
    rng = np.random.default_rng(0)
    label = np.repeat([0, 1, 0, 1], 50)
    x = np.zeros((200, Q.N_FEATURES))
    x[:, 0] = 1
    x[:, 1] = label + rng.normal(scale=0.8, size=200)
    f = Q.train(x, np.array([0, 100, 200]), label)
    alone = ((x[:, 1] > 0.5) == label).mean()
    assert (Q.viterbi(f, x, np.array([0, 100, 200])) == label).mean() > alone + 0.1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    trained = Q.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = Q.verdicts(docs, trained).filter("NOT base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.99 * len(good)
    assert sum(bad) < 0.3 * len(bad)


def test_no_labels_and_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    trained = Q.fit(documents(corpus()), labels)
    assert trained is Q.UNTRAINED
    assert all(r.kept != r.base_failed for r in Q.verdicts(documents(corpus()), trained).collect())
    assert Q.verdicts(documents([], 1), trained).collect() == []


def test_kept_rows_keep_their_columns(documents):
    docs = documents(corpus()).selectExpr("*", "1 AS kept", "2 AS n_words")
    assert Q.kept(docs, Q.UNTRAINED).columns == docs.columns
    assert Q.kept(docs, Q.UNTRAINED).count() == sum(r.kept for r in Q.verdicts(docs, Q.UNTRAINED).collect())


@pytest.mark.parametrize("text", ["", "one line", "a\n\nb\n"])
def test_single_texts(documents, text):
    assert Q.verdicts(documents([(1, text)], 1), Q.UNTRAINED).first().n_words == len(text.split())
