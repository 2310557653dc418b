import random

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import secrets as S


def corpus(seed=6):
    rng = random.Random(seed)
    prose = ["the", "house", "green", "river", "mountain", "between", "window", "letter", "summer", "garden"]
    line = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    hexed = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(240):
        kind = i % 6
        middle = [
            f'token = "{hexed()}"',
            f"commit {hexed()}",
            "".join(rng.choice(prose) for _ in range(4)),
            "".join(rng.choice("0123456789") for _ in range(16)),
            "/usr/share/documents/letters.txt",
            "plain",
        ][kind]
        rows.append((i, f"{line(12)} {middle} {line(9)}"))
    return rows


def test_candidates(documents):
    text = 'say token = "abcdefghij0123456789" and two: aaaaaaaaaaaaaaaaaaaa,bbbbbbbbbbbbbbbbbbbb'
    got = S.candidates(documents([(1, text)])).orderBy("candidate").collect()
    assert [(r.word_index, r.candidate, r.near) for r in got] == [
        (6, "a" * 20, '"abcdefghij0123456789" and two:'),
        (3, "abcdefghij0123456789", "say token ="),
        (6, "b" * 20, '"abcdefghij0123456789" and two:'),
    ]


def test_held_out_findings_are_told_apart(documents):
    rows = corpus()
    featured = S.with_features(S.candidates(documents(rows)), S.dictionary(documents(rows)))
    model = S.fit(S.assigned_findings(featured).filter("doc_id % 12 < 6"))
    got = S.scored(featured, model).filter("doc_id % 12 >= 6").collect()
    assert {r.doc_id % 6 for r in got if r.is_secret} == {0}
    assert all(r.is_secret for r in got if r.doc_id % 6 == 0)
    assert len(got) == 100


def test_reviewed_findings_train_the_forest(spark, documents):
    docs = documents(corpus())
    reviewed = [(r.doc_id, r.word_index, r.candidate, int(r.doc_id % 6 == 1)) for r in S.candidates(docs).filter("doc_id < 120").collect()]
    findings = spark.createDataFrame(reviewed, "doc_id long, word_index int, candidate string, label int")
    got = S.scan(docs, findings).filter("doc_id >= 120").collect()
    assert {r.doc_id % 6 for r in got if r.is_secret} == {1}


def test_reruns_agree(documents):
    rows = corpus()[:120]
    one, two = (sorted(map(tuple, S.scan(documents(rows, p)).collect())) for p in (2, 5))
    assert one == two


def test_odd_rows(documents, odd_rows):
    got = S.scan(documents(odd_rows)).collect()
    assert [(r.doc_id, r.score, r.is_secret) for r in got] == [(10, 0.0, False)]


def test_empty_table(documents):
    assert S.scan(documents([], 1)).collect() == []


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_findings_of_one_kind(documents, label):
    featured = S.with_features(S.candidates(documents(corpus()[:12])), [])
    assert S.fit(featured.withColumn("label", F.lit(label))) == label


def planted(seed=9):
    """(rows, kinds): secrets without quotes or without a name, and what looks like them."""
    rng = random.Random(seed)
    prose = ["the", "house", "green", "river", "mountain", "between", "window", "letter", "summer", "garden"]
    line = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    run = lambda n, signs="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(signs) for _ in range(n))
    makes = {
        "env": lambda: f"DB_PASSWORD={run(24)}",
        "key": lambda: f"AKIA{run(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}",
        "url": lambda: f"https://robot:{run(20)}@host.example/path",
        "block": lambda: run(48) + "==",
        "quoted": lambda: f'api_key = "{run(32)}"',
        "commit": lambda: f"commit {run(40, '0123456789abcdef')}",
        "card": lambda: run(16, "0123456789"),
        "path": lambda: "/usr/share/documents/letters.txt",
        "words": lambda: "".join(rng.choice(prose) for _ in range(4)),
        "name": lambda: "some-garden-window.letters.example",
    }
    kinds = list(makes)
    rows = [(i, f"{line(9)} {makes[kinds[i % len(kinds)]]()} {line(7)}") for i in range(300)]
    return rows, kinds


def test_unquoted_and_bare_secrets_are_found(documents):
    rows, kinds = planted()
    got = S.scan(documents(rows)).collect()
    hit = {k: len({r.doc_id for r in got if r.is_secret and kinds[r.doc_id % len(kinds)] == k}) / 30 for k in kinds}
    assert all(hit[k] >= 0.95 for k in kinds[:5]), hit
    assert all(hit[k] <= 0.05 for k in kinds[5:]), hit


def test_labels_are_no_rule_over_the_features(documents):
    rows, kinds = planted()
    featured = S.with_features(S.candidates(documents(rows)), S.dictionary(documents(rows)))
    got = S.assigned_findings(featured).collect()
    assert any(r.label == 1 and not (r.assigned or r.quoted or r.credential_near) for r in got)
    doubtful = S.with_features(S.candidates(documents([(1, "then k3wq9zj5xv7tb2mh4pfd came")])), [])
    assert doubtful.count() == 1
    assert S.assigned_findings(doubtful).count() == 0


def test_the_value_of_a_setting_is_the_candidate(documents):
    got = S.candidates(documents([(1, "export AWS_SECRET=abcdefghij0123456789 a=b"), (2, "pad abcdefghijklmnopqr==")])).orderBy("doc_id").collect()
    assert [r.candidate for r in got] == ["abcdefghij0123456789", "abcdefghijklmnopqr=="]
