import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        yield level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        i //= 8


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((own, levels([leaf(r, r.text) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            steps = [*way(tree, i), *way(top, k)]
            changed = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = leaf(r, r.text.translate(LOWER) if changed else r.text)
            for run, place in steps:
                folded = digest("".join([*run[:place], folded, *run[place + 1 :]]))
            proof = digest("".join(x for run, place in steps for j, x in enumerate(run) if j != place))
            out.append((r.doc_id, tree[0][i], tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def check(docs):
    got = merkle.manifest(docs)
    assert tuple(got.columns) == NAMES
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(docs.collect())
    return rows


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_tree_of_each_height(documents, n):
    rows = check(documents([(i, f"Text {i}") for i in range(n)]))
    assert {r[2] for r in rows} == {r[3] for r in rows}


def test_chunks_and_many_trees(documents, monkeypatch):
    """Runs above a chunk, trees that start inside one, and trees of one leaf."""
    monkeypatch.setattr(merkle, "CHUNK", 8)
    docs = documents([(i, f"Some Text {i}") for i in range(700)])
    lang = F.when(F.col("doc_id") < 600, "en").when(F.col("doc_id") < 650, "de").when(F.col("doc_id") > 697, None).otherwise(F.col("doc_id").cast("string"))
    rows = check(docs.withColumn("lang", lang))
    assert len({r[2] for r in rows}) == 51 and 0 < sum(r[-1] for r in rows) < 700


def test_only_changed_rows_fail(documents):
    rows = check(documents([(i, "ABC" if i % 2 else "abc") for i in range(100)]))
    assert {r[0] for r in rows if not r[-1]} == {i for i in range(1, 100, 2) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_odd_rows_and_columns(documents, odd_rows):
    docs = documents([*odd_rows, (12, "É Upper", None)]).selectExpr(
        "doc_id", "text", "IF(doc_id = 5, NULL, lang) AS lang", "IF(doc_id = 9, NULL, source) AS source", "n_chars", "1 AS leaf", "2 AS g", "3 AS idx", "4 AS tree", "5 AS level", "6 AS chunk", "7 AS tampered", "8 AS digest"
    )
    check(docs)


def test_empty_table(documents):
    assert merkle.manifest(documents([], 1)).collect() == []


def test_row_limit_is_put_back(spark, documents):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(documents([(1, "a"), (2, "b")]))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
