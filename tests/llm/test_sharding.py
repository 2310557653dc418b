import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import sharding as S


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_equal_texts_share_a_shard(documents):
    rows = [(i, f"text {i}") for i in range(700)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(2000 + i, f"ten {i // 10}") for i in range(200)]
    got = S.document_shards(documents(rows)).collect()
    check(rows, got, 24)
    text = dict(rows)
    held = defaultdict(set)
    for r in got:
        held[text[r.doc_id]].add(r.shard)
    cut = sum(len(x) - 1 for x in held.values())
    assert cut <= 24


def test_a_group_larger_than_a_shard_fills_whole_shards(documents):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, "same") for i in range(200)]
    got = S.document_shards(documents(rows)).collect()
    check(rows, got, 24)
    assert len({r.shard for r in got if r.doc_id >= 1000}) <= 11


@pytest.mark.parametrize("n", [0, 1, 5, 24, 30])
def test_small_tables(documents, n):
    rows = [(i, "same" if i % 2 else None) for i in range(n)]
    check(rows, S.document_shards(documents(rows)).collect(), 24)


def test_odd_rows(documents, odd_rows):
    check(odd_rows, S.document_shards(documents(odd_rows)).collect(), 24)


def test_reruns_agree(documents):
    rows = [(i, f"text {i // 3}") for i in range(300)]
    one, two = (sorted(map(tuple, S.document_shards(documents(rows, p)).collect()), key=str) for p in (2, 5))
    assert one == two


def test_links_of_several_keys(spark):
    """Two communities that overlap in keys end up apart, each in one shard."""
    rows = spark.range(400).select(F.col("id").alias("row"), F.xxhash64("id").alias("chance"))
    links = spark.createDataFrame([(i, (i // 100) * 1000 + k) for i in range(400) for k in (i % 5, 10 + i % 7)], "row long, key long")
    got = S.sharded(rows, links, 4, rounds=12).collect()
    where = {r.row: r.shard for r in got}
    stay = [Counter(where[i] for i in range(a, a + 100)).most_common(1)[0][1] for a in range(0, 400, 100)]
    assert sum(stay) > 180
