import itertools

import pytest

from loomtrace.operators import windows


def brute(n, size, stride, drop_last):
    out = []
    for start in range(0, n, stride):
        chunk = list(range(start, min(start + size, n)))
        if len(chunk) < size and drop_last:
            break
        out.append((start // stride, chunk))
    return out


@pytest.mark.parametrize("drop_last", [True, False])
def test_windows_equal_the_loop(spark, drop_last):
    cases = list(itertools.product((1, 4, 7), (1, 3, 5), (1, 2, 6)))
    data = [(f"{n}", p, p) for n in (1, 4, 7) for p in range(n)]
    df = spark.createDataFrame(data, "k string, pos long, item long")
    for size, stride in sorted({c[1:] for c in cases}):
        got = windows.windows(df, ["k"], "item", size=size, stride=stride, drop_last=drop_last)
        found = sorted((r["k"], r["window"], list(r["items"])) for r in got.collect())
        want = sorted((f"{n}", w, c) for n in (1, 4, 7) for w, c in brute(n, size, stride, drop_last))
        assert found == want


def test_sliding_bundles_of_a_short_class(spark):
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(3)], "label string, i long, text string")
    none = windows.bundle_texts(df, ["label"], ["i"], size=5, strategy="sliding", drop_last=True)
    one = windows.bundle_texts(df, ["label"], ["i"], size=5, strategy="sliding")
    assert none.count() == 0
    assert [r["text"] for r in one.collect()] == ["t0\nt1\nt2"]


def test_bad_sizes_are_errors(spark):
    df = spark.createDataFrame([("a", 0, 1)], "k string, pos long, item long")
    with pytest.raises(ValueError):
        windows.windows(df, ["k"], "item", size=0)
    with pytest.raises(ValueError):
        windows.windows(df, ["k"], "item", size=1, stride=0)


def test_files_of_an_actor_merge_by_time(spark):
    """Lines without a time stay behind the one before them; a file without any comes first."""
    rows = [
        ("H1", "b", 1, 10, "b1"), ("H1", "b", 2, None, "b2"), ("H1", "b", 3, 30, "b3"),
        ("H1", "a", 1, None, "a1"), ("H1", "a", 2, 20, "a2"), ("H1", "a", 3, None, "a3"), ("H1", "a", 4, 10, "a4"),
        ("H1", "c", 1, None, "c1"), ("H1", "c", 2, None, "c2"),
        ("H2", "b", 1, 5, "z1"),
    ]
    lines = spark.createDataFrame(rows, "actor string, path string, line_no long, ts long, text string").repartition(4)
    got = windows.cross_file_windows(lines, size=9, drop_last=False, join_token=" ").collect()
    assert {(r.actor, r.file, r.line_no, r.n): r.text for r in got} == {
        ("H1", "a", 1, 9): "a1 c1 c2 a4 b1 b2 a2 a3 b3",
        ("H2", "b", 1, 1): "z1",
    }
    cut = windows.cross_file_windows(lines, size=4, stride=2, join_token=" ").collect()
    assert sorted((r.window, r.file, r.line_no, r.text) for r in cut) == [(0, "a", 1, "a1 c1 c2 a4"), (1, "c", 2, "c2 a4 b1 b2"), (2, "b", 1, "b1 b2 a2 a3")]
