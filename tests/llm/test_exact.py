import hashlib

import pytest

from loomtrace.llm import exact


def brute(rows):
    low = [(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) for r in rows]
    out = []
    for n, (i, t) in enumerate(low):
        same = [(j is not None, j or 0, m) for m, (j, u) in enumerate(low) if u == t]
        keep = max(same)[:2]
        ties = [m for k, j, m in same if (k, j) == keep]
        out.append((i, keep[1] if keep[0] else None, len(same), n == ties[0], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("support", [0.5, 0.05, 1e-4])
def test_equals_brute_force(documents, odd_rows, support):
    rows = [(i, f"Text {i % 7} É") for i in range(60)] + [(100 + i, "HOT" if i % 2 else "hot") for i in range(40)] + odd_rows
    got = exact.groups(documents(rows), support).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(documents):
    assert exact.groups(documents([], 1)).collect() == []


def test_only_ascii_letters_change_case(spark):
    rows = spark.createDataFrame([("ABC É İ",), ("ABC",)], ["t"])
    assert [r[0] for r in rows.select(exact.lowered(rows.t)).collect()] == ["abc É İ", "abc"]
