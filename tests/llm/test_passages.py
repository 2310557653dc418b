import hashlib
import random

import pytest

from loomtrace.llm import passages


def brute(rows, k):
    """Rows equal in id and text are one document; earlier is (id, position) by the order given."""
    seen, out = {}, []
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    result = {}
    for known, i, text in docs:
        words = text.encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - k + 1):
            key = tuple(words[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            else:
                seen[key] = (i, p)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        result[known, i, text] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    for r in rows:
        out.append((r[0], *result[r[0] is not None, r[0] or 0, r[1] or ""]))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r))


def ours(docs, **how):
    rows = passages.repeat_digests(docs, **how).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r))


@pytest.mark.parametrize(("k", "m", "bucket_bytes"), [(20, 4, 1 << 20), (20, 4, 300), (6, 2, 500), (3, 1, 200)])
def test_equals_brute_force(documents, k, m, bucket_bytes):
    rng = random.Random(k)
    passage = " ".join(f"p{rng.randrange(9)}" for _ in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(90)))) for i in range(60)]
    rows += [(100 + i, f"a{i} b{i} \n {passage}  c{i}") for i in range(20)]
    rows += [(200, "x " * 150)]
    assert ours(documents(rows), k=k, m=m, bucket_bytes=bucket_bytes) == brute(rows, k)


def test_odd_rows(documents, odd_rows):
    assert ours(documents(odd_rows)) == brute(odd_rows, 20)


def test_empty_table(documents):
    assert ours(documents([], 1)) == []


def test_kept_text(documents):
    text = " ".join(f"w{i}" for i in range(25))
    got = passages.without_repeats(documents([(1, text), (2, f"new {text} tail")])).collect()
    assert {r.doc_id: r.kept_text for r in got} == {1: text, 2: "new tail"}
