import pytest

from loomtrace.llm import exact, jaccard, lines, mixing, quality

NAMES = "_id _n _of _times _lost _mark _nth _copy _copies _kept0 _row _best size times component mark n_lines h1 doc lost key bucket a.b".split()
ROWS = [(i, f"one two three four five six seven {i % 3}\nA line of more than forty characters that many hold.", "ab"[i % 2]) for i in range(8)] + [(9, None, None), (None, "x", "a")]


@pytest.fixture(scope="module")
def plain(documents):
    return documents(ROWS)


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "stage",
    [
        lambda d: lines.without_common_lines(d),
        lambda d: jaccard.first_of_each(d),
        lambda d: mixing.mixed_documents(d),
        lambda d: quality.kept(d, quality.UNTRAINED),
        lambda d: exact.groups(d),
    ],
    ids=["lines", "jaccard", "mixing", "quality", "exact"],
)
def test_other_columns_may_have_any_name(plain, stage):
    want = stage(plain)
    got = stage(plain.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in NAMES)))
    assert rows(got, want.columns) == rows(want, want.columns)
    for r in got.collect():
        for n in set(NAMES) & set(got.columns) - set(want.columns):
            assert r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}")
