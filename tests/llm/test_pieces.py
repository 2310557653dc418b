import os
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no tokenizer files here")
MODEL = P.load_model() if os.path.exists(P.MODEL) else b""


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def ours():
    return P.Pieces(MODEL)


ALPHABET = "aaabteinsr  ▁.,-=#0123\n\téñ漢字ｘ😀STATthe"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_ids_equal_the_library(text):
    global _both
    library, own = _both = globals().get("_both") or (sentencepiece.SentencePieceProcessor(model_proto=MODEL), P.Pieces(MODEL))
    assert (own.ids(P._marked(text)) if text else []) == library.encode(text)


def test_runs_of_one_character(library, ours):
    for c in " a-=*1":
        for n in range(1, 70):
            assert ours.ids(P._marked(c * n)) == library.encode(c * n)


def test_paths_are_what_merging_gives(ours):
    rng = random.Random(3)
    for n in range(400):
        s = "".join(rng.choice("aabeinrst-=▁0") for _ in range(rng.randrange(1, 50)))
        assert ours.traced(s) == ours.merged(s)


def texts():
    rng = random.Random(8)
    words = ["the", "representation", "springframework", "aaaaaaa", "x" * 40, "漢字", "1234567", "\n\n", "=" * 30, "don't", "été"]
    out = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 30, 200, 900)]
    out += ["a" * 3000, " " * 500, "".join(rng.choice("abcdeinrst") for _ in range(2500)), "".join(rng.choice(ALPHABET) for _ in range(2500))]
    return out + ["", None]


@pytest.mark.parametrize("chunk", [16, 40, 1 << 15])
def test_documents_equal_the_library(documents, library, chunk):
    given_ = texts()
    rows = P.encode(documents(list(enumerate(given_))), MODEL, chunk).collect()
    assert len(rows) == len(given_)
    for r in rows:
        want = None if given_[r.doc_id] is None else library.encode(given_[r.doc_id])
        assert r.ids == want
        assert (r.lang, r.source) == ("en", "a")


def test_many_levels_of_products(documents, library):
    text = "".join(random.Random(1).choice("abcdeinrst ") for _ in range(16 * 64 * 5))
    row = P.encode(documents([(1, text)], 1), MODEL, 16).first()
    assert row.ids == library.encode(text)


def test_decoding_gives_the_text_back(documents, odd_rows):
    docs = documents([(n, r[1]) for n, r in enumerate(odd_rows)] + [(100 + n, t) for n, t in enumerate(texts()) if t is None or "▁" not in t])
    rows = P.decode(P.encode(docs, MODEL, 64), MODEL).join(docs.select("doc_id", "text"), "doc_id")
    assert rows.filter(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0


def test_any_ids_decode_as_the_library_does(library, ours, monkeypatch):
    """Cut lists, single bytes, unknown and control pieces."""
    rng = random.Random(12)
    size = library.get_piece_size()
    whole = library.encode(" ".join(t for t in texts() if t)[:4000] + " é漢😀")
    lists = [[288, 375], [], [0], [1, 288], [0, 288, 0], [198], [198, 172], [233, 191, 288], [35, 288]]
    lists += [whole[a : a + rng.randrange(1, 12)] for a in range(0, len(whole), 7)]
    lists += [[rng.choice([rng.randrange(size), rng.randrange(3, 259), rng.randrange(259, 400), 0]) for _ in range(rng.randrange(1, 9))] for _ in range(3000)]
    flat, sizes = np.array([i for ids in lists for i in ids]), np.array([len(ids) for ids in lists])
    assert ours.decoded(flat, sizes) == [library.decode(ids) for ids in lists]
    monkeypatch.setattr(P, "DECODED_IDS", 5)
    assert ours.decoded(flat, sizes) == [library.decode(ids) for ids in lists]
    for bad in ([-1], [5, size]):
        with pytest.raises(IndexError):
            ours.decoded(np.array(bad), np.array([len(bad)]))


def test_empty_table_and_clashing_names(documents):
    docs = documents([]).selectExpr("*", "1 AS ids", "2 AS _chunk")
    out = P.encode(docs, MODEL)
    assert out.collect() == []
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_chunk", "ids"]
