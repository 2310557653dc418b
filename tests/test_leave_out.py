import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import models
from loomtrace.operators.features import TextFeatures, term_counts, vocabulary
from loomtrace.operators.splits import fixed_split
from loomtrace.plans import leave_out, nested

ACTORS = ["H1", "H2", "H3", "GPT1", "GPT2", "GPT3"]
C = models.Candidate


@pytest.fixture(scope="module")
def view(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(150):
        actor = ACTORS[i % 6]
        pool = words[:22] if actor.startswith("H") else words[8:]
        rows.append((i, actor, "ai" if "GPT" in actor else "human", " ".join(rng.choices(pool, k=rng.randrange(0, 9)))))
    rows.append((150, "H1", "human", None))
    return spark.createDataFrame(rows, "example_id long, actor string, label string, text string").repartition(3)


def by_one_split(view, spec, candidates, held):
    """Predictions of the held-out actors, by the plan for a single split."""
    split = fixed_split(view, held[:2], held[2:])
    counts = term_counts(split, spec)
    found = nested.text_predictions(split, counts, spec, candidates).join(view.select("example_id", "actor"), "example_id")
    return {(r.candidate, r.actor): (r.h, r.n) for r in found.groupBy("candidate", "actor").agg(F.sum((F.col("y_pred") == "human").cast("int")).alias("h"), F.count("*").alias("n")).collect()}


GRID = list(enumerate([C("dummy_most_frequent"), C("dummy_stratified"), *(C(m, {"alpha": a}) for a in (0.1, 1.0) for m in ("mnb", "cnb", "bnb"))]))
SPECS = [
    TextFeatures(),
    TextFeatures(ngrams=(1, 2), sublinear=False, binary=True),
    TextFeatures(analyzer="char", ngrams=(2, 3), lowercase=False, max_df=0.5),
    TextFeatures(max_features=11),
]


@pytest.mark.parametrize(("spec", "block_cells"), [(s, leave_out.BLOCK_CELLS) for s in SPECS[1:]] + [(SPECS[0], 60)])
def test_folds_equal_single_splits(view, spec, block_cells):
    folds = leave_out.folds_of(view)
    assert len(folds.names) == 9
    got = {(r.fold, r.candidate, folds.actors[r.actor]): (r.n_human, r.n) for r in leave_out.fold_predictions(view, spec, folds, GRID, block_cells=block_cells).collect()}
    assert len(got) == 9 * len(GRID) * 4
    for f in (5,):
        held = folds.names[f].split("|")
        want = by_one_split(view, spec, GRID, held)
        assert {(c, a): v for (g, c, a), v in got.items() if g == f} == want


def test_vocabulary_of_every_fold(view):
    """Limits and cuts hold per fold; terms of the count at the cut enter in order."""
    folds = leave_out.folds_of(view)
    sizes = Counter(r.actor for r in view.collect())
    n_rows = np.array([sizes[a] for a in folds.actors])
    for spec in (TextFeatures(max_features=7), TextFeatures(min_df=9, max_df=0.4, max_features=None)):
        counts = term_counts(view, spec, ("example_id", "actor"))
        rows = leave_out.fold_vocabulary(counts, folds, n_rows, spec).collect()
        for f, name in enumerate(folds.names):
            train = view.where(~F.col("actor").isin(*name.split("|")))
            want = vocabulary(term_counts(train, spec), train.agg(F.count("*").alias("n")), spec).collect()
            assert {r.term: r.d_ai[f] + r.d_human[f] for r in rows if r.d_ai[f] + r.d_human[f]} == {r.term: r.df for r in want}


def test_every_split_is_chosen_as_alone(view):
    grid = [(s, c) for s in SPECS[:2] for _, c in GRID]
    least = {"train": 40, "val": 10, "test": 10}
    views = {"all": view, "few": view.where("example_id < 140"), "tiny": view.where("example_id < 20")}
    got = leave_out.nested_splits(views, grid, minimum=least).collect()
    assert sorted(r.outer_i for r in got) == list(range(36))
    want = {(a, b, c, d) for a, c in permutations(ACTORS[:3], 2) for b, d in permutations(ACTORS[3:], 2)}
    assert {(r.val_human, r.val_ai, r.test_human, r.test_ai) for r in got} == want
    assert {r.selected_view for r in got} <= {"all", "few"}
    for r in sorted(got, key=lambda r: r.outer_i)[:1]:
        four = (r.val_human, r.val_ai, r.test_human, r.test_ai)
        scored = []
        for v, name in enumerate(("all", "few")):
            for s, spec in enumerate(SPECS[:2]):
                numbered = [(v * len(grid) + s * len(GRID) + i, c) for i, c in GRID]
                found = by_one_split(views[name], spec, numbered, four)
                scored += [(k, macro(found, k, four[:2]), macro(found, k, four[2:])) for k, _ in numbered]
        best = max(scored, key=lambda x: (round(x[1], 9), -x[0]))
        assert r.selected_candidate == best[0] and r.n_train == views[r.selected_view].where(~F.col("actor").isin(*four)).count()
        assert abs(r.val_f1_macro - best[1]) < 1e-8 and abs(r.test_f1_macro - best[2]) < 1e-8


def macro(found, candidate, pair):
    (h, n_h), (a, n_a) = found[candidate, pair[0]], found[candidate, pair[1]]
    return (2 * h / (n_h + h + a) + 2 * (n_a - a) / (n_a + n_h - h + n_a - a)) / 2


def test_blank_texts_are_scored_by_the_prior(view):
    blank = view.withColumn("text", F.lit(""))
    rows = leave_out.fold_predictions(blank, SPECS[0], leave_out.folds_of(view), GRID[:4]).collect()
    assert len(rows) == 9 * 4 * 4 and all(r.n > 0 for r in rows)


def test_other_models_and_sizes(view):
    folds = leave_out.folds_of(view)
    with pytest.raises(ValueError, match="svm"):
        leave_out.fold_predictions(view, SPECS[0], folds, [(0, C("svm", {"C": 1.0}))])
    assert leave_out.nested_splits({"all": view}, [(SPECS[0], C("mnb", {"alpha": 1.0}))], minimum={"train": 10_000}).count() == 0


def test_blocks_hold_one_actor_and_get_half_the_folds(spark, view):
    """What a block is sent of a term: the sums of the folds that hold its actor out, of terms the actor has."""
    folds = leave_out.folds_of(view)
    dealt = leave_out.deal(view, folds, block_cells=200)
    actors = {r.id: r.actor for r in view.select(F.col("example_id").cast("string").alias("id"), "actor").collect()}
    rows = dealt.rows.select("block", "id").collect()
    assert len(rows) == 151 and len({r.block for r in rows}) > 6
    assert all(folds.actors[dealt.of[r.block]] == actors[r.id] for r in rows)
    df = np.zeros((2, 6), np.int32)
    df[0, 1], df[1, 2] = 3, 5
    s = np.arange(36.0).reshape(2, 18)
    batch = pa.record_batch([pa.array(["a", "b"]), *(leave_out._packed(x) for x in (df, np.full((2, 2), 255, np.uint8), s))], ["term", "df", "kept", "s"])
    sent = list(leave_out._sent(np.array([0, 1, 1, 2]), folds, True)([batch]))
    assert [(b.column("block").to_pylist(), b.column("term").to_pylist()) for b in sent] == [([1], ["a"]), ([2], ["a"]), ([3], ["b"])]
    at = np.flatnonzero(folds.held[2])
    assert np.frombuffer(sent[2].column("s")[0].as_py()).tolist() == [*s[1, at], *s[1, 9 + at]] and len(at) == 6


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_chunks_keep_the_rows_of_an_id_together(chunk):
    rows = [(0, "a", ["x"]), (0, "b", ["x", "y"]), (0, "b", ["y"]), (0, None, None), (2, "b", ["z"]), (2, "c", [])]
    names = ["block", "id", "draw", "terms"]
    batches = [pa.record_batch([pa.array([b], pa.int32()), pa.array([i], pa.string()), pa.array([0.5]), pa.array([t], pa.list_(pa.string()))], names) for b, i, t in rows]
    seen = []

    def start(block, _):
        def run(table):
            cells, terms = leave_out._counted(table, TextFeatures(), None)
            seen.extend((block, k, terms[t].as_py(), tf) for k, t, tf in zip(cells.rows[cells.example], cells.term, cells.local, strict=True))

        return run, lambda: iter([block])

    assert list(leave_out._chunks(batches, chunk, start)) == [0, 2]
    assert sorted(seen) == [(0, 1, "x", 1.0), (0, 2, "x", 1.0), (0, 2, "y", 2.0), (2, 1, "z", 1.0)]


ODD = ["a  b\tc", "  ", "", "xyz", "x\0y\0", "żółć 漢字漢字 🙂🙂 end", "Aa_b1 aa_B1 aa", "\n\nlong word word word"]


@pytest.mark.parametrize("spec", [TextFeatures(analyzer="char", ngrams=(3, 5), lowercase=False), TextFeatures(ngrams=(1, 2))])
def test_packed_examples_have_the_terms_of_their_texts(spark, spec):
    """Terms are runs of numbered units and are spelled once each; Spark makes no terms."""
    view = spark.createDataFrame([(i // 2, ACTORS[i // 2 % 2], "human", t) for i, t in enumerate([*ODD, None])], "example_id long, actor string, label string, text string")
    dealt = leave_out.deal(view, leave_out.folds_of(spark.createDataFrame([(a,) for a in ACTORS], "actor string")), spec)
    got = {}
    for block in {r.block for r in dealt.rows.select("block").collect()}:
        rows = dealt.rows.where(F.col("block") == block).orderBy("id").toArrow()
        cells, terms = leave_out._counted(rows, spec, None)
        ids = sorted(set(rows.column("id").to_pylist()))
        got |= {(int(ids[e]), terms[t].as_py()): tf for e, t, tf in zip(cells.example, cells.term, cells.local, strict=True)}
        known = pa.array(sorted(set(terms.to_pylist()))[::2], pa.string())
        some, _ = leave_out._counted(rows, spec, known)
        assert {(int(ids[e]), known[t].as_py()): tf for e, t, tf in zip(some.example, some.term, some.local, strict=True)} == {k: v for k, v in got.items() if str(k[0]) in ids and k[1] in known.to_pylist()}
        assert (np.diff(some.example) >= 0).all()
    assert got == {(r.example_id, r.term): r.tf for r in term_counts(view, spec).collect()}


def test_runs_too_long_for_a_number_are_ranked():
    rng = np.random.default_rng(5)
    unit, text = rng.integers(0, 900, 400).astype(np.int32), np.repeat(np.arange(40), 10)
    grams = leave_out._Grams(unit, text, 900, 24)
    for _ in range(5):
        grams.longer()
    runs, of = grams.whole()
    want = [unit[i : i + 6].tolist() for i in range(395) if text[i] == text[i + 5]]
    assert grams.digits(runs).tolist() == want and of.tolist() == [t for t in range(40) for _ in range(5)]


def test_texts_are_shuffled_once(spark, view):
    """A pass sends the model to where the texts are laid out."""
    folds = leave_out.folds_of(view)
    dealt = leave_out.deal(view, folds)
    model = spark.createDataFrame([], leave_out.SENT)
    plan = leave_out._met(dealt, model, SPECS[0], None, "candidate long, n long")._jdf.queryExecution().executedPlan().toString()
    counts = dealt.packed.groupBy("slot").applyInArrow(leave_out._actor_counts(dealt, SPECS[0], folds), "term string, actor string, df long, cf long")
    assert plan.count("Exchange") == 1 and "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert len({r.slot for r in dealt.packed.collect()}) == 6
