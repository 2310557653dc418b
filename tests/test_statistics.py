from itertools import combinations

import math

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import distributions as dist
from loomtrace.operators import evaluation, nulls, ranking, ranktests, sequences, splits
from loomtrace.operators import groupstats as gs

COUNTS = [("A", "a", 2), ("A", "b", 2), ("B", "a", 1), ("B", "c", 3), ("C", "z", 4)]


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "actor string, token string, cnt long")


def test_pair_distances(spark, counts):
    silent = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "actor string")
    found = {(r["actor_1"], r["actor_2"]): r for r in dist.pair_distances(counts, silent).collect()}
    assert len(found) == 6
    assert found["A", "B"]["l1"] == pytest.approx(1.5)
    assert found["A", "B"]["js"] == pytest.approx(0.67413, abs=1e-5)
    assert found["A", "C"]["l1"] == pytest.approx(2.0)
    assert found["A", "C"]["js"] == pytest.approx(math.sqrt(math.log(2)))
    assert found["A", "D"]["l1"] is None and found["A", "D"]["js"] is None


def test_spread_tokens_change_nothing(counts):
    one = dist.pair_distances(counts).orderBy("actor_1", "actor_2").collect()
    many = dist.pair_distances(counts, tasks_per_token=3).orderBy("actor_1", "actor_2").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in many]


# Published sample sizes and statistics with their published p-values.
@pytest.mark.parametrize(
    "u, p",
    [(96, 2.6805e-05), (94, 0.00010722), (92, 0.00032166), (90, 0.000804149), (82, 0.0104003),
     (80, 0.0169944), (73, 0.070095), (54, 0.693123), (53, 0.746814)],
)
def test_exact_u_probabilities(u, p):
    assert ranktests.mann_whitney_p(u, 16, 6, 0.0) == pytest.approx(p, rel=2e-5)


def test_u_by_direct_count(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 0.5, 7.0]
    rows = [("k", "x", v) for v in x] + [("k", "y", v) for v in y]
    got = ranktests.rank_sums(spark.createDataFrame(rows, "k string, side string, value double"), ["k"]).first()
    want = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert got["u"] == want
    assert got["cliffs_delta"] == pytest.approx(2 * want / 12 - 1)
    assert got["ties"] == 24.0


def test_signed_rank_small_case():
    # ranks 1..5, one negative of rank 2: W = 2; P(W <= 2) = 3 / 32
    assert ranktests.signed_rank_p(2.0, 5, 0.0, 0) == pytest.approx(6 / 32)


def test_silhouette_and_labelings(spark):
    pairs = [("GPT1", "GPT2", 0.2), ("H1", "H2", 0.4)] + [(g, h, 1.0) for g in ("GPT1", "GPT2") for h in ("H1", "H2")]
    df = spark.createDataFrame(pairs, "actor_1 string, actor_2 string, distance double").withColumn("c", F.lit("x"))
    actors = spark.createDataFrame([("GPT1",), ("GPT2",), ("H1",), ("H2",)], "actor string")
    got = gs.group_report(df, gs.true_assignment(actors), ["c"]).first()
    assert got["silhouette_ai_mean"] == pytest.approx(0.8)
    assert got["silhouette_human_mean"] == pytest.approx(0.6)
    assert got["silhouette_overall_mean"] == pytest.approx(0.7)
    assert got["ai_ai_std"] == 0.0 and got["ai_human_n"] == 4
    assert gs.indexed_assignments(actors).select("idx").distinct().count() == 5
    assert gs.n_assignments(10, 4) == 209 and gs.n_assignments(8, 4) == 69
    with pytest.raises(ValueError):
        gs.indexed_assignments(actors, indices=[5])
    drawn = gs.sampled_assignments(actors, 4).groupBy("idx").agg(F.count_if(F.col("label") == "ai").alias("n"))
    assert [r["n"] for r in drawn.collect()] == [2] * 4


def test_profile(spark):
    rows = [("a", str(i), c) for i, c in enumerate((1, 1, 2, 4))]
    df = spark.createDataFrame(rows, "actor string, token string, cnt long")
    got = sequences.profile(df, ["actor"], gated=False).first()
    assert got["gini"] == pytest.approx(0.3125)
    assert got["entropy"] == pytest.approx(1.75)
    assert got["mad"] == pytest.approx(1.0)
    gated = sequences.profile(df, ["actor"]).first()
    assert gated["gini"] is None and gated["kurtosis"] is None


@pytest.mark.parametrize("tail, p", [("right", 0.6), ("left", 0.8), ("two-sided", 1.0)])
def test_empirical_p(spark, tail, p):
    null = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "k string, value double")
    seen = spark.createDataFrame([("a", 3.0)], "k string, value double")
    assert nulls.empirical_p(null, seen, ["k"], tail=tail).first()["p_value"] == pytest.approx(p)
    assert nulls.empirical_p(null.drop("k"), seen.drop("k"), [], tail=tail).first()["p_value"] == pytest.approx(p)


def test_ranks(spark):
    rows = [(1, 0.9, 5.0, None), (2, 0.9, 5.0, 1.0), (3, 0.5, 5.0, 2.0)]
    columns = ", ".join(f"{c} double" for c in ranking.CORE)
    df = spark.createDataFrame(rows, f"i int, {columns}")
    got = {r["i"]: r for r in ranking.competition_ranks(ranking.min_max(df)).collect()}
    first, last = (f"{ranking.CORE[0]}_rank", f"{ranking.CORE[2]}_rank")
    assert [got[i][first] for i in (1, 2, 3)] == [1.0, 1.0, 3.0]
    assert [got[i][last] for i in (1, 2, 3)] == [None, 2.0, 1.0]
    assert all(got[i][f"{ranking.CORE[1]}_norm"] == 1.0 for i in (1, 2, 3))


@pytest.mark.parametrize("side", ["ai", "human"])
def test_labelings_come_in_lexicographic_order(spark, side):
    names = ["GPT1", "GPT2", "H1", "H2", "H3"]
    actors = spark.createDataFrame([(n,) for n in names], "actor string")
    true = tuple(n for n in names if n.startswith("GPT") == (side == "ai"))
    want = [s for s in combinations(names, len(true)) if s != true]
    got = {}
    for r in gs.indexed_assignments(actors, side=side).collect():
        got.setdefault(r["idx"], set())
        if r["label"] == side:
            got[r["idx"]].add(r["actor"])
    assert [got[i] for i in range(len(want))] == [set(s) for s in want]
    some = gs.indexed_assignments(actors, side=side, indices=[3, 7]).where(F.col("label") == side).collect()
    assert {(r["idx"], r["actor"]) for r in some} == {(i, a) for i in (3, 7) for a in want[i]}


def test_many_labelings_need_no_list(spark):
    actors = spark.createDataFrame([(f"{'GPT' if i % 2 else 'H'}{i:02d}",) for i in range(60)], "actor string")
    total = gs.n_assignments(60, 30)
    last = gs.indexed_assignments(actors, indices=[0, total - 1]).where("label = 'ai'").groupBy("idx").count().collect()
    assert {(r["idx"], r["count"]) for r in last} == {(0, 30), (total - 1, 30)}
    assert gs.labeling_counts(actors).first()["n"] == total


@pytest.mark.parametrize("humans, n", [(6, 360), (4, 144)])
def test_outer_splits(spark, humans, n):
    actors = spark.createDataFrame([(f"H{i}",) for i in range(humans)] + [(f"GPT{i}",) for i in range(4)], "actor string")
    found = splits.outer_splits(actors).collect()
    assert sorted(r["outer_i"] for r in found) == list(range(n))
    assert len({tuple(r)[1:] for r in found}) == n
    assert splits.outer_splits(actors, limit=5).count() == 5


def test_fixed_split_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "actor string")
    with pytest.raises(ValueError):
        splits.fixed_split(df, ["a"], ["a"])
    with pytest.raises(ValueError):
        splits.require_parts(splits.fixed_split(df, ["a"], ["b"]))


def test_scores_of_a_perfect_run(spark):
    rows = [("r", "test", i, y, y) for i, y in enumerate(["ai", "human", "human"])]
    df = spark.createDataFrame(rows, "run_id string, part string, example_id long, y_true string, y_pred string")
    got = evaluation.scores(df).first()
    assert got["mcc"] == pytest.approx(1.0) and got["cohen_kappa"] == pytest.approx(1.0) and got["f1_macro"] == 1.0


def test_kurtosis_of_over_a_million_items(spark):
    from loomtrace.operators.sequences import profile

    n = 1_200_000
    counts = spark.range(n).selectExpr("'a' AS actor", "id AS token", "1 + id % 3 AS cnt")
    row = profile(counts, ["actor"]).first()
    assert row["n_distinct"] == n and row["kurtosis"] == pytest.approx(-1.5, abs=1e-4)
