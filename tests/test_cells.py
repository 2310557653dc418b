import numpy as np
import pytest

from loomtrace.operators import models, neighbours

SCHEMA = "id long, label string, vector array<float>"


def _by_force(queries, bank, ks, weights):
    out = {}
    for i, _, v in queries:
        rows = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j, c) for j, c, w in bank if j != i and c)
        for k in ks:
            near, votes = rows[:k], {}
            touch = any(d == 0 for d, _, _ in near)
            for d, _, c in near:
                votes[c] = votes.get(c, 0) + (1.0 if weights == "uniform" else float(d == 0) if touch else 1 / d)
            out[i, k] = min(votes, key=lambda c: (-round(votes[c], 9), c))
    return out


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("shared", [False, True])
def test_votes_of_many_small_cells_are_exact(spark, monkeypatch, weights, shared):
    """Equal vectors, far ones, cells of unequal size, and queries that are bank rows."""
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 20)
    draw = np.random.default_rng(3)
    points = np.concatenate([np.zeros((60, 3)), draw.integers(0, 5, (200, 3)), 50 * draw.random((200, 3)), [[1e4, 0, 0]]])
    rows = [(i, ("ai", "human")[int(draw.integers(2))], [float(x) for x in np.float32(p)]) for i, p in enumerate(points)]
    rows = [rows[i] for i in draw.permutation(len(rows))]
    bank, queries = (rows, rows[::3]) if shared else (rows[100:] + [(900, None, [0.0, 0.0, 0.0])], rows[:100])
    real = neighbours.nearest_in_space
    monkeypatch.setattr(neighbours, "nearest_in_space", lambda q, b, k: real(q, b, k, cell_rows=8))
    frames = (spark.createDataFrame(part, SCHEMA) for part in (queries, bank))
    found = neighbours.knn_vote(*frames, [1, 4], weights=weights).collect()
    assert len(found) == 2 * len(queries)
    assert {(r.id, r.k): r.y_pred for r in found} == _by_force(queries, bank, [1, 4], weights)


def test_no_pair_of_blocks_is_made(spark):
    """Before, every query went to every block of the bank: rows shuffled grew with the square."""
    rows = [(i, ("ai", "human")[i % 2], [float(i % 97), float(i % 89)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    queries, asked, found = neighbours.nearest_in_space(frame.where("id % 2 = 0").drop("label"), frame.where("id % 2 = 1"), 3, cell_rows=50)
    assert queries.count() == 2000 and found.count() == 3 * asked.count()
    cells = neighbours.Cells(np.array([r[2] for r in rows]), 80)
    points = np.array([r[2] for r in rows])
    home = cells.of(points)
    for c in np.unique(home):
        mine = points[home == c]
        assert max(len(v) for v in cells.within(mine, np.full(len(mine), 1.0), c)) < 12


def test_gaussian_bayes_scores_an_example_in_place(spark, capsys):
    rows = [(i, ("train", "test")[i % 5 == 0], ("ai", "human")[i % 2], [float(i % 7), float(i % 2 + i % 3)]) for i in range(60)]
    split = spark.createDataFrame(rows, "example_id long, part string, label string, x array<double>")
    found = models.gaussian_bayes(split, "x", smoothing=(1e-9, 1e-6))
    assert found.count() == 120
    found.explain()
    assert "example_id" not in "".join(x for x in capsys.readouterr().out.splitlines() if "Exchange" in x)
    train = [r for r in rows if r[1] == "train"]
    value = np.array([r[3] for r in train])
    side = {c: value[[r[2] == c for r in train]] for c in ("ai", "human")}
    lift = 1e-6 * value.var(0).max()
    prior = np.log(len(side["human"]) / len(side["ai"]))
    for r in found.where("smoothing = 1e-6").collect():
        x = np.array(rows[r.example_id][3])
        part = {c: (-0.5 * np.log(2 * np.pi * (v.var(0) + lift)) - 0.5 * (x - v.mean(0)) ** 2 / (v.var(0) + lift)).sum() for c, v in side.items()}
        assert r.score == pytest.approx(prior + part["human"] - part["ai"])
