import datetime as dt

from pyspark.sql import functions as F

from loomtrace.operators import features, models, timing, windows
from loomtrace.plans import load, nested


def _lines(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("H"), (F.col("id") % 3).cast("string")).alias("actor"), F.lit("syslog").alias("log_type"),
        F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"),
    )


def test_windows_of_gaps_are_dealt_to_the_tasks_asked_for(spark):
    """Before, a shuffle was coalesced to as many tasks as cores, however many rows there were."""
    start = dt.datetime(2024, 1, 1)
    rows = [("H1", "syslog", start + dt.timedelta(seconds=i * i % 97 + 100 * i), i) for i in range(600)]
    events = spark.createDataFrame(rows, "actor string, log_type string, ts timestamp, tie long")
    keys = ["actor", "log_type"]
    gaps = timing.gaps(events, keys, tasks=30)
    assert gaps.rdd.getNumPartitions() == 30
    cut = windows.gap_windows(gaps, keys, size=4, stride=2, tasks=30)
    assert cut.rdd.getNumPartitions() == 30
    plain = windows.gap_windows(timing.gaps(events, keys), keys, size=4, stride=2)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))


def test_a_line_is_masked_after_it_is_laid(spark, monkeypatch):
    """Before, the mask was part of what laying the lines in order reads twice."""
    seen = []
    real = windows.along
    monkeypatch.setattr(windows, "along", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    labels = spark.createDataFrame([(f"H{i}", "human") for i in range(3)], "actor string, label string")
    config = load.LoadConfig(preprocess="soft", window="lines", size=2, stride=1)
    found = load.examples(_lines(spark, 90), labels, config, tasks=20)
    assert {r.text for r in seen[0].collect()} == {f"line {i}" for i in range(90)}
    assert "[syslog] line <NUM>" in found.first().text or "[syslog] line" in found.first().text
    assert found.count() == 3 * 29


def test_vectors_are_made_in_tasks_that_grow_with_the_texts(spark, monkeypatch):
    """Before, the rows of linear models were held three times, and made in tasks of any size."""
    words = [f"w{i}" for i in range(9)]
    rows = [(i, ("ai", "human")[i % 2], ("train", "train", "test")[i % 3], words[i % 9 : i % 9 + 4] + [f"c{i % 2}"]) for i in range(120)]
    examples = spark.createDataFrame([r[:3] for r in rows], "example_id long, label string, part string")
    counts = spark.createDataFrame([(r[0], w, 1) for r in rows for w in r[3]], "example_id long, term string, tf long")
    seen = []
    real = models.predict_linear
    monkeypatch.setattr(nested, "EXAMPLES", 10)
    monkeypatch.setattr(models, "predict_linear", lambda ready, *a, **k: seen.append((ready, k)) or real(ready, *a, **k))
    spec = features.TextFeatures(max_df=1.0)
    found = nested.text_predictions(examples, counts, spec, [(0, models.Candidate("svm", {"C": 1.0}))]).collect()
    assert len(found) == 40 and all(r.y_pred == r.y_true for r in found)
    assert seen[0][1] == {"pinned": True} and seen[0][0].rdd.getNumPartitions() >= 12
    assert not seen[0][0].is_cached
