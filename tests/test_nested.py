from loomtrace.operators import models
from loomtrace.plans import nested


def test_every_timing_candidate_is_scored(spark):
    rows = [
        (i, [float(i % 7 + 5 * (i % 2)), float(i % 3), 1.0], ("ai", "human")[i % 2], ("train", "train", "train", "val", "test")[i % 5])
        for i in range(120)
    ]
    examples = spark.createDataFrame(rows, "example_id long, gaps array<double>, label string, part string")
    kinds = {c.model: (i, c) for i, c in enumerate(models.timing_candidates())}
    found = nested.timing_predictions(examples, "gaps", list(kinds.values()))
    got = {(r.candidate, r.part): r.n for r in found.groupBy("candidate", "part").count().withColumnRenamed("count", "n").collect()}
    assert got == {(i, part): 24 for i, _ in kinds.values() for part in ("val", "test")}


def test_the_timing_query_takes_the_whole_grid(spark, monkeypatch):
    from loomtrace.queries import learning

    seen = []
    monkeypatch.setattr(learning, "padded_windows", lambda *a: None)
    monkeypatch.setattr(learning.nested, "timing_predictions", lambda rows, array, grid: seen.extend(grid))
    monkeypatch.setattr(learning.evaluation, "scores", lambda *a: None)
    learning.timing_grid(spark, "")
    assert [i for i, _ in seen] == list(range(67))
    assert [c.model for _, c in seen] == [c.model for c in models.timing_candidates()]


def test_a_step_has_no_more_tasks_than_the_cluster_runs_at_twice(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id AS example_id", "IF(id % 2 = 0, 'ai', 'human') AS label", "IF(id % 5 = 0, 'test', 'train') AS part", "array(double(id)) AS x")
    seen = []
    monkeypatch.setattr(models, "ROWS_PER_TASK", 1)
    fitted = models.fit_linear
    monkeypatch.setattr(models, "fit_linear", lambda train, *a: seen.append(train.rdd.getNumPartitions()) or fitted(train, *a))
    models.predict_linear(models.dense_rows(rows.repartition(60), "x"), models.Candidate("ridge", {"alpha": 1.0}))
    assert seen == [2 * spark.sparkContext.defaultParallelism]


def test_cells_of_texts_are_neither_pinned_nor_shuffled(spark, tmp_path, monkeypatch):
    from loomtrace.operators.features import tfidf
    from loomtrace.queries import learning

    spark.range(40).selectExpr("id AS doc_id", "concat('some text ', id % 7, ' of words') AS text", "'en' AS lang", "concat('s', id % 8) AS source").write.parquet(str(tmp_path / "documents.parquet"))
    pinned, anchored = [], learning.anchor
    monkeypatch.setattr(learning, "anchor", lambda df: pinned.append(df.columns) or anchored(df))
    _, _, counts, vocab = learning.text_features(spark, str(tmp_path), learning.CHAR3, pinned=False)
    assert pinned == [["term", "df", "cf", "n"]]
    plan = tfidf(counts, vocab, learning.CHAR3)._jdf.queryExecution().executedPlan().toString()
    # the documents are dealt once; the vocabulary is broadcast
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1
