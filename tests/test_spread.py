import datetime as dt

from loomtrace.operators import features
from loomtrace.queries import sources
from loomtrace.sources import testviews


def test_tasks_grow_with_the_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(testviews, "EVENTS", 10, raising=False)
    stamp = dt.datetime(2024, 1, 1)
    rows = [(i, stamp, i % 7, "view", 1.5, "{}") for i in range(400)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    logs = testviews.v_logs(spark, str(tmp_path))
    assert logs.rdd.getNumPartitions() == 40
    assert logs.count() == 5 * 400


def test_grams_of_a_document_stay_in_its_task(spark, tmp_path, capsys):
    rows = [(i, f"some text of number {i}", "en", f"src{i}", 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    docs = testviews.v_documents(spark, str(tmp_path))
    features.term_counts(docs, features.TextFeatures()).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_log_files_do_not_multiply_with_the_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(testviews, "EVENTS", 2, raising=False)
    stamp = dt.datetime(2024, 1, 1)
    rows = [(i, stamp, 7, "view", 1.5, "{}") for i in range(400)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    files = spark.read.text(f"{sources.written_logs(spark, str(tmp_path))}/audit/*").inputFiles()
    assert len(files) == spark.sparkContext.defaultParallelism
