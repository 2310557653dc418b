import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomtrace.llm import jaccard, lines, mixing, pieces
from loomtrace.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    assert compare(name, QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_every_document(spark, name):
    got = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name == "op4_secret_scan":
        assert got.join(docs, "doc_id", "left_anti").count() == 0
    else:
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert got.count() == docs.count()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and made, and the name of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for given, made in stages[:-1]:
        assert made.schema.names == given.schema.names


def test_quality_and_lines(stages):
    (given, good), (_, deduped) = stages[:2]
    assert 0 < good.count() < given.count()
    assert good.exceptAll(given).count() == 0
    want = lines.without_common_lines(good).select("doc_id", "text")
    assert deduped.select("doc_id", "text").exceptAll(want).count() == 0
    assert deduped.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_one_of_each_component(stages):
    given, made = stages[2]
    found = jaccard.link_components(given)
    assert made.count() == found.select("component_id").distinct().count()
    assert made.join(found.filter("doc_id = component_id"), "doc_id", "left_anti").count() == 0


def test_mix(stages):
    given, made = stages[3]
    taken = mixing.mixture(given).agg(F.sum("taken")).first()[0]
    assert mixing._sizes(made, "doc_id").agg(F.sum("size")).first()[0] == taken


def test_ids_decode_to_the_texts(stages):
    given, made = stages[4]
    texts = pieces.decode(made, pieces.load_model()).select("doc_id", F.col("decoded").alias("text"))
    assert texts.exceptAll(given.select("doc_id", "text")).count() == 0
    assert texts.count() == given.count()


def test_run(spark, stages):
    got = P.run(spark, SF)
    assert got.exceptAll(stages[-1][1]).count() == 0 and got.count() == stages[-1][1].count()


def test_empty_documents(spark, stages):
    docs = stages[0][0].limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
