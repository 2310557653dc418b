"""Statistics and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.text import to_finite
from loomtrace.operators.groupstats import CLASSES, TESTS

# The columns of a statistics file, in order.
TEXTS = (
    "timestamp_utc",
    "approach",
    "distance_name",
    "ordered_labels_json",
    "hyperparameters_json",
    "group_summaries_json",
    "silhouette_json",
    "mannwhitney_json",
)
NUMBERS = (
    *[f"{c}_{s}" for c in CLASSES for s in ("n", "mean", "median", "std")],
    *[f"silhouette_{s}_mean" for s in ("overall", "ai", "human")],
    *[f"mw_{t}_{s}" for t in TESTS for s in ("u", "p", "cliffs_delta")],
)
STATISTICS = (*TEXTS, *NUMBERS)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Statistics files with numbers parsed, parameters as a map and the source named."""
    schema = ", ".join(f"{c} string" for c in STATISTICS)
    raw = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("escape", '"')
        .csv(path)
    )
    return raw.select(
        F.col("_metadata.file_path").alias("source_file"),
        "approach",
        "distance_name",
        F.from_json("ordered_labels_json", "array<string>").alias("ordered_labels"),
        F.from_json("hyperparameters_json", "map<string,string>").alias("hyperparameters"),
        *[to_finite(F.col(c)).alias(c) for c in NUMBERS],
    )


def statistics_rows(
    report: DataFrame,
    *,
    approach: str,
    distance_name: Column,
    labels: Column,
    hyperparameters: Column,
) -> DataFrame:
    """A group report in the layout of a statistics file; nested parts are JSON text."""

    def summary(name: str) -> Column:
        return F.struct(*[F.col(f"{name}_{s}").alias(s) for s in ("mean", "median", "n", "std")]).alias(name)

    def test(name: str) -> Column:
        cells = (("cliffs_delta", "cliffs_delta"), ("p", "p_value"), ("u", "u_statistic"))
        return F.struct(*[F.col(f"mw_{name}_{c}").alias(a) for c, a in cells]).alias(name)

    silhouette = F.struct(
        *[F.col(f"silhouette_{s}_mean").alias(f"{s}_mean") for s in ("ai", "human", "overall")]
    )
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return report.select(
        stamp.alias("timestamp_utc"),
        F.lit(approach).alias("approach"),
        distance_name.alias("distance_name"),
        F.to_json(labels).alias("ordered_labels_json"),
        F.to_json(hyperparameters).alias("hyperparameters_json"),
        F.to_json(F.struct(*[summary(c) for c in CLASSES])).alias("group_summaries_json"),
        F.to_json(silhouette).alias("silhouette_json"),
        F.to_json(F.struct(*[test(t) for t in TESTS])).alias("mannwhitney_json"),
        *NUMBERS,
    )


def append_statistics(rows: DataFrame, path: str) -> None:
    """Append statistics rows; every file carries the header once."""
    ready = rows.select(*STATISTICS)
    ready.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def write_results(results: DataFrame, path: str, *, order: str = "outer_i") -> None:
    """One result row per outer split, sorted; there are as many rows as splits."""
    results.orderBy(order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_results(
    spark: SparkSession, path: str, metric: str, *, name: str | None = None
) -> DataFrame:
    """Result files: (source, outer_i, metric). Blanks are skipped.

    `name` keeps the files with `_<name>_` in their path. A file without the metric
    column, or with no value in it, is an error.
    """
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    if metric not in raw.columns:
        raise ValueError(f"no column {metric!r} in {path}")
    source = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    rows = raw.select(
        source.alias("source"),
        F.col("outer_i").try_cast("long").alias("outer_i"),
        to_finite(F.col(metric)).alias(metric),
    )
    if name is not None:
        rows = rows.where(F.col("source").contains(f"_{name}_"))
    filled = rows.groupBy("source").agg(F.count(metric).alias("n")).where(F.col("n") == 0)
    empty = [r["source"] for r in filled.limit(5).collect()]
    if empty:
        raise ValueError(f"no values of {metric!r} in {empty}")
    return rows.where(F.col(metric).isNotNull())


# Display names of models.
LABELS = {
    "cnn": "CNN",
    "transformer": "Transformer",
    "llm": "LLM",
    "sentence_transformer": "SentenceTransformer",
    "sentence-transformer": "SentenceTransformer",
    "tfidf_logreg": "TF-IDF + Logistic Regression",
    "tfidf_svm": "TF-IDF + SVM",
    "tfidf_linear_svm": "TF-IDF + SVM",
    "tfidf_logistic_regression": "TF-IDF + Logistic Regression",
    "dummy_stratified": "Dummy (stratified)",
    "dummy_most_frequent": "Dummy (most frequent)",
    "most_frequent": "Dummy (most frequent)",
    "stratified": "Dummy (stratified)",
    "ridge": "Ridge Classifier",
    "gaussian_nb": "Gaussian Naive Bayes",
    "multinomial_nb": "Multinomial Naive Bayes",
    "bernoulli_nb": "Bernoulli Naive Bayes",
    "complement_nb": "Complement Naive Bayes",
    "sgd_hinge": "SGD (hinge)",
    "sgd_log": "SGD (log-loss)",
    "sgd_log_loss": "SGD (log-loss)",
    "pa_like": "PA-like",
    "knn": "kNN",
    "random_forest": "Random Forest",
}
WORDS = {
    "tfidf": "TF-IDF",
    "svm": "SVM",
    "cnn": "CNN",
    "llm": "LLM",
    "knn": "kNN",
    "nb": "NB",
    "logreg": "Logistic Regression",
    "pa": "PA",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*flat), key)


def model_label(file_name: Column) -> Column:
    """Display name of a result file: known models by table, others word by word."""
    stem = F.regexp_replace(F.substring_index(file_name, "/", -1), r"\.[^.]*$", "")
    model = F.regexp_replace(F.substring_index(stem, "_nested_", 1), r"_[0-9]+$", "")
    spoken = F.transform(
        F.split(model, "_"),
        lambda w: F.coalesce(
            _lookup(WORDS, F.lower(w)), F.initcap(F.replace(w, F.lit("-"), F.lit(" ")))
        ),
    )
    return F.coalesce(_lookup(LABELS, F.lower(model)), F.array_join(spoken, " "))
