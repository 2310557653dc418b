"""Classifiers over long features and over arrays.

Naive Bayes is counting, so it is written as grouped sums: every smoothing value of a
grid is scored in the same job. Linear models and forests come from Spark's ML library.
In two-class work `ai` sorts before `human`, so `human` is the positive class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.evaluation import majority_label

CLASSES = ("ai", "human")
BAYES = ("multinomial", "complement", "bernoulli")


# ---- reference guesses ----


def predict_majority(split: DataFrame, *, label: str = "label") -> DataFrame:
    """Every row gets the most frequent training label."""
    return split.join(F.broadcast(majority_label(split, label=label)))


def predict_stratified(
    split: DataFrame, *, id_column: str = "example_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """Random labels in the training proportions; the draw is a hash of the row id."""
    train = split.where(F.col("part") == "train")
    share = train.agg((F.count(F.when(F.col(label) == CLASSES[0], 1)) / F.count("*")).alias("_share"))
    mixed = F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed))))
    draw = F.conv(F.substring(mixed, 1, 8), 16, 10).cast("double") / 4294967296.0
    guess = F.when(draw < F.col("_share"), CLASSES[0]).otherwise(CLASSES[1])
    return split.join(F.broadcast(share)).withColumn("y_pred", guess).drop("_share")


# ---- naive Bayes ----


@dataclass(frozen=True)
class Bayes:
    """Fitted class terms: per term one weight per class, per class one base value."""

    terms: DataFrame  # alpha, term, w_ai, w_human
    base: DataFrame  # alpha, b_ai, b_human (one row per alpha)


def _per_class(value: Column) -> list[Column]:
    return [
        F.sum(F.when(F.col("label") == c, value).otherwise(0.0)).alias(f"s_{c}") for c in CLASSES
    ]


def fit_bayes(
    features: DataFrame,
    examples: DataFrame,
    *,
    kind: str = "multinomial",
    alphas: Sequence[float] = (0.1,),
    vocab: DataFrame | None = None,
) -> Bayes:
    """Fit from long training features (example_id, label, term, weight).

    `examples` are all training rows (label), also those without features. `vocab`
    (term) lists the terms of the model; without it the terms of the features are used.
    """
    if kind not in BAYES:
        raise ValueError(f"kind must be one of {BAYES}, got {kind!r}")
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    weight = F.lit(1.0) if kind == "bernoulli" else F.col("weight")
    sums = features.groupBy("term").agg(*_per_class(weight))
    if vocab is not None:
        sums = vocab.select("term").join(sums, "term", "left").na.fill(0.0, ["s_ai", "s_human"])
    sums = sums.withColumn("alpha", F.explode(grid))
    counts = examples.agg(
        *[F.count(F.when(F.col("label") == c, 1)).alias(f"n_{c}") for c in CLASSES]
    )
    alpha = F.col("alpha")
    totals = sums.groupBy("alpha").agg(
        F.sum("s_ai").alias("t_ai"), F.sum("s_human").alias("t_human"), F.count("*").alias("v")
    )
    size = totals.join(F.broadcast(counts))
    joined = sums.join(F.broadcast(size), "alpha")
    n_all = F.col("n_ai") + F.col("n_human")
    prior = {c: F.log(F.col(f"n_{c}") / n_all) for c in CLASSES}
    if kind == "multinomial":
        w = {
            c: F.log((F.col(f"s_{c}") + alpha) / (F.col(f"t_{c}") + alpha * F.col("v")))
            for c in CLASSES
        }
    elif kind == "complement":
        other = {"ai": "human", "human": "ai"}
        w = {
            c: -F.log((F.col(f"s_{o}") + alpha) / (F.col(f"t_{o}") + alpha * F.col("v")))
            for c, o in other.items()
        }
        prior = {c: F.lit(0.0) for c in CLASSES}
    else:
        on = {c: F.log((F.col(f"s_{c}") + alpha) / (F.col(f"n_{c}") + 2 * alpha)) for c in CLASSES}
        off = {c: F.log(1 - F.exp(on[c])) for c in CLASSES}
        w = {c: on[c] - off[c] for c in CLASSES}
        rest = joined.groupBy("alpha").agg(*[F.sum(off[c]).alias(f"off_{c}") for c in CLASSES])
        size = size.join(rest, "alpha")
        prior = {c: prior[c] + F.col(f"off_{c}") for c in CLASSES}
    terms = joined.select("alpha", "term", *[w[c].alias(f"w_{c}") for c in CLASSES])
    base = size.select("alpha", *[prior[c].alias(f"b_{c}") for c in CLASSES])
    return Bayes(terms, base)


def predict_bayes(
    model: Bayes,
    features: DataFrame,
    examples: DataFrame,
    *,
    binary: bool = False,
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """(alpha, keep.., score, y_pred): `score` is the log odds of `human`."""
    weight = F.lit(1.0) if binary else F.col("weight")
    gain = F.sum(weight * (F.col("w_human") - F.col("w_ai")))
    sums = features.join(model.terms, "term").groupBy("alpha", *keep).agg(gain.alias("_gain"))
    every = examples.select(*keep).join(F.broadcast(model.base))
    score = F.coalesce("_gain", F.lit(0.0)) + F.col("b_human") - F.col("b_ai")
    scored = every.join(sums, ["alpha", *keep], "left").withColumn("score", score)
    return scored.select(
        "alpha", *keep, "score", F.when(F.col("score") > 0, "human").otherwise("ai").alias("y_pred")
    )


# The smoothing grid of the timing model, ten steps from 1e-12 to 1e-6.
GAUSS_GRID = tuple(10.0 ** (-12 + 6 * i / 9) for i in range(10))


def gaussian_bayes(
    split: DataFrame,
    array: str,
    *,
    smoothing: Sequence[float] = (1e-9,),
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """Gaussian naive Bayes over arrays; (smoothing, keep.., part, score, y_pred).

    Every variance is raised by `smoothing` times the largest variance of a position. The
    model is one row per smoothing, and an example is scored where it stands.
    """
    train = split.where(F.col("part") == "train")
    cells = train.select("label", F.posexplode(array).alias("i", "x"))
    fit = cells.groupBy("i").agg(
        *[F.avg(F.when(F.col("label") == c, F.col("x"))).alias(f"m_{c}") for c in CLASSES],
        *[F.var_pop(F.when(F.col("label") == c, F.col("x"))).alias(f"v_{c}") for c in CLASSES],
        F.var_pop("x").alias("_all"),
    )
    places = F.array_sort(F.collect_list(F.struct("i", *[f"{s}_{c}" for s in "mv" for c in CLASSES])))
    fitted = fit.agg(places.alias("_fit"), F.max("_all").alias("_top"))
    rows = train.agg(
        *[F.count(F.when(F.col("label") == c, 1)).alias(f"n_{c}") for c in CLASSES]
    )
    grid = F.array(*[F.lit(float(s)) for s in smoothing])
    model = fitted.join(F.broadcast(rows)).withColumn("smoothing", F.explode(grid))
    total = F.col("n_ai") + F.col("n_human")
    prior = F.log(F.col("n_human") / total) - F.log(F.col("n_ai") / total)

    def odds(x: Column, f: Column) -> Column:
        terms = {}
        for c in CLASSES:
            var = f[f"v_{c}"] + F.col("smoothing") * F.col("_top")
            miss = x - f[f"m_{c}"]
            terms[c] = -0.5 * F.log(2 * math.pi * var) - 0.5 * miss * miss / var
        return terms["human"] - terms["ai"]

    both = split.where(F.size(array) > 0).join(F.broadcast(model.where(F.size("_fit") > 0)))
    known = both.withColumn("_odds", F.filter(F.zip_with(array, "_fit", odds), lambda o: o.isNotNull()))
    gain = F.when(F.size("_odds") > 0, F.aggregate("_odds", F.lit(0.0), lambda s, o: s + o))
    scored = known.select("smoothing", *keep, "part", "label", (gain + prior).alias("score"))
    guess = F.when(F.col("score") > 0, "human").otherwise("ai")
    return scored.withColumn("y_pred", guess)


# ---- Spark ML estimators ----


def sparse_rows(
    features: DataFrame, vocab: DataFrame, size: int, keep: Sequence[str]
) -> DataFrame:
    """Long features as one sparse vector per example; `vocab` has (term, index)."""

    @F.udf(VectorUDT())
    def build(cells):
        return SparseVector(size, [(c["index"], c["weight"]) for c in cells])

    placed = features.join(F.broadcast(vocab), "term")
    cells = F.array_sort(F.collect_list(F.struct("index", "weight")))
    return placed.groupBy(*keep).agg(build(cells).alias("features"))


def dense_rows(split: DataFrame, array: str) -> DataFrame:
    doubles = F.transform(array, lambda x: x.cast("double"))
    return split.withColumn("features", array_to_vector(doubles))


def balanced(split: DataFrame) -> DataFrame:
    """Weights n / (classes * n of the class), from training rows."""
    train = split.where(F.col("part") == "train")
    counts = train.groupBy("label").agg(F.count("*").alias("_n"))
    both = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(both)).select(
        "label", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight")
    )
    return split.join(F.broadcast(weights), "label", "left").na.fill(1.0, ["weight"])


ROWS_PER_TASK = 5_000
LINEAR = ("svm", "logreg", "sgd_hinge", "sgd_log", "ridge", "rf")


@dataclass(frozen=True)
class Candidate:
    """A model family with its parameters."""

    model: str
    params: dict = field(default_factory=dict, hash=False)


def fit_linear(train: DataFrame, candidate: Candidate, n_train: int):
    """Fit one Spark ML model on (features, target, weight); target 1 is `human`.

    Penalties are translated: C weighs the summed loss, so its counterpart per row is
    1 / (C * n); alpha of the stochastic learners is already per row.
    """
    few = 1e-3 if candidate.model.startswith("sgd") else 1e-4  # fixed values: tolerances
    p = candidate.params
    common = {"featuresCol": "features", "labelCol": "target"}
    if candidate.model == "rf":
        return RandomForestClassifier(
            **common, numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=42
        ).fit(train)
    if candidate.model == "ridge":
        signed = train.withColumn("target", 2 * F.col("target") - 1)
        return LinearRegression(
            **common, regParam=p.get("alpha", 1.0) / n_train, standardization=False,
            solver="l-bfgs", tol=few,
        ).fit(signed)
    strength = p["alpha"] if candidate.model.startswith("sgd") else 1.0 / (p.get("C", 1.0) * n_train)
    common["weightCol"] = "weight"
    if candidate.model in ("svm", "sgd_hinge"):
        return LinearSVC(
            **common, regParam=strength, standardization=False, maxIter=100, tol=few
        ).fit(train)
    if candidate.model in ("logreg", "sgd_log"):
        return LogisticRegression(
            **common, regParam=strength, standardization=False, maxIter=100, tol=few
        ).fit(train)
    raise ValueError(f"unknown model {candidate.model!r}; known: {LINEAR}")


def predict_linear(
    split: DataFrame, candidate: Candidate, keep: Sequence[str] = ("example_id",), *, pinned: bool = False
) -> DataFrame:
    """Fit on the training part and predict all parts: (keep.., part, label, y_pred).

    Every optimiser step is a job, so training rows go to few tasks, and to no more than the
    cluster runs at twice. The steps read blocks that the estimator holds, so rows that are
    `pinned` are not held once more.
    """
    ready = balanced(split).withColumn("target", (F.col("label") == "human").cast("double"))
    train = ready.where(F.col("part") == "train")
    held = train if pinned else train.persist()
    n_train = max(1, held.count())
    tasks = min(math.ceil(n_train / ROWS_PER_TASK), 2 * split.sparkSession.sparkContext.defaultParallelism)
    model = fit_linear(held.coalesce(tasks), candidate, n_train)
    if not pinned:
        held.unpersist()
    out = model.transform(ready.drop("weight"))
    positive = F.col("prediction") > (0.0 if candidate.model == "ridge" else 0.5)
    return out.select(
        *keep, "part", "label", F.when(positive, "human").otherwise("ai").alias("y_pred")
    )


# ---- candidate grids ----


def text_candidates() -> list[tuple[dict, Candidate]]:
    """The text grid as (feature settings, candidate)."""
    char = [{"analyzer": "char", "ngrams": g, "lowercase": False} for g in ((3, 5), (4, 6), (5, 7))]
    word = [{"analyzer": "word", "ngrams": g} for g in ((1, 1), (1, 2))]
    rows = [
        ({"analyzer": "word", "ngrams": (1, 1), "min_df": 1, "max_df": 1.0, "max_features": 1000,
          "sublinear": False}, Candidate(m))
        for m in ("dummy_most_frequent", "dummy_stratified")
    ]
    for spec in (*char, *word):
        for c in (0.3, 1.0, 3.0):
            rows += [(spec, Candidate(m, {"C": c})) for m in ("svm", "logreg")]
        for alpha in (1e-5, 1e-4):
            rows += [(spec, Candidate(m, {"alpha": alpha})) for m in ("sgd_hinge", "sgd_log")]
        rows += [(spec, Candidate("ridge", {"alpha": a})) for a in (1.0, 10.0, 100.0)]
        kinds = ("mnb", "cnb", "bnb") if spec["analyzer"] == "char" else ("mnb", "cnb")
        rows += [(spec, Candidate(m, {"alpha": a})) for a in (0.01, 0.1, 1.0) for m in kinds]
    presence = {"analyzer": "word", "ngrams": (1, 2), "sublinear": False, "binary": True}
    rows += [(presence, Candidate("bnb", {"alpha": a})) for a in (0.1, 1.0)]
    return rows


def timing_candidates() -> list[Candidate]:
    """The timing grid."""
    alphas = (1e-7, 3e-7, 1e-6, 3e-6, 1e-5, 3e-5, 1e-4, 3e-4, 1e-3)
    rows = [Candidate("dummy_most_frequent"), Candidate("dummy_stratified")]
    rows += [Candidate("gnb", {"var_smoothing": s}) for s in GAUSS_GRID]
    rows += [Candidate("logreg", {"C": c}) for c in (0.01, 0.1, 1.0, 3.0, 10.0, 30.0, 100.0)]
    rows += [
        Candidate("svm", {"C": c}) for c in (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
    ]
    rows += [Candidate(m, {"alpha": a}) for m in ("sgd_hinge", "sgd_log") for a in alphas]
    rows += [Candidate("ridge", {"alpha": a}) for a in (0.01, 0.1, 1.0, 10.0, 100.0, 300.0, 1000.0)]
    rows += [
        Candidate("knn", {"n_neighbors": k, "weights": w})
        for k in (1, 3, 5, 7, 11, 21, 31)
        for w in ("uniform", "distance")
    ]
    return rows
