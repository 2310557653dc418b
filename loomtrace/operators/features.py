"""Text features in long form: one row per (example, term)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import characters

# Fixed value: what counts as a word.
WORD = r"(?U)\b\w\w+\b"
SPACE_RUN = r"(?U)\s\s+"  # fixed value: white space that counts as one blank
BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class TextFeatures:
    """Analyzer, n-gram lengths and vocabulary limits."""

    analyzer: str = "word"  # word | char
    ngrams: tuple[int, int] = (1, 1)
    lowercase: bool = True
    min_df: int = 2
    max_df: float = 0.95
    max_features: int | None = 200_000
    sublinear: bool = True
    binary: bool = False


def word_ngrams(text: Column, low: int, high: int, *, lowercase: bool = True) -> Column:
    """Word n-grams of every length from `low` to `high`, words of two characters or more."""
    source = F.lower(text) if lowercase else text
    return _ngrams(F.regexp_extract_all(source, F.lit(WORD), 0), low, high, " ")


def char_ngrams(text: Column, low: int, high: int, *, lowercase: bool = False) -> Column:
    """Character n-grams; runs of white space count as one blank."""
    source = F.lower(text) if lowercase else text
    return _ngrams(characters(F.regexp_replace(source, SPACE_RUN, " ")), low, high, "")


def _ngrams(tokens: Column, low: int, high: int, joint: str) -> Column:
    """All runs of `low` to `high` tokens, as one array.

    Longer runs grow from shorter ones token by token, which stays linear in the text.
    """

    def runs(held: Column) -> Column:
        found, gram = [], held
        for n in range(1, high + 1):
            if n > 1:
                left = F.greatest(F.size(held) - (n - 1), F.lit(0))
                gram = F.zip_with(
                    F.slice(gram, F.lit(1), left),
                    F.slice(held, F.lit(n), left),
                    lambda a, b: F.concat(a, F.lit(joint), b),
                )
            if n >= low:
                found.append(gram)
        return F.concat(*found) if len(found) > 1 else found[0]

    return F.get(F.transform(F.array(tokens), runs), F.lit(0))


def grams_of(tokens: Column, n: int, joint: str = "") -> Column:
    """The runs of exactly `n` tokens, in text order."""
    return _ngrams(tokens, n, n, joint)


def units_of(text: Column, spec: TextFeatures) -> Column:
    """What the terms of a text are runs of: its words, or its characters as one piece."""
    source = F.lower(text) if spec.lowercase else text
    if spec.analyzer == "word":
        return F.regexp_extract_all(source, F.lit(WORD), 0)
    if spec.analyzer == "char":
        return F.when(source.isNotNull(), F.array(F.regexp_replace(source, SPACE_RUN, " ")))
    raise ValueError(f"analyzer must be 'word' or 'char', got {spec.analyzer!r}")


def terms_of(text: Column, spec: TextFeatures) -> Column:
    """All terms of a text as one array, repeats kept."""
    low, high = spec.ngrams
    if spec.analyzer == "word":
        return word_ngrams(text, low, high, lowercase=spec.lowercase)
    if spec.analyzer == "char":
        return char_ngrams(text, low, high, lowercase=spec.lowercase)
    raise ValueError(f"analyzer must be 'word' or 'char', got {spec.analyzer!r}")


def term_counts(
    examples: DataFrame,
    spec: TextFeatures,
    keep: Sequence[str] = ("example_id",),
    *,
    text: str = "text",
) -> DataFrame:
    """How often each term occurs in each example."""
    exploded = examples.select(*keep, F.explode(terms_of(F.col(text), spec)).alias("term"))
    tf = F.lit(1).cast("long") if spec.binary else F.count("*")
    return exploded.groupBy(*keep, "term").agg(tf.alias("tf"))


def vocabulary(
    train_counts: DataFrame, n_train: DataFrame, spec: TextFeatures
) -> DataFrame:
    """Terms kept after the frequency limits: (term, df, cf, n), from training rows only.

    `n_train` is one row with the number `n` of training examples.
    """
    stats = train_counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )
    kept = stats.join(F.broadcast(n_train)).where(
        (F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * F.col("n"))
    )
    if spec.max_features is None:
        return kept
    return kept.orderBy(F.col("cf").desc(), "term").limit(spec.max_features)


def _with_vocabulary(counts: DataFrame, vocab: DataFrame, spec: TextFeatures) -> DataFrame:
    """Broadcast the vocabulary only where its size limit is part of the request."""
    bounded = spec.max_features is not None and spec.max_features <= BROADCAST_TERMS
    return counts.join(F.broadcast(vocab) if bounded else vocab, "term")


def tfidf(
    counts: DataFrame,
    vocab: DataFrame,
    spec: TextFeatures,
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """Weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1."""
    tf = F.col("tf").cast("double")
    local = (1 + F.log(tf)) if spec.sublinear else tf
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = _with_vocabulary(counts, vocab, spec).select(*keep, "term", (local * idf).alias("_w"))
    one_row = Window.partitionBy(*keep)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(one_row))
    return raw.select(*keep, "term", (F.col("_w") / length).alias("weight"))


def presence(
    counts: DataFrame, vocab: DataFrame, spec: TextFeatures, keep: Sequence[str] = ("example_id",)
) -> DataFrame:
    """1 for every vocabulary term an example has."""
    return _with_vocabulary(counts, vocab, spec).select(
        *keep, "term", F.least(F.col("tf"), F.lit(1)).cast("double").alias("weight")
    )


# ---- character ids ----


def alphabet(train: DataFrame, text: str = "text") -> DataFrame:
    """One row with the sorted characters of the training texts.

    An alphabet is bounded by the character set, not by the data.
    """
    seen = train.select(F.explode(F.array_distinct(characters(F.col(text)))).alias("c")).distinct()
    return seen.agg(F.array_sort(F.collect_set("c")).alias("alphabet"))


def train_length(
    train: DataFrame, *, text: str = "text", share: float = 0.95, cap: int = 512
) -> DataFrame:
    """One row with the sequence length: a percentile of training lengths, 1 to `cap`."""
    at = F.floor(F.percentile(F.length(text), F.lit(share)))
    length = F.greatest(F.lit(1), F.least(F.coalesce(at, F.lit(1)), F.lit(cap)))
    return train.agg(length.cast("int").alias("length"))


def char_ids(
    rows: DataFrame, letters: DataFrame, length: DataFrame, *, text: str = "text"
) -> DataFrame:
    """Character ids from 2 in alphabet order, 1 for unknown ones, padded with 0."""
    joined = rows.join(F.broadcast(letters)).join(F.broadcast(length))
    size = F.col("length")
    head = F.slice(characters(F.col(text)), F.lit(1), size)
    ids = F.transform(head, lambda c: (F.array_position("alphabet", c) + 1).cast("int"))
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(0), size)), F.lit(1), size)
    return joined.withColumn("ids", padded).drop("alphabet", "length")


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency: all rows over the rows of the class."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(
        label, "n", (F.col("_all") / F.greatest(F.col("n"), F.lit(1))).alias("class_weight")
    )


def standard_scaled(
    rows: DataFrame, array: str, *, part: str = "part"
) -> DataFrame:
    """Arrays with every position scaled by its training mean and deviation.

    The deviation is the population one; constant positions are only centred.
    """
    cells = rows.where(F.col(part) == "train").select(F.posexplode(array).alias("_i", "_x"))
    stats = cells.groupBy("_i").agg(
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std")
    )
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    ordered = F.array_sort(F.collect_list(F.struct("_i", "mean", scale.alias("std"))))
    fitted = stats.agg(ordered.alias("_fit"))
    scaled = F.zip_with(array, "_fit", lambda x, f: (x - f["mean"]) / f["std"])
    return rows.join(F.broadcast(fitted)).withColumn(array, scaled).drop("_fit")
