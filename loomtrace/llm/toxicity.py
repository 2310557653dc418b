"""Toxicity scores by a linear classifier that a change of identity terms must not move.

The score of a text is logistic(bias + sum of w_f sqrt(count of f) / n_words^(1/4)) over
its features: words (runs of ASCII letters, digits and all other scripts; A-Z lower-cased)
and their first 3 to 8 bytes, which carry over to forms of a word not seen in training.

Counterfactual regularisation: in sentences of the labelled texts, identity terms are
swapped for others of their kind; a text without any gets one put into a sentence. The
mean squared change of the linear score over these pairs (at the sentence's own length),
times ``penalty``, is added to the loss. Words that merely name a group then get no weight
of their own, however often toxic texts name it, and neutral mentions stay below the
threshold.

How it runs. Labels of ``toxic`` (0, 1) from rows whose crc32(doc_id as text) mod 4 is not
2 train. The fit takes at most ``most`` toxic texts and twice as many clean ones, of at
most ``longest`` bytes, by a hash of the id; Spark counts the features of this sample, the
``n_features`` that tell the classes best apart (G statistic) are kept, and the sample's
rows over these alone, a few MB, are fitted on the driver. Toxic texts weigh half as much
as clean ones together, so scores are shares under these class weights. Scoring is one
narrow pass over whole texts: distinct words of a batch are looked up once.

Defined results: null and empty texts have no features and get the bias alone. A null
doc_id is never held out and never trains. If an id has several labels, the largest
counts; null labels and other values do not. Where the sample has one class or no rows,
every text gets its share of toxic labels (0 without labels). Repeated rows are scored
each; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import words as W
from loomtrace.session import anchor

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Toxic texts the model is fitted on, the bytes such a text may have, and its features.
MOST, LONGEST, N_FEATURES = 3000, 1 << 16, 512
PENALTY = 3.0
PREFIXES = (3, 4, 5, 6, 7, 8)

#: Terms that name a group, by kind; a term is swapped within its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant", "mormon"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants", "mormons"),
    ("black", "white", "asian", "arab", "latino", "african", "european", "indigenous"),
    ("german", "french", "spanish", "american", "mexican", "turkish", "polish", "chinese", "indian", "russian"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("disabled", "deaf", "blind", "autistic"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes", "filles", "garçons"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
#: Counterfactuals made of one sentence.
SWAPS = 2

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SENTENCE = re.compile(r"[.!?\n]+")


class Model(NamedTuple):
    """Keys of the features in rising order, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


class Counted(NamedTuple):
    """How often each feature (an index of keys) occurs in each text that has it."""

    keys: np.ndarray
    text: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    n_words: np.ndarray

    def values(self, n_words: np.ndarray | None = None) -> np.ndarray:
        n = self.n_words if n_words is None else n_words
        return np.sqrt(self.count) / np.maximum(n[self.text], 1) ** 0.25


def counted(column: pa.Array, keys: np.ndarray | None = None) -> Counted:
    """Feature counts of the texts; only of features in ``keys`` if given."""
    data, bounds = W.texts_of(column, lower=True)
    words = W.words_of(W.Texts(np.where(_LETTER[data], data, 32).astype(np.uint8), bounds))
    _, at, word = np.unique(W.hashes(data, words.start, words.end), return_index=True, return_inverse=True)
    start, end = words.start[at], words.end[at]
    parts = [(W.hashes(data, start, end), np.arange(len(at)))]
    for n in PREFIXES:
        long = np.flatnonzero(end - start >= n)
        parts.append((~W.hashes(data, start[long], start[long] + n), long))
    key, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if keys is None:
        keys, feature = np.unique(key, return_inverse=True)
    else:
        feature = np.searchsorted(keys, key)
        known = np.flatnonzero(keys[np.minimum(feature, len(keys) - 1)] == key) if len(keys) else np.zeros(0, np.int64)
        feature, owner = feature[known], owner[known]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(at) + 1))

    of_word = np.diff(first)
    hit = np.flatnonzero(of_word[word] > 0)
    pair, count = np.unique(words.text[hit] * max(len(at), 1) + word[hit], return_counts=True)
    text, word = pair // max(len(at), 1), pair % max(len(at), 1)
    size = of_word[word]
    cell = np.repeat(first[word] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    both, place = np.unique(np.repeat(text, size) * max(len(keys), 1) + feature[cell], return_inverse=True)
    total = np.bincount(place, np.repeat(count, size), len(both))
    return Counted(keys, both // max(len(keys), 1), both % max(len(keys), 1), total, np.diff(words.first))


def linear(model: Model, column: pa.Array) -> np.ndarray:
    found = counted(column, model.keys)
    return model.bias + np.bincount(found.text, model.weights[found.feature] * found.values(), len(column))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Swapper:
    """Counterfactual sentences under given identity terms."""

    def __init__(self, terms: Sequence[Sequence[str]]):
        self.terms = [list(kind) for kind in terms if len(kind) > 1]
        self.kind = {t: k for k, kind in enumerate(self.terms) for t in kind}
        every = "|".join(map(re.escape, sorted(self.kind, key=len, reverse=True)))
        self.pattern = re.compile(rf"\b({every})\b", re.IGNORECASE) if self.kind else None

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """(sentence, counterfactual) pairs of a text; draws are hashes of the sentence."""
        if self.pattern is None:
            return []
        out = []
        sentences = [s for s in _SENTENCE.split(text) if s.strip()]
        for sentence in sentences:
            draw = zlib.crc32(sentence.encode("utf-8", "replace"))
            if self.pattern.search(sentence):
                for n in range(SWAPS):
                    out.append((sentence, self.pattern.sub(lambda m, n=n: self._other(m[0].lower(), draw + n), sentence)))
        if not out and sentences:
            draw = zlib.crc32(text.encode("utf-8", "replace"))
            sentence = sentences[draw % len(sentences)]
            words = sentence.split()
            kind = self.terms[draw // 7 % len(self.terms)]
            place = draw // 1009 % (len(words) + 1)
            out.append((sentence, " ".join([*words[:place], kind[draw // 11 % len(kind)], *words[place:]])))
        return out

    def _other(self, term: str, draw: int) -> str:
        kind = self.terms[self.kind[term]] if term in self.kind else [term]
        rest = [t for t in kind if t != term] or kind
        return rest[draw % len(rest)]


def train(
    feature: np.ndarray, row: np.ndarray, value: np.ndarray, label: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int, penalty: float, steps: int = 250, rate: float = 0.1, ridge: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic loss plus the penalty on counterfactual changes.

    ``pairs`` holds (pair, feature, change of value) of all counterfactual pairs.
    """
    n, pair, moved, change = len(label), *pairs
    n_pairs = int(pair.max(initial=-1)) + 1
    scale = 3 * max(np.sqrt(np.bincount(feature, value**2, n_features) / n).mean(), 1e-9)
    value, change = value / scale, change / scale
    weight = np.where(label == 1, 1 / (3 * label.sum()), 2 / (3 * (n - label.sum())))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(1 / 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        miss = weight * (logistic(np.bincount(row, value * w[feature], n) + w[-1]) - label)
        slope = np.append(np.bincount(feature, value * miss[row], n_features) + ridge * w[:-1], miss.sum())
        if n_pairs:
            shift = np.bincount(pair, change * w[moved], n_pairs)
            slope[:-1] += 2 * penalty / n_pairs * np.bincount(moved, change * shift[pair], n_features)
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:-1] / scale, float(w[-1])


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0, 1) of the labels that may be learned from."""
    toxic = F.col("toxic").cast("int")
    mine = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT
    return labels.select("doc_id", toxic.alias("toxic")).filter(mine & toxic.isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, marked: DataFrame, most: int, longest: int) -> DataFrame:
    """doc_id, toxic, text of at most ``most`` toxic and twice as many clean labelled texts."""
    order = (F.xxhash64("doc_id", F.lit("toxic")), "doc_id")
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(most).unionByName(marked.filter("toxic = 0").orderBy(*order).limit(2 * most))
    texts = docs.select("doc_id", "text").filter((F.octet_length("text") > 0) & (F.octet_length("text") <= longest))
    # at most three times most narrow rows
    return anchor(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text"))


def telling_features(rows: DataFrame, n_features: int) -> np.ndarray:
    """Keys of the features that tell toxic from clean texts best apart, rising."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            found = counted(batch.column("text"))
            n = [np.bincount(found.feature, toxic[found.text] == c, len(found.keys)).astype(np.int64) for c in (1, 0)]
            yield pa.record_batch([pa.array(found.keys.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["key", "n1", "n0"])

    sums = rows.mapInArrow(count, "key long, n1 long, n0 long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter("n1 + n0 > 1")
    size = rows.agg(F.sum("toxic").alias("s1"), F.sum(1 - F.col("toxic")).alias("s0"))

    def part(seen: str, of: str):
        have, expected = F.col(seen), (F.col("n1") + F.col("n0")) * F.col(of) / (F.col("s1") + F.col("s0"))
        rest, rest_expected = F.col(of) - have, F.col(of) - expected
        return F.when(have > 0, have * F.log(have / expected)).otherwise(0.0) + F.when((rest > 0) & (rest_expected > 0), rest * F.log(rest / rest_expected)).otherwise(0.0)

    gain = part("n1", "s1") + part("n0", "s0")
    best = sums.join(F.broadcast(size)).select("key", gain.alias("gain")).orderBy(F.desc("gain"), "key").limit(n_features)
    return np.sort(np.array([r.key for r in best.collect()], np.int64).view(np.uint64))


def _pair_changes(column: pa.Array, keys: np.ndarray, swapper: Swapper) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, feature, change of value) of the counterfactual pairs of some texts."""
    pairs = [p for text in column.to_pylist() for p in swapper.pairs(text or "")]
    before, after = (counted(pa.array([p[k] for p in pairs], pa.string()), keys) for k in (0, 1))
    return np.concatenate([before.text, after.text]), np.concatenate([before.feature, after.feature]), np.concatenate([-before.values(), after.values(before.n_words)])


def fit(
    docs: DataFrame, labels: DataFrame, most: int = MOST, longest: int = LONGEST, n_features: int = N_FEATURES, penalty: float = PENALTY, terms: Sequence[Sequence[str]] = IDENTITY_TERMS
) -> Model:
    """Fit the classifier on labelled texts outside the held-out fold."""
    marked = training_labels(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = sample(docs, marked, most, longest)
    keys = telling_features(rows, n_features)
    swapper = Swapper(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = counted(batch.column("text"), keys)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int8)
            load = W.packed(toxic, found.text.astype(np.int32), found.feature.astype(np.int32), found.values(), *(x.astype(t) for x, t in zip(_pair_changes(batch.column("text"), keys, swapper), (np.int32, np.int32, float), strict=True)))
            yield pa.record_batch([pa.array([batch.column("doc_id")[0].as_py()], pa.int64()), pa.array([load], pa.binary())], ["first", "load"])

    parts = [W.unpacked(r.load) for r in sorted(rows.mapInArrow(vectors, "first long, load binary").collect())]
    label = np.concatenate([p[0] for p in parts]).astype(float) if parts else np.zeros(0)
    if len(set(label)) < 2:
        share = label.mean() if len(label) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    row_at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    pair_at = np.concatenate([[0], np.cumsum([p[4].max(initial=-1) + 1 for p in parts])])
    row = np.concatenate([p[1] + a for p, a in zip(parts, row_at, strict=False)])
    pair = np.concatenate([p[4] + a for p, a in zip(parts, pair_at, strict=False)])
    feature, value, moved, change = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 5, 6))
    weights, bias = train(feature, row, value, label, (pair, moved, change), len(keys), penalty)
    return Model(keys, weights, bias)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            p = logistic(linear(model, batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    source = docs.select("doc_id", held.alias("held_out"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
