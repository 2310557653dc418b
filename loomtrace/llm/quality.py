"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Each line gets features; Viterbi decoding finds the best label sequence of the whole
document, and the share of words in content lines decides whether it stays. A rule on
length and repetition comes first. One narrow pass over the texts, no shuffle.

The field is trained here, on at most ``per_class`` good and ``per_class`` bad documents
of at most ``longest`` bytes: lines of good documents count as content, lines of bad
ones as boilerplate. It learns from documents that the base rule passes, since it only
decides on those. Nothing else is sampled or cut.

Defined results: a null or empty text has no words, fails the base rule and goes. A null
``doc_id`` is carried through. Repeated rows get the same result each. Without labelled
documents the field knows no boilerplate and only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm import words as W
from loomtrace.llm.apart import set_apart

#: Documents of each class the field is trained on, and the bytes such a document may have.
PER_CLASS, LONGEST = 600, 1 << 16
#: Words in content lines that a kept document has, as a share of all.
CONTENT_SHARE = 0.5
LEAST_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 10, 5, 20
CONTENT, BOILERPLATE = 0, 1

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_LATIN = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_MARK = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_LATIN & ~_DIGIT & ~_SYMBOL
_CHARACTER = (np.arange(256) & 0xC0) != 0x80
N_FEATURES = 9


class Field(NamedTuple):
    """Weights: per label and feature, per pair of labels, per first label."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray


class Measured(NamedTuple):
    """Counts of each text, and the lines of all with their features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_first: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def measure(column: pa.Array) -> Measured:
    texts = W.texts_of(column)
    data, bounds = texts
    words, lines = W.words_of(texts), W.lines_of(texts)
    n = len(bounds) - 1
    word_at = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    line_words = word_at[1] - word_at[0]

    salt = W.mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))
    line_key = W.hashes(data, lines.start, lines.end) ^ salt[lines.text]
    _, earliest = W.groups(line_key)
    again = (earliest < np.arange(len(line_key))) & (line_words > 0)

    key = W.hashes(data, words.start, words.end)
    at = W.windows(words, REPEAT_WORDS)
    count, _ = W.groups(W.window_hashes(key, REPEAT_WORDS)[at] ^ salt[words.text[at]])
    repeated = W.covered(at[count > 1], REPEAT_WORDS, len(key))

    size = np.maximum(lines.end - lines.start, 1)
    share = lambda flags: W.sums(flags[data], lines.start, lines.end) / size
    features = np.stack(
        [
            np.ones(len(size)),
            8 * share(_SYMBOL),
            share(_UPPER),
            share(_DIGIT),
            4 * share(_MARK),
            again.astype(float),
            W.sums(repeated, *word_at) / np.maximum(line_words, 1),
            np.minimum(np.log1p(line_words) / 5, 2.0),
            np.minimum(size / np.maximum(line_words, 1) / 10, 3.0),
        ],
        axis=1,
    )
    return Measured(
        np.diff(words.first),
        W.sums(~W.SPACES[data] & _CHARACTER[data], bounds[:-1], bounds[1:]),
        W.sums(_SYMBOL[data], bounds[:-1], bounds[1:]),
        W.sums(again, lines.first[:-1], lines.first[1:]),
        W.sums(repeated, words.first[:-1], words.first[1:]),
        lines.first,
        line_words,
        features,
    )


def base_failed(found: Measured) -> np.ndarray:
    return (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > REPEAT_PERCENT * found.n_words)


def _steps(first: np.ndarray) -> Iterator[np.ndarray]:
    """For each line number, the documents that have such a line, long ones first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
    for n in alive:
        yield order[:n]


def viterbi(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The label of each line in the best sequence of its document; ties go to content."""
    score = features @ field.emit.T
    label = np.zeros(len(features), np.int8)
    if not len(features):
        return label
    back = np.zeros((len(features), 2), np.int8)
    best = np.zeros((len(first) - 1, 2))
    for t, docs in enumerate(_steps(first)):
        at = first[docs] + t
        if t == 0:
            best[docs] = field.begin + score[at]
            continue
        ways = best[docs][:, :, None] + field.move[None]
        back[at] = ways.argmax(axis=1)
        best[docs] = ways.max(axis=1) + score[at]
    size = np.diff(first)
    full = np.flatnonzero(size)
    label[first[full + 1] - 1] = best[full].argmax(axis=1)
    for t in range(size.max() - 1, 0, -1):
        docs = np.flatnonzero(size > t) if t < 2 else full[size[full] > t]
        at = first[docs] + t
        label[at - 1] = back[at, label[at]]
    return label


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Maximum likelihood of the line labels by forward-backward and Adam steps."""
    n = max(len(features), 1)
    theta = np.zeros(2 * N_FEATURES + 4 + 2)
    seen = np.zeros((len(features), 2))
    seen[np.arange(len(features)), label] = 1
    starts = first[:-1][np.diff(first) > 0]
    inner = np.setdiff1d(np.arange(len(features)), starts)
    pair = np.zeros((2, 2))
    np.add.at(pair, (label[inner - 1], label[inner]), 1)
    truth = np.concatenate([(seen.T @ features).ravel(), pair.ravel(), seen[starts].sum(0)])
    order = list(_steps(first))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        field = _field(theta)
        score = features @ field.emit.T
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        for t, docs in enumerate(order):
            at = first[docs] + t
            alpha[at] = score[at] + (field.begin if t == 0 else np.logaddexp.reduce(alpha[at - 1][:, :, None] + field.move, axis=1))
        for t in range(len(order) - 1, 0, -1):
            at = first[order[t]] + t
            beta[at - 1] = np.logaddexp.reduce(field.move + (score[at] + beta[at])[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha + beta, axis=1, keepdims=True)
        p = np.exp(alpha + beta - total)
        both = np.exp(alpha[inner - 1][:, :, None] + field.move + (score[inner] + beta[inner])[:, None, :] - total[inner][:, :, None])
        expected = np.concatenate([(p.T @ features).ravel(), both.sum(0).ravel(), p[starts].sum(0)])
        gradient = (truth - expected) / n - ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return _field(theta)


def _field(theta: np.ndarray) -> Field:
    cut = 2 * N_FEATURES
    return Field(theta[:cut].reshape(2, N_FEATURES), theta[cut : cut + 4].reshape(2, 2), theta[cut + 4 :])


#: Without labelled documents: every line is content.
UNTRAINED = Field(np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Field:
    """Train on a bounded sample of labelled documents (``quality`` 1 good, 0 bad)."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id", F.lit("quality")), "doc_id")
    chosen = marked.filter("quality = 0").orderBy(*order).limit(per_class).unionByName(marked.filter("quality = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", "text").filter((F.octet_length("text") > 0) & (F.octet_length("text") <= longest))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = measure(batch.column("text"))
            cut = found.line_first
            feature = [W.packed(found.features[a:b].ravel()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out = pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(feature, pa.binary())], ["doc_id", "quality", "features"])
            yield out.filter(pa.array(~base_failed(found)))

    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(lines, "doc_id long, quality int, features binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    if {r.quality for r in rows} != {0, 1}:
        return UNTRAINED
    parts = [W.unpacked(r.features)[0].reshape(-1, N_FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    label = np.repeat([CONTENT if r.quality else BOILERPLATE for r in rows], np.diff(first))
    return train(np.concatenate(parts), first, label)


def judged(column: pa.Array, field: Field, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """The result columns of each text of an Arrow column."""
    found = measure(column)
    label = viterbi(field, found.features, found.line_first)
    content = np.concatenate([[0], np.cumsum(np.where(label == CONTENT, found.line_words, 0))])
    n_content = content[found.line_first[1:]] - content[found.line_first[:-1]]
    failed = base_failed(found)
    return {
        "n_words": found.n_words,
        "word_chars": found.word_chars,
        "n_symbols": found.n_symbols,
        "n_dup_lines": found.n_dup_lines,
        "n_repeat_words": found.n_repeat_words,
        "content_words": n_content,
        "base_failed": failed,
        "kept": ~failed & (n_content >= share * found.n_words),
    }


VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def verdicts(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the counts of the base rule, words in content lines, and whether it stays."""
    source = docs.select("doc_id", "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = judged(batch.column("text"), field, share)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    return source.mapInArrow(judge, T.StructType([source.schema["doc_id"], *VERDICT.fields]))


def kept(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield batch.filter(pa.array(judged(batch.column("text"), field, share)["kept"]))

    rest = set_apart(docs, ("doc_id", "text"))
    return rest.back(rest.docs.mapInArrow(keep, rest.docs.schema))
