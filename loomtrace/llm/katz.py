"""Katz backoff language model, trained and evaluated over packed tables.

Order two: P(w | h) is the discounted share of h w among what follows h, and for pairs
not seen in training the backoff weight of h times P(w). Discounts are Good-Turing's for
counts up to GOOD_TURING. Backoff weights make every P(. | h) sum to one over the known
words, the end of text and one unknown word, which gets the mass that discounting takes
from the known ones. Where a context has no discounted count, its counts c are scaled by
n / (n + 1), n being their sum, so that something is left for other words.

How it runs. Texts become batches of a few million tokens with their own list of words.
Only distinct words and pairs of a batch travel, packed, to buckets that hold the counts
(partitioned tables); a bucket answers each batch in the order asked, so an answer is
just the numbers. Pairs go by context; a context with a large share of all tokens is
spread over buckets by its second word. Frequent words or pairs thus reach a bucket once
per batch, whatever share of the rows holds them. No vocabulary is broadcast or
collected; the driver sees sums of counts only.

Training rows are those whose crc32(doc_id as text) mod 7 is not 2; a null doc_id
counts as the empty text and trains. Null and empty texts are one end token. With no
training rows every token is unknown and has probability one over one. Repeated rows are
scored, and count, each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import words as W
from loomtrace.session import anchor

FOLDS, HELD_OUT = 7, 2
#: Counts up to this one are discounted.
GOOD_TURING = 5
#: Text bytes of a batch, of the words of a bucket, and of the pairs of a bucket.
BATCH_BYTES, WORD_BYTES, PAIR_BYTES = 12 << 20, 16 << 20, 4 << 20
_END = np.uint64(0x2545F4914F6CDD1D)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_TEXTS = "batch long, load binary"
_ASKED = "bucket long, batch long, load binary"
#: Rows with r are sums to add up: counts by r, all (0), distinct (-1), documents (-2).
_ANSWERS = "kind int, batch long, bucket long, r int, n long, load binary"
_WORDS, _PAIRS, _CONTEXTS, _TYPES = range(4)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token numbers of the texts, in each batch's own list of words."""
    number = TaskContext.get().partitionId() << 32
    for batch in W.slices(batches, "text", BATCH_BYTES):
        texts = W.texts_of(batch.column("text"), lower=True)
        words = W.words_of(texts)
        n = batch.num_rows
        first = words.first + np.arange(n + 1)
        token = np.empty(first[-1], np.uint64)
        ends = np.zeros(first[-1], bool)
        ends[first[1:] - 1] = True
        token[ends] = _END
        token[~ends] = W.hashes(texts.data, words.start, words.end)
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        word, place, count = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(word), np.int64)
        rank[order] = np.arange(len(word))
        place = rank[place]
        trains = np.repeat(~held, np.diff(first))
        load = W.packed(
            word[order], np.bincount(place[trains], minlength=len(word)).astype(np.int32), place.astype(np.int32), first, W.ids_of(batch.column("doc_id")), held.astype(np.uint8)
        )
        yield pa.record_batch([pa.array([number], pa.int64()), pa.array([load], pa.binary())], ["batch", "load"])
        number += 1


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(bucket):
        return []
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True))


def _by_bucket(word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' order by bucket, and their buckets in this order."""
    bucket = (word % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, load in zip(batch.column("batch").to_pylist(), batch.column("load").to_pylist(), strict=True):
                word, trained = W.unpacked(load)[:2]
                order, bucket = _by_bucket(word, buckets)
                cuts = _cuts(bucket)
                loads = [W.packed(word[order[a:b]], trained[order[a:b]]) for a, b in cuts]
                yield pa.record_batch([pa.array(bucket[[a for a, _ in cuts]]), pa.array([number] * len(cuts), pa.int64()), pa.array(loads, pa.binary())], ["bucket", "batch", "load"])

    return ask


def _answer(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["kind", "batch", "bucket", "r", "n", "load"]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _sums(kind: int, count: np.ndarray) -> list[tuple]:
    """Sum, number of types, and numbers of types with the low counts."""
    known = count[count > 0]
    low = np.bincount(np.minimum(known, GOOD_TURING + 2), minlength=GOOD_TURING + 3)
    sums = {0: known.sum(), -1: len(known)} | {r: low[r] for r in range(1, GOOD_TURING + 2)}
    return [(kind, None, None, r, int(n), None) for r, n in sums.items()]


def _count_words(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = sorted(zip(table.column("batch").to_pylist(), table.column("load").to_pylist(), strict=True))
        loads = [W.unpacked(load) for _, load in asked]
        word, place = np.unique(np.concatenate([x[0] for x in loads]), return_inverse=True)
        total = np.bincount(place, np.concatenate([x[1] for x in loads]), len(word)).astype(np.int64)
        rank = np.empty(len(word), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(word))
        name = rank * buckets + bucket
        rows, at = _sums(_WORDS, total), 0
        ends = np.flatnonzero(word == _END)
        if len(ends):
            rows.append((_WORDS, None, None, -2, int(total[ends[0]]), None))
        for (number, _), load in zip(asked, loads, strict=True):
            own = place[at : at + len(load[0])]
            at += len(own)
            rows.append((_WORDS, number, bucket, None, None, W.packed(name[own], total[own])))
        return _answer(rows)

    return count


def _looked_up(word: np.ndarray, buckets: int, answers: dict[int, bytes]) -> list[np.ndarray]:
    """Answers by bucket, put back into the order of the batch's words."""
    order, bucket = _by_bucket(word, buckets)
    parts = [W.unpacked(answers[int(bucket[a])]) for a, _ in _cuts(bucket)]
    out = []
    for columns in zip(*parts, strict=True):
        flat = np.concatenate(columns)
        column = np.empty_like(flat)
        column[order] = flat
        out.append(column)
    return out


def _pairs_of(place: np.ndarray, first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a batch as context and word, and the pair of each token.

    The context n_words stands for the begin of a text.
    """
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[first[:-1]] = n_words
    pair, at = np.unique(before.astype(np.int64) * (n_words + 1) + place, return_inverse=True)
    return pair // (n_words + 1), pair % (n_words + 1), at


def _pair_order(context: np.ndarray, word: np.ndarray, name: np.ndarray, total: np.ndarray, buckets: int, all_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a batch asks for its pairs, and their buckets in this order."""
    names = np.append(name, -1)
    spread = np.append(1 + 2 * total * buckets // max(all_tokens, 1), buckets)
    far = W.mixed(names[word].astype(np.uint64)) % spread[context].astype(np.uint64)
    bucket = (W.mixed(names[context].astype(np.uint64) * _SPREAD + far) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((names[word], names[context], bucket))
    return order, bucket[order]


def _ask_pairs(word_buckets: int, buckets: int, all_tokens: int):
    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        number, load = texts.column("batch")[0].as_py(), texts.column("load")[0].as_py()
        known, _, place, first, _, held = W.unpacked(load)
        name, total = _looked_up(known, word_buckets, dict(zip(answers.column("bucket").to_pylist(), answers.column("load").to_pylist(), strict=True)))
        context, word, at = _pairs_of(place, first, len(known))
        trained = np.bincount(at[np.repeat(held == 0, np.diff(first))], minlength=len(context))
        order, bucket = _pair_order(context, word, name, total, buckets, all_tokens)
        context, word, trained = np.append(name, -1)[context[order]], word[order], trained[order].astype(np.int32)
        cuts = _cuts(bucket)
        loads = [W.packed(np.diff(context[a:b], prepend=0), name[word[a:b]], trained[a:b], total[word[a:b]]) for a, b in cuts]
        return pa.table([pa.array(bucket[[a for a, _ in cuts]]), pa.array([number] * len(cuts), pa.int64()), pa.array(loads, pa.binary())], ["bucket", "batch", "load"])

    return ask


def _count_pairs(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    asked = sorted(zip(table.column("batch").to_pylist(), table.column("load").to_pylist(), strict=True))
    loads = [W.unpacked(load) for _, load in asked]
    context = np.concatenate([np.cumsum(x[0]) for x in loads])
    word = np.concatenate([x[1] for x in loads])
    order = np.lexsort((word, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order[1:]] != context[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.bincount(place, np.concatenate([x[2] for x in loads])).astype(np.int64)
    once = order[new]
    rows, at = _sums(_PAIRS, total), 0
    for (number, _), load in zip(asked, loads, strict=True):
        rows.append((_PAIRS, number, bucket, None, None, W.packed(total[place[at : at + len(load[0])]])))
        at += len(load[0])
    seen = total > 0
    words = np.concatenate([x[3] for x in loads])[once]
    rows.append((_TYPES, None, bucket, None, None, W.packed(np.diff(context[once][seen], prepend=0), total[seen], words[seen])))
    return _answer(rows)


def good_turing(counts: dict[int, int]) -> np.ndarray:
    """Discount of each count up to GOOD_TURING; what is not in (0, 1) becomes 1."""
    out = np.ones(GOOD_TURING + 1)
    n = [counts.get(r, 0) for r in range(GOOD_TURING + 2)]
    if n[1]:
        rest = (GOOD_TURING + 1) * n[GOOD_TURING + 1] / n[1]
        for r in range(1, GOOD_TURING + 1):
            if n[r] and rest < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else 1.0
    return out


def _discounted(count: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return count * np.where(count <= GOOD_TURING, discount[np.minimum(count, GOOD_TURING)], 1.0)


class Model:
    """What the driver knows of the model: sums and discounts."""

    def __init__(self, words: dict[int, int], pairs: dict[int, int]) -> None:
        self.tokens, self.types = words.get(0, 0), words.get(-1, 0)
        self.word_discount, self.pair_discount = good_turing(words), good_turing(pairs)
        kept = self.tokens - sum(r * words.get(r, 0) * (1 - self.word_discount[r]) for r in range(1, GOOD_TURING + 1))
        self.scale = 1.0 if kept < self.tokens else self.tokens / (self.tokens + 1)
        self.unknown = 1 - self.scale * kept / self.tokens if self.tokens else 1.0

    def word(self, count: np.ndarray) -> np.ndarray:
        """P(w) from the counts of words."""
        known = self.scale * _discounted(count, self.word_discount) / max(self.tokens, 1)
        return np.where(count > 0, known, self.unknown)


def _context_sums(model: Model, buckets: int):
    """Per context in a bucket of pairs: counts, discounted counts, and P(w) of its words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, load in zip(batch.column("bucket").to_pylist(), batch.column("load").to_pylist(), strict=True):
                context, count, word = W.unpacked(load)
                if not len(context):
                    continue
                context = np.cumsum(context)
                head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                columns = [np.add.reduceat(x, head) for x in (count, _discounted(count, model.pair_discount), model.word(word))]
                context = context[head]
                bucket = context % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = _cuts(bucket[order])
                loads = [W.packed(context[order[a:b]], *(x[order[a:b]] for x in columns)) for a, b in cuts]
                yield pa.record_batch([pa.array(bucket[order[[a for a, _ in cuts]]]), pa.array([-1 - source] * len(cuts), pa.int64()), pa.array(loads, pa.binary())], ["bucket", "batch", "load"])

    return add


def _weigh(begin_bucket: int):
    """Answers to each batch's words as contexts: log10 of scale / count, and of alpha."""

    def weigh(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = sorted(zip(table.column("batch").to_pylist(), table.column("load").to_pylist(), strict=True))
        sums = [W.unpacked(load) for number, load in asked if number < 0]
        columns = [np.concatenate([x[i] for x in sums]) if sums else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float, float))]
        order = np.argsort(columns[0], kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(columns[0][order]) != 0])) if len(order) else order
        context = columns[0][order][head]
        count, kept, words = (np.add.reduceat(x[order], head) if len(head) else x for x in columns[1:])
        scale = np.where(kept < count * (1 - 1e-12), 1.0, count / (count + 1))
        seen = np.log10(scale / count)
        left = np.log10((1 - scale * kept / count) / (1 - words))
        rows = []
        if bucket == begin_bucket:
            at = np.flatnonzero(context == -1)
            rows.append((_CONTEXTS, None, bucket, 0, None, W.packed(seen[at], left[at])))
        for number, load in asked:
            if number >= 0:
                name = W.unpacked(load)[0]
                at = np.searchsorted(context, name)
                there = np.append(context, -2)[at] == name
                rows.append((_CONTEXTS, number, bucket, None, None, W.packed(*(np.where(there, np.append(x, 0.0)[at], 0.0) for x in (seen, left)))))
        return _answer(rows)

    return weigh


def _score(model: Model, word_buckets: int, buckets: int, begin: tuple[float, float]):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known, _, place, first, ids, held = W.unpacked(texts.column("load")[0].as_py())
        got: dict[int, dict[int, bytes]] = {_WORDS: {}, _PAIRS: {}, _CONTEXTS: {}}
        for kind, bucket, load in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "load")), strict=True):
            got[kind][bucket] = load
        name, total = _looked_up(known, word_buckets, got[_WORDS])
        seen, left = _looked_up(known, word_buckets, got[_CONTEXTS])
        context, word, at = _pairs_of(place, first, len(known))
        order, bucket = _pair_order(context, word, name, total, buckets, model.tokens)
        count = np.empty(len(order), np.int64)
        if len(order):
            count[order] = np.concatenate([W.unpacked(got[_PAIRS][int(bucket[a])])[0] for a, _ in _cuts(bucket)])
        seen, left = np.append(seen, begin[0]), np.append(left, begin[1])
        direct = np.log10(np.maximum(_discounted(count, model.pair_discount), 1e-300)) + seen[context]
        pair = np.where(count > 0, direct, left[context] + np.log10(model.word(total))[word])
        base = np.log10((total + 1) / (model.tokens + model.types + 1))
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  a text has one token at least
        n = len(ids)
        columns = [W.ids_back(ids), held.astype(bool), np.diff(first), add((total > 0)[place].astype(np.int64)), np.full(n, model.tokens), add(base[place]), add(pair[at])]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.split()[0] for f in _SCORES.split(", ")])

    return score


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _total(answers: DataFrame, kind: int) -> dict[int, int]:
    rows = answers.filter((F.col("kind") == kind) & F.col("r").isNotNull() & F.col("n").isNotNull()).groupBy("r").agg(F.sum("n").alias("n")).collect()
    return {r.r: r.n for r in rows}


def scores(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every row; training rows by the rule above."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_buckets, buckets = (max(1, -(-size // n)) for n in (WORD_BYTES, PAIR_BYTES))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    texts = anchor(docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out")).mapInArrow(_encode, _TEXTS))

    words = anchor(texts.mapInArrow(_ask_words(word_buckets), _ASKED).groupBy("bucket").applyInArrow(_count_words(word_buckets), _ANSWERS))
    word_sums = _total(words, _WORDS)
    word_answers = words.filter("batch IS NOT NULL")

    by_batch = texts.groupBy("batch")
    asked = by_batch.cogroup(word_answers.groupBy("batch")).applyInArrow(_ask_pairs(word_buckets, buckets, word_sums.get(0, 0)), _ASKED)
    pairs = anchor(asked.groupBy("bucket").applyInArrow(_count_pairs, _ANSWERS))
    model = Model(word_sums, _total(pairs, _PAIRS))

    sums = pairs.filter(F.col("kind") == _TYPES).select("bucket", "load").mapInArrow(_context_sums(model, word_buckets), _ASKED)
    begin_bucket = -1 % word_buckets
    contexts = anchor(sums.unionByName(word_answers.select("bucket", "batch", "load")).groupBy("bucket").applyInArrow(_weigh(begin_bucket), _ANSWERS))
    first = [W.unpacked(r.load) for r in contexts.filter("batch IS NULL").select("load").collect()]
    begin = next(((float(a[0]), float(b[0])) for a, b in first if len(a)), (0.0, 0.0))

    answers = words.unionByName(pairs).unionByName(contexts).filter("batch IS NOT NULL")
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_score(model, word_buckets, buckets, begin), _SCORES)
