"""Spelling variants: words within one edit, found by bit-sliced position indexes.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. One in
``every`` of a document's distinct words (by the crc32 of ``<doc_id>:<word>``) loses a
letter first. Words of at least ``least_chars`` letters that occur at least ``least_n``
times form the vocabulary. Two words are near if one inserted, deleted or replaced letter
turns one into the other.

The index. For each (position, letter) a bitset over the words of a block says which have
that letter there. A word's letters are read from the left; word-parallel recurrences
keep four bitsets: words equal so far, words with one letter replaced, words one letter
ahead (they have one more) and words one behind. Lengths decide at the end. All letters
are single Latin-1 bytes, so a block is a table of bytes.

Which words meet. Of two near words, the shorter of m letters, either the first m // 2 or
the last m // 2 letters agree, so each word stands in a group by either end, for m its
length and one less. A group beyond ``most_words`` is split by the next half of what is
left, again and again, until it fits or one letter is left open. A pair that agrees at
the front is not counted at the back, so each is counted in one group only, and groups
give sums: number of near words, best near word. Many groups lie side by side in one
block; a query reads only the bitset words of its own group. The vocabulary is never
collected or broadcast.

Forms. A word's form is its near word of largest n (ties: first in code-point order) if
that is at least ``ratio`` times its own n. Roots follow forms to the last by doubling.

Defined results: null and empty texts have no words; a null doc_id counts as the empty
string in the crc. Rows that repeat count each. Within a batch words are told apart by
64-bit hashes. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import words as W
from loomtrace.session import anchor

EVERY, LEAST_CHARS, LEAST_N, RATIO = 31, 7, 2, 10
#: Words of a group beyond which it is split, if more than one letter is open.
MOST_WORDS = 4096
#: Rows of (word, group) of a task, letters indexed together (whole groups at least), and
#: pairs of query and bitset word at once.
BUCKET_ROWS, BLOCK_LETTERS, FLAT = 1 << 15, 1 << 19, 1 << 20
_TEXT_BYTES = 6 << 20
_TWO_BYTES = 0xC3
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of what gave ``state`` followed by each span's bytes."""
    crc = ~state.astype(np.uint32)
    live, at = np.arange(len(start)), 0
    while len(live := live[start[live] + at < end[live]]):
        crc[live] = _CRC[(crc[live] ^ data[start[live] + at]) & 255] ^ (crc[live] >> np.uint32(8))
        at += 1
    return ~crc


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    texts = W.gather(data, start, end)
    offsets = pa.py_buffer(texts.bounds.astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, offsets, pa.py_buffer(texts.data.tobytes())])


def counted(batch: pa.RecordBatch, every: int, least_chars: int) -> pa.Table:
    """word, n of a batch's words of at least ``least_chars`` letters, letters deleted."""
    data, bounds = W.texts_of(batch.column("text"), lower=True)
    two = data == _TWO_BYTES
    letter = _LOWER[data] | two
    letter[1:] |= two[:-1]
    words = W.words_of(W.Texts(np.where(letter, data, 32).astype(np.uint8), bounds))
    size = words.end - words.start - W.sums(two, words.start, words.end)
    long = np.flatnonzero(size >= least_chars)
    start, end, text = words.start[long], words.end[long], words.text[long]

    _, at, word = np.unique(W.hashes(data, start, end), return_index=True, return_inverse=True)
    pair, count = np.unique(text * max(len(at), 1) + word, return_counts=True)
    text, word = pair // max(len(at), 1), pair % max(len(at), 1)
    start, end, size = start[at], end[at], size[long][at]

    head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
    crc = crc32_after(head[text], data, start[word], end[word])
    cut = np.flatnonzero(crc % every == 0)
    total = np.bincount(word, count, len(at)) - np.bincount(word[cut], count[cut], len(at))
    left = np.flatnonzero(total)
    shorter, times = [], []
    for i in cut[size[word[cut]] > least_chars]:
        full = data[start[word[i]] : end[word[i]]].tobytes().decode()
        place = int(crc[i]) % len(full)
        shorter.append(full[:place] + full[place + 1 :])
        times.append(count[i])
    return pa.table(
        [
            pa.chunked_array([_strings(data, start[left], end[left]).cast(pa.string()), pa.array(shorter, pa.string())]),
            pa.chunked_array([pa.array(total[left].astype(np.int64)), pa.array(np.array(times, np.int64))]),
        ],
        ["word", "n"],
    )


def vocabulary(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word, n of all words of the texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", _TEXT_BYTES):
            yield from counted(batch, every, least_chars).to_batches()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _open(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, front, back, bar) with their group's key.

    Words of a group agree in the first ``front`` and the last ``back`` letters; pairs that
    agree in the first ``bar`` letters as well are counted elsewhere (0: none are).
    """
    ends = F.concat_ws("/", "m", "front", "back", "bar", F.substring("word", F.lit(1), F.col("front")), F.expr("right(word, back)"))
    return rows.withColumn("key", F.xxhash64(ends))


def groups(vocab: DataFrame, least_chars: int = LEAST_CHARS, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, n, m, front, back, bar, key): the groups in which near words meet."""
    size = F.length("word")
    first = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= least_chars)
    rows = _halved(first.withColumns({"front": F.lit(0), "back": F.lit(0), "bar": F.lit(0)}))
    done = None
    while True:
        rows = anchor(_open(rows))
        large = rows.groupBy("key").agg(F.count("*").alias("size"), F.first(F.col("m") - F.col("front") - F.col("back")).alias("left"))
        large = anchor(large.filter((F.col("size") > most_words) & (F.col("left") > 1)).select("key"))
        fits = rows.join(large, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if large.isEmpty():
            return done
        rows = _halved(rows.join(large, "key", "left_semi").drop("key"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the next half of the open letters agrees in front, or at the back."""
    half = F.floor((F.col("m") - F.col("front") - F.col("back")) / 2).cast("int")
    front = F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("bar").alias("bar"))
    back = F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), (F.col("front") + half).alias("bar"))
    # an open letter at most is left: both sides are one group
    either = F.when(half > 0, F.array(front, back)).otherwise(F.array(F.struct("front", "back", "bar")))
    return rows.select("word", "n", "m", F.explode(either).alias("_s")).select("word", "n", "m", "_s.*")


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as Latin-1 bytes back to back, and their bounds."""
    data, bounds = W.texts_of(words)
    two = data == _TWO_BYTES
    data = data.copy()
    data[1:][two[:-1]] += 0x40
    return data[~two], bounds - np.concatenate([[0], np.cumsum(two)])[bounds]


def near(words: pa.Array, rank: np.ndarray, key: np.ndarray, m: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the number of near words of its group and the least rank of any (or -1).

    Rows of one key are one group; rows must be sorted by (m, key).
    """
    letters, bounds = _latin(words)
    size = np.diff(bounds)
    n_near, best = np.zeros(len(key), np.int64), np.full(len(key), np.iinfo(np.int64).max)
    for a, b in _runs(m):
        for c, d in _pieces(key, a, b, max(BLOCK_LETTERS // int(m[a] + 1), 1)):
            pairs = _near_in(letters, bounds[c : d + 1], size[c:d], key[c:d], int(m[c]), bar[c:d])
            for query, found in pairs:
                n_near[c:d] += np.bincount(query, minlength=d - c)
                np.minimum.at(best, c + query, rank[c + found])
    return n_near, np.where(n_near > 0, best, -1)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True))


def _pieces(key: np.ndarray, a: int, b: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of about so many rows."""
    ends = np.array([d for _, d in _runs(key[a:b])]) + a
    while a < b:
        end = int(ends[min(np.searchsorted(ends, a + rows), len(ends) - 1)])
        yield a, end
        a = end


def _near_in(letters: np.ndarray, bounds: np.ndarray, size: np.ndarray, key: np.ndarray, m: int, bar: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) rows that are near, of words of m and m + 1 letters laid out by group."""
    n = len(size)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    of_group = np.bincount(group)
    first = np.concatenate([[0], np.cumsum(of_group)])
    queries = np.flatnonzero(of_group[group] > 1)
    if not len(queries):
        return
    # one table of letter codes per position; code 0 stands for no letter
    place = np.minimum(np.arange(m + 1), size[:, None] - 1)
    byte = letters[bounds[:-1, None] + place]
    codes = np.zeros(256, np.uint8)
    seen = np.unique(byte)
    codes[seen] = np.arange(1, len(seen) + 1)
    code = np.where(np.arange(m + 1) < size[:, None], codes[byte], np.uint8(0))
    blocks = (n + 63) // 64
    index = np.zeros((m + 1, len(seen) + 1, blocks), np.uint64)
    bit = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    for i in range(m + 1):
        np.bitwise_or.at(index[i], (code[:, i], np.arange(n) // 64), bit)
    index[:, 0] = 0
    long = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(long, np.flatnonzero(size > m) // 64, bit[size > m])
    short = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(short, np.flatnonzero(size <= m) // 64, bit[size <= m])

    lo, hi = first[group[queries]], first[group[queries] + 1]
    low, width = lo // 64, (hi + 63) // 64 - lo // 64
    at = np.concatenate([[0], np.cumsum(width)])
    cut = 0
    while cut < len(queries):
        to = max(int(np.searchsorted(at, at[cut] + FLAT)), cut + 1)
        to = min(to, len(queries))
        w = width[cut:to]
        query = np.repeat(queries[cut:to], w)
        block = np.repeat(low[cut:to] - (at[cut:to] - at[cut]), w) + np.arange(at[to] - at[cut])
        # bits of the own group alone
        begin, end = np.repeat(lo[cut:to], w), np.repeat(hi[cut:to], w)
        own = _upto(end - block * 64) & ~_upto(begin - block * 64)
        yield _climb(index, code, size, m, bar, query, block, own, long, short)
        cut = to


def _upto(n: np.ndarray) -> np.ndarray:
    """The lowest n bits, n cut to 0 and 64."""
    n = np.clip(n, 0, 64)
    return np.where(n == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _climb(
    index: np.ndarray, code: np.ndarray, size: np.ndarray, m: int, bar: np.ndarray, query: np.ndarray, block: np.ndarray, own: np.ndarray, long: np.ndarray, short: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Read the queries' letters; bitsets of words equal, replaced, ahead and behind."""
    equal, barred = own.copy(), np.zeros_like(own)
    replaced, ahead, behind = np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
    has_long = size[query] > m
    for i in range(m + 1):
        live = slice(None) if i < m else np.flatnonzero(has_long)
        q, k = query[live], block[live]
        letter = code[q, i]
        here = index[i, letter, k]
        e = equal[live]
        after = (ahead[live] | e) & index[i + 1, letter, k] if i < m else np.zeros_like(e)
        back = (behind[live] & index[i - 1, letter, k] if i else np.zeros_like(e)) | e
        replaced[live] = (replaced[live] & here) | (e & ~here)
        ahead[live], behind[live], equal[live] = after, back, e & here
        stop = np.flatnonzero(bar[query] == i + 1)
        barred[stop] = equal[stop]
    same = np.where(has_long, long[block], short[block])
    found = (replaced & same) | (np.where(has_long, behind & short[block], (ahead | equal) & long[block]))
    # two words of m + 1 letters are decided in the group of m + 1
    found = np.where(has_long, found & short[block], found) & ~barred
    full = np.flatnonzero(found)
    bits = np.unpackbits(found[full].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, column = np.nonzero(bits)
    return query[full[row]], block[full[row]] * 64 + column


def near_words(vocab: DataFrame, least_chars: int = LEAST_CHARS, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n_near, best (n, word) of every word that has near words."""
    rows = groups(vocab, least_chars, most_words)
    buckets = max(1, -(-vocab.count() * 4 // BUCKET_ROWS))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("m", "ascending"), ("key", "ascending")])
        word = table.column("word").combine_chunks().cast(pa.string())
        n = table.column("n").to_numpy()
        # rank by n, largest first, then by the word; UTF-8 bytes sort as code points do
        order = pa.compute.sort_indices(pa.table([word, pa.array(-n)], ["word", "n"]), [("n", "ascending"), ("word", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        count, best = near(word, rank, table.column("key").to_numpy(), table.column("m").to_numpy(), table.column("bar").to_numpy())
        some = np.flatnonzero(count)
        other = order[best[some]]
        return pa.table([word.take(pa.array(some)), pa.array(count[some]), pa.array(n[other]), word.take(pa.array(other))], ["word", "n_near", "best_n", "best"])

    placed = rows.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "word", "n", "m", "bar", "key")
    found = placed.groupBy("bucket").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", (-F.col("_best.minus")).alias("best_n"), F.col("_best.best").alias("best"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): forms followed to the last.

    n rises tenfold with each form, so chains are short and have an end.
    """
    links = anchor(formed.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = anchor(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return links


def variants(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, ratio: int = RATIO, most_words: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the whole vocabulary."""
    vocab = anchor(vocabulary(docs, every, least_chars, least_n))
    close = F.col("best_n") >= ratio * F.col("n")
    rows = vocab.join(near_words(vocab, least_chars, most_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(close, F.col("best")).alias("form"), F.when(close, F.col("best_n")).alias("form_n")
    )
    rows = anchor(rows)
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
