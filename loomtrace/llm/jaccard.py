"""Jaccard self-join over word shingles with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles (fewer words: the sequence as one).
All sets are put in one global order, tokens thought frequent last. Two sets of at least
75 % similarity share at least l tokens in their prefixes of size n - ceil(0.75 n) + l,
for any l. Each document picks its l, in proportion to its size, by estimated cost: a
longer prefix touches more postings, but leaves at most (postings hit) / l candidates to
verify. A pair needs the smaller l of its two documents, so a document with fewer shared
prefix tokens than any partner of a fitting size asks for drops out before anything is
verified.

Frequencies come from a sketch of all shingles, of fixed size; they steer only the order
and l, so the links found do not depend on them. Equal sets are one node from the start.

Work on a group of near copies grows with its members, not with their pairs. The sets
that share a prefix token form a list. Each is verified against the lead of its list, the
set whose prefix lies in the longest lists for its size: the one with fewest edits of its
own. Two sets x and y linked to the lead c are in one component. Else say x is not linked
to c. If x and y are linked, then either they share tokens outside c, at least as many as
|x & y| needs beyond min(|x & c|, |y & c|), or that bound already reaches the need, which
holds only for y smaller than c. So the tokens outside c get prefixes and lists in turn,
and for the second case partners are looked up by size. The new lists go through the same
step with leads of their own, while one is left that has a lead not tried before and more
than one component; only sets of lists that have more than one take part. Pairs are listed in short lists, and in lists still open after the
last round. Pairs inside a component cannot change it.

Shuffled: prefix postings packed per batch and bucket, lists of shared tokens, and the
texts of documents that have a candidate. Sets are known by 64-bit hashes of their
tokens; should two different sets have one, all is done again with other hashes.

Defined results: rows without words have an empty set and are linked with nothing, so
component_id is their own doc_id. Rows may repeat a doc_id. component_id is the smallest
id that is not null, or null where a component has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import words as W
from loomtrace.llm.apart import set_apart
from loomtrace.llm.graph import components
from loomtrace.session import anchor

SHINGLE = 5
#: Similarity as a ratio of whole numbers.
SHARE, OF = 75, 100
#: A set of n tokens asks for n // MATCHES matches (one at least), or a multiple of them.
MATCHES, MULTIPLES = 16, (1, 2, 4)
#: Verifying a candidate costs as much as so many postings.
VERIFY_COST = 8
#: Pairs of sets outside their lead are listed in lists of so many sets at most.
SHORT = 64
#: Rounds of leads; of lists still open after them pairs between components are listed.
ROUNDS = 3
#: Pairs with one lead that a task joins to its text.
PART = 4096
#: Bits of the filter that finds the texts of candidates where they are read.
FILTER_BITS = 1 << 23
CELLS, CELL_SLICES = 1 << 20, 16
#: Text bytes whose postings one bucket holds.
BUCKET_BYTES = 24 << 20


def shingle_sets(column: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, back to back, and where each begins."""
    texts = W.texts_of(column, lower=True)
    words = W.words_of(texts)
    key = W.hashes(texts.data, words.start, words.end, seed)
    n_words = np.diff(words.first)
    at = W.windows(words, SHINGLE)
    token, text = [W.window_hashes(key, SHINGLE)[at]], [words.text[at]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n_words == k)
        if len(short):
            token.append(W.mixed(W.window_hashes(key, k)[words.first[short]] + np.uint64(k)))
            text.append(short)
    token, text = np.concatenate(token), np.concatenate(text)
    order = np.argsort(token)
    order = order[np.argsort(text[order].astype(np.uint16 if len(n_words) < 1 << 16 else np.int64), kind="stable")]
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return token, np.searchsorted(text, np.arange(len(n_words) + 1))


def _nodes(token: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set; 0 for empty sets."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(token + np.uint64(seed)), dtype=np.uint64)])
    size = np.diff(first).astype(np.uint64)
    node = W.mixed((total[first[1:]] - total[first[:-1]]) ^ size)
    return np.where(size > 0, np.maximum(node, 1), 0).view(np.int64)


_FIRST = "doc_id long, mark long, node long, proof long, n_shingles long, slice int, part int, cells binary"


def _describe(seed: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["doc_id", "mark", "node", "proof", "n_shingles", "slice", "part", "cells"]
        for batch in W.slices(batches, "text"):
            token, first = shingle_sets(batch.column("text"), seed)
            cells += np.bincount((token % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            n = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("mark"),
                    pa.array(_nodes(token, first, seed)),
                    pa.array(_nodes(token, first, seed + 1)),
                    pa.array(np.diff(first)),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        n = CELL_SLICES
        part = TaskContext.get().partitionId() % 1024
        none = pa.nulls(n, pa.int64())
        loads = pa.array([W.packed(x) for x in np.split(cells, n)], pa.binary())
        yield pa.record_batch([none] * 5 + [pa.array(np.arange(n, dtype=np.int32)), pa.array([part] * n, pa.int32()), loads], names)

    return describe


def _summed(table: pa.Table) -> pa.Table:
    total = sum(W.unpacked(x)[0] for x in table.column("cells").to_pylist())
    return pa.table([table.column("slice")[:1], table.column("part")[:1], pa.array([W.packed(total)], pa.binary())], ["slice", "part", "cells"])


def _frequencies(first: DataFrame) -> np.ndarray:
    """Counts of all shingles in CELLS cells, less what chance puts in each."""
    cells = first.filter("slice IS NOT NULL").select("slice", "part", "cells")
    for fewer in (1024, 32, 1):
        cells = cells.withColumn("part", F.col("part") % fewer)
        cells = cells.groupBy("slice", "part").applyInArrow(_summed, "slice int, part int, cells binary")
    rows = sorted(cells.select("slice", "cells").collect())
    total = np.concatenate([W.unpacked(r.cells)[0] for r in rows]) if rows else np.zeros(CELLS, np.int64)
    usual = total.mean()
    return np.maximum(total - usual - 4 * np.sqrt(usual) - 1, 0).astype(np.float32)


def _ordered(token: np.ndarray, text: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """The global order of tokens in each text: thought rare first, then by hash.

    The tokens must come sorted by text and hash.
    """
    extra = excess[(token % np.uint64(CELLS)).astype(np.int64)]
    return np.argsort(text * 64 + np.log2(1 + extra).astype(np.int64), kind="stable")


def _prefixes(token: np.ndarray, first: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix tokens of each set, the set of each, and the fewest matches of a pair with it.

    A partner has 75 % of its tokens at least, and asks for matches by the same rule.
    """
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    token = token[_ordered(token, text, excess)]
    extra = excess[(token % np.uint64(CELLS)).astype(np.int64)]
    hits = np.concatenate([[0.0], np.cumsum(1 + extra, dtype=np.float64)])
    least = -(-SHARE * n // OF)
    base = n - least
    matches, best = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for times in MULTIPLES:
        m = times * np.maximum(1, n // MATCHES)
        fits = m <= least
        hit = hits[first[:-1] + np.where(fits, base + m, 0)] - hits[first[:-1]]
        cost = np.where(fits, hit * (1 + VERIFY_COST / m), np.inf)
        better = cost < best
        matches[better], best[better] = m[better], cost[better]
    size = np.where(n > 0, base + matches, 0)
    cut = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(first[:-1] - cut[:-1], size) + np.arange(cut[-1])
    return token[take], np.repeat(np.arange(len(n)), size), np.maximum(1, least // MATCHES)


_POSTED = "bucket long, load binary"


def _posted(token: np.ndarray, own: np.ndarray, node: np.ndarray, size: np.ndarray, need: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings packed by bucket; own is the place of each token's set in the other arrays.

    The remainder of a token is its bucket, so only the quotient is sent.
    """
    token, bucket = np.divmod(token >> np.uint64(16), np.uint64(buckets))
    bucket = bucket.astype(np.int64)
    order = np.lexsort((token, bucket))
    token, own, bucket = token[order], own[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    loads = []
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True) if len(cut) else ():
        mine, index = np.unique(own[a:b], return_inverse=True)
        steps = np.diff(token[a:b], prepend=np.uint64(0))
        loads.append(W.packed(node[mine], size[mine].astype(np.int64), need[mine].astype(np.int32), index.astype(np.int32), steps))
    return pa.record_batch([pa.array(bucket[cut]), pa.array(loads, pa.binary())], ["bucket", "load"])


def _send(seed: int, buckets: int, excess):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            token, first = shingle_sets(batch.column("text"), seed)
            node, size = _nodes(token, first, seed), np.diff(first)
            token, text, matches = _prefixes(token, first, excess.value)
            _, once = np.unique(node, return_index=True)
            mine = np.isin(text, once)
            yield _posted(token[mine], text[mine], node, size, matches, buckets)

    return send


_LISTS = "list long, node long, size long, need int, times long, long long"


def _listed(table: pa.Table) -> pa.Table:
    """The sets that share a token, for each set of them once, with tokens and sets counted."""
    nodes, sizes, needs, index, tokens = [], [], [], [], []
    n = 0
    for load in table.column("load").to_pylist():
        node, size, need, at, steps = W.unpacked(load)
        nodes.append(node)
        sizes.append(size)
        needs.append(need)
        index.append(at + n)
        tokens.append(np.cumsum(steps, dtype=np.uint64))
        n += len(node)
    node, at = np.unique(np.concatenate(nodes), return_inverse=True)
    size, need = np.empty(len(node), np.int64), np.empty(len(node), np.int32)
    size[at], need[at] = np.concatenate(sizes), np.concatenate(needs)
    token, place = np.concatenate(tokens), at[np.concatenate(index)]
    times, _ = W.groups(token)
    some = np.flatnonzero(times > 1)
    order = some[np.lexsort((place[some], token[some]))]
    token, place = token[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (place[1:] != place[:-1])
    token, place = token[new], place[new]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    long = np.diff(np.append(head, len(token)))
    head, long = head[long > 1], long[long > 1]
    marks = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(node[place].view(np.uint64)), dtype=np.uint64)])
    label = W.mixed(marks[head + long] - marks[head])
    label, once, times = np.unique(label, return_index=True, return_counts=True)
    head, long = head[once], long[once]
    cut = np.concatenate([[0], np.cumsum(long)])
    take = place[np.repeat(head - cut[:-1], long) + np.arange(cut[-1])]
    columns = [np.repeat(label.view(np.int64), long), node[take], size[take], need[take], np.repeat(times, long), np.repeat(long, long)]
    return pa.table([pa.array(c) for c in columns], ["list", "node", "size", "need", "times", "long"])


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * OF >= F.greatest(a, b) * SHARE


def _maybe_among(rows: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are among the chosen ones, and some more.

    A Bloom filter of one hash and fixed size; the fuller it is, the more gets through.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)).alias("bit")
    cells = chosen.select(bit).groupBy(F.shiftright("bit", 6).alias("cell"))
    there = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in cells.agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).collect():
        there[r["cell"]] = r["bits"]
    shared = rows.sparkSession.sparkContext.broadcast(there)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).drop_columns(["bit"])

    return rows.select("*", bit).mapInArrow(keep, rows.schema)


def _node_texts(docs: DataFrame, described: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(node, text): a packed text of each of the nodes."""
    rows = described.join(nodes, "node").groupBy("node", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = F.min(F.struct("doc_id", "mark", "n")).alias("best")
    chosen = anchor(rows.groupBy("node").agg(best).select("node", F.col("best.doc_id").alias("_id"), F.col("best.mark").alias("_mark"), "best.n"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    keys = chosen.select(F.col("_id").alias("doc_id"), F.col("_mark").alias("mark"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            texts = [W.packed(np.frombuffer(x.encode(), np.uint8), level=6) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(texts, pa.binary())], ["doc_id", "mark", "text"])

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", 1 << 20):
            texts = [W.unpacked(x)[0].tobytes() for x in batch.column("text").to_pylist()]
            token, first = shingle_sets(pa.array(texts, pa.large_binary()), seed)
            yield batch.filter(pa.array(_nodes(token, first, seed) == batch.column("node").to_numpy()))

    def texts_of(some: DataFrame) -> DataFrame:
        packed = _maybe_among(source.filter("text IS NOT NULL"), keys, "doc_id", "mark").mapInArrow(small, "doc_id long, mark long, text binary")
        met = packed.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")
        return met.mapInArrow(right, "node long, text binary")

    texts, repeated = texts_of(chosen.filter("n = 1")), chosen.filter("n > 1")
    return texts.unionByName(texts_of(repeated).dropDuplicates(["node"])) if repeated.take(1) else texts


_TRIED = "a long, b long, a_size long, b_size long, shared long, linked boolean, more boolean, rest binary"


def _tried(pairs: DataFrame, texts: DataFrame, seed: int, excess) -> DataFrame:
    """Pairs of nodes by their whole sets: sizes, shared tokens, and whether linked.

    Of pairs marked more also rest: the prefix of the tokens of b outside a. Leads have
    short texts for their lists, so the text of a travels to b. The pairs of one a are
    dealt over parts of PART pairs.
    """
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.select("a", "b", "more").join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    leads = parts.join(_maybe_among(a, parts, "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def outside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """With s tokens in common, another set that is linked to y shares the rest of
        ceil(0.75 |y|) outside x, one token at least."""
        left = y[~np.isin(y, x, assume_unique=True)]
        wanted = max(1, -(-SHARE * len(y) // OF) - (len(y) - len(left)))
        left = left[_ordered(left, np.zeros(len(left), np.int64), excess.value)]
        return left[: max(0, len(left) - wanted + 1)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "b_text", 1 << 20):
            ends = [batch.column(x).to_numpy() for x in "ab"]
            text = dict(zip(np.concatenate(ends).tolist(), (*batch.column("a_text").to_pylist(), *batch.column("b_text").to_pylist()), strict=True))
            place = {node: i for i, node in enumerate(text)}
            token, first = shingle_sets(pa.array([W.unpacked(x)[0].tobytes() for x in text.values()], pa.large_binary()), seed)
            sets = [token[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
            shared, rest = np.zeros(batch.num_rows, np.int64), []
            sizes = np.zeros((2, batch.num_rows), np.int64)
            more = batch.column("more").to_pylist()
            for i, (x, y) in enumerate(zip(*(e.tolist() for e in ends), strict=True)):
                x, y = sets[place[x]], sets[place[y]]
                both = np.concatenate([x, y])
                both.sort()
                shared[i], sizes[:, i] = (both[1:] == both[:-1]).sum(), (len(x), len(y))
                rest.append(W.packed(outside(x, y)) if more[i] else None)
            linked = OF * shared >= SHARE * (sizes.sum(0) - shared)
            columns = [*ends, *sizes, shared, linked, np.array(more, bool)]
            yield pa.record_batch([*map(pa.array, columns), pa.array(rest, pa.binary())], [c.split()[0] for c in _TRIED.split(", ")])

    met = dealt.drop("parts").join(leads, ["a", "part"]).join(_maybe_among(b, pairs, "b"), "b").select("a", "b", "more", "a_text", "b_text")
    return met.mapInArrow(verify, _TRIED)


def _again(buckets: int):
    """Postings of the tokens outside the lead, in lists of the sets tried with one lead."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "rest", 1 << 20):
            rest = [W.unpacked(x)[0] for x in batch.column("rest").to_pylist()]
            own = np.repeat(np.arange(len(rest)), [len(x) for x in rest])
            lead = batch.column("a").to_numpy().view(np.uint64)
            token = W.mixed(np.concatenate([np.zeros(0, np.uint64), *rest]) ^ W.mixed(lead[own]))
            node, size = batch.column("b").to_numpy(), batch.column("b_size").to_numpy()
            yield _posted(token, own, node, size, np.ones(len(size), np.int32), buckets)

    return send


def _led(lists: DataFrame) -> DataFrame:
    """(list, node, a, more): the sets of each list, its lead, and whether two others are there.

    A set stays if it has as many shared tokens as a pair with it needs.
    """
    degree = lists.groupBy("node").agg(
        F.sum("times").alias("degree"),
        F.first("need").alias("need"),
        (F.sum(F.col("times") * F.col("long")) / F.first("size")).alias("middle"),
    )
    kept = lists.select("list", "node").join(degree.filter("degree >= need").select("node", "middle"), "node")
    lead = kept.groupBy("list").agg(F.max_by("node", F.struct("middle", "node")).alias("a"), (F.count("*") > 2).alias("more"))
    return kept.select("list", "node").join(lead, "list")


def _stars(led: DataFrame) -> DataFrame:
    """(a, b, more): the lead of each list with every other set of it."""
    return led.filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.bool_or("more").alias("more"))


def _apart(led: DataFrame, tried: DataFrame, found: DataFrame) -> DataFrame | None:
    """What was tried with the leads of lists that are not in one component, or None.

    Two linked sets are together in a list. While their components differ, that list is
    open, so both are here with its lead. What the filter lets through besides is compared
    in vain, but changes no result.
    """
    pairs = anchor(_open(led.filter("more"), found).filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    return _maybe_among(tried.filter("more"), pairs, "a", "b") if pairs.take(1) else None


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the lists that are not in one component, with their component as of."""
    of = F.coalesce("component", "node").alias("of")
    rows = lists.join(found, "node", "left").select(*lists.columns, of)
    apart = rows.groupBy("list").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high")
    return rows.join(apart.select("list"), "list")


def _pairs_between(rows: DataFrame) -> DataFrame:
    """All pairs of an open list between components, from the smaller components' side."""
    held = rows.groupBy("list", "of").agg(F.count("*").alias("n"))
    most = held.groupBy("list").agg(F.max_by("of", F.struct("n", "of")).alias("main"))
    rows = rows.join(most, "list")
    one = rows.filter("of <> main").select("list", *(F.col(c).alias(f"a_{c}") for c in ("node", "size", "of")))
    two = rows.select("list", *(F.col(c).alias(f"b_{c}") for c in ("node", "size", "of")), (F.col("of") == F.col("main")).alias("in_main"))
    met = one.join(two, "list").filter((F.col("a_of") != F.col("b_of")) & (F.col("in_main") | (F.col("a_node") < F.col("b_node"))) & _sizes_fit("a_size", "b_size"))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _pairs_by_size(tried: DataFrame) -> DataFrame:
    """Pairs tried with one lead that may be linked by their tokens in the lead alone."""
    sides = tried.select("a", F.col("b").alias("node"), F.col("b_size").alias("size"), "shared", "linked")
    # Of a pair x, y the shared tokens must reach 0.75 / 1.75 of both sizes.
    reach = F.floor(F.col("shared") * (SHARE + OF) / SHARE).cast("long") - F.col("size")
    far = sides.filter(~F.col("linked")).withColumn("reach", reach).filter(F.col("reach") * OF >= F.col("size") * SHARE)
    sizes = sides.select("a", F.col("size").alias("y_size")).distinct()
    asked = far.join(sizes, "a").filter((F.col("y_size") <= F.col("reach")) & (F.col("y_size") * OF >= F.col("size") * SHARE))
    asked = asked.select("a", F.col("node").alias("x"), F.col("size").alias("x_size"), "y_size")
    others = sides.select("a", F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("shared").alias("y_shared"))
    met = asked.join(others, ["a", "y_size"]).filter((F.col("x") != F.col("y")) & (F.col("y_shared") * (SHARE + OF) >= SHARE * (F.col("x_size") + F.col("y_size"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _lists(posted: DataFrame) -> DataFrame:
    """(list, node, size, need, times) of the sets that share tokens, pinned."""
    lists = posted.groupBy("bucket").applyInArrow(_listed, _LISTS)
    return anchor(lists.groupBy("list", "node").agg(F.first("size").alias("size"), F.first("need").alias("need"), F.sum("times").alias("times"), F.first("long").alias("long")))


def _described(docs: DataFrame) -> tuple[DataFrame, int]:
    """The first pass, with hashes under which different sets have different nodes."""
    for seed in count(0, 2):
        first = anchor(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_describe(seed), _FIRST))
        sets = first.filter("slice IS NULL").groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high"))
        if not sets.filter("low <> high").take(1):
            return first, seed


def labelled(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles and component (null: empty set) of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first, seed = _described(docs)
    described = first.filter("slice IS NULL").select("doc_id", "mark", "node", "n_shingles")
    excess = spark.sparkContext.broadcast(_frequencies(first))
    buckets = max(1, -(-size // bucket_bytes))
    posted = docs.select("doc_id", "text").mapInArrow(_send(seed, buckets, excess), _POSTED)
    lists = _lists(posted)
    led = anchor(_led(lists))
    stars = anchor(_stars(led))
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    texts = anchor(_node_texts(docs, described, ends, seed))

    tried = anchor(_tried(stars, texts, seed, excess))
    found = components(tried.filter("linked").select("a", "b"))
    for turn in count(1):
        apart = _apart(led, tried, found)
        if apart is None:
            break
        again = _lists(apart.select("a", "b", "b_size", "rest").mapInArrow(_again(buckets), _POSTED))
        again = anchor(_open(again, found))
        led = anchor(_led(again.filter(F.col("long") > SHORT).drop("of")))
        stars = anchor(_stars(led).join(tried.filter("more").select("a", "b"), ["a", "b"], "left_anti"))
        pairs = _pairs_between(again.filter(F.col("long") <= SHORT)).unionByName(_pairs_by_size(apart))
        done = turn == ROUNDS or not stars.take(1)
        if done:
            pairs = pairs.unionByName(_pairs_between(again.filter(F.col("long") > SHORT)))
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.distinct().join(known, ["a", "b"], "left_anti").withColumn("more", F.lit(False))
        # Read for two filters and the join: unless pinned, planned and made three times over.
        wanted = anchor(stars.unionByName(pairs))
        new = anchor(_tried(wanted, texts, seed, excess))
        tried = tried.unionByName(new)
        links = new.filter("linked").select("a", "b")
        if links.take(1):
            found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if done:
            break

    label = F.coalesce("component", "node")
    of = F.when(F.col("n_shingles") > 0, label).alias("component")
    return described.join(found, "node", "left").select("doc_id", "mark", "n_shingles", of)


def link_components(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = anchor(labelled(docs, bucket_bytes))
    least = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    component_id = F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", component_id.alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first of their component, one row of each.

    Rows with empty sets are linked with nothing and all stay. First is the smallest id;
    of rows that repeat it, the one of the smallest hash of its text.
    """
    kept = set_apart(docs, ("doc_id", "text"))
    return kept.back(_firsts(kept.docs))


def _firsts(docs: DataFrame) -> DataFrame:
    rows = anchor(labelled(docs))
    best = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.doc_id", "best.mark")
    times = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("_of"), F.max("n_shingles").alias("n"))
    same = best["doc_id"].eqNullSafe(times["doc_id"]) & best["mark"].eqNullSafe(times["mark"])
    stays = times.join(best, same, "left_semi").unionByName(times.filter("n = 0").withColumn("_of", F.lit(1).cast("long")))
    stays = stays.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_of")
    met = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_mark")))
    alike = Window.partitionBy("_id", "_mark").orderBy("_of")
    more = met.filter("_of > 1").withColumn("_nth", F.row_number().over(alike)).filter("_nth = 1")
    return met.filter("_of = 1").select(*docs.columns).unionByName(more.select(*docs.columns))
