"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model is a SentencePiece BPE file with byte fallback. A segmentation is a path of
pieces through the text. The weight of a piece after another is 0 where merging their
joined text gives exactly these two, and minus infinity otherwise; the one path of weight
0 is the encoding the model's merges give. So the best path is a max-plus product of
weights, which can be cut anywhere and combined associatively:

1. A giant document becomes chunks of CHUNK characters. The states at a border are the
   pieces that may hold the character before it. For each chunk a matrix says which
   states at its end can follow which at its begin.
2. FAN matrices at a time are multiplied, level by level, until one is left.
3. Going back down, every border gets its one state on the best path.
4. Each chunk is then traced back on its own between its two states.

Other documents are one chunk each and need only the last step. Between two characters
that no piece holds side by side no piece can lie across, so words are traced one by one;
the path of a short one is what the merges of the library give. Each worker keeps the ids
of up to CACHE words it has met.

A chunk is at most 2 * CHUNK characters and a product takes FAN small matrices, whatever
the document's length. Only the finished ids of a document come together again, as the
row that its text was.

Defined results: a null text has null ids and decodes to null, an empty one has none and
decodes to empty. Decoding gives the text back, but for the mark that stands for a space
(U+2581), which becomes a space, as in the model itself. Columns of the input stay, but
for those named ids (and decoded). Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm import words as W
from loomtrace.session import anchor

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN, CACHE = 1 << 15, 64, 100_000
#: Up to this length merging a word is faster than tracing its path, beyond it slower.
SHORT = 64
SPACE = "▁"
#: The largest model that is sent to the executors.
MOST_MODEL_BYTES = 64 << 20


#: Ids decoded at once.
DECODED_IDS = 1 << 19
#: What an unknown piece is decoded to.
UNKNOWN = " \u2047 ".encode()
_EACH_BYTE = "each-byte-replaced"
codecs.register_error(_EACH_BYTE, lambda error: ("\ufffd" * (error.end - error.start), error.end))


class Pieces:
    """The vocabulary of a model and its segmentation of strings."""

    def __init__(self, model: bytes) -> None:
        self.given = given = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(given.get_piece_size())
        self.byte = [0] * 256
        for i in every:
            if given.is_byte(i):
                self.byte[int(given.id_to_piece(i)[1:-1], 16)] = i
        normal = [i for i in every if not (given.is_byte(i) or given.is_control(i) or given.is_unknown(i) or given.is_unused(i))]
        self.id = {given.id_to_piece(i): i for i in normal}
        self.score = {given.id_to_piece(i): given.get_score(i) for i in normal}
        self.longest = max(map(len, self.id))
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.inside):
            raise ValueError("pieces of this model hold a space after other characters")
        text = [UNKNOWN if given.is_unknown(i) else b"" for i in every]
        for piece, i in self.id.items():
            text[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte):
            text[i] = bytes([value])
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.control = np.array([given.is_control(i) for i in every])
        self.spaced = np.isin(every, [i for p, i in self.id.items() if p.startswith(SPACE)])
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.follows: dict[tuple[str, str], bool] = {}
        #: Pieces that merging their characters gives.
        self.whole = frozenset(p for p in self.id if len(p) > 1 and self.merged(p) == [p])
        self.known: dict[str, list[int]] = {}

    def merged(self, s: str) -> list[str]:
        """The model's merges: best score first, then leftmost."""
        score, none = self.score.get, -np.inf
        parts = list(s)
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            piece = parts[at] = parts[at] + parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + piece, none)
            if at < len(pairs):
                pairs[at] = score(piece + parts[at + 1], none)
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the weight of b after a is 0."""
        if a[-1] + b[0] not in self.inside:
            return True
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) >= CACHE:
                self.follows.clear()
            found = self.follows[a, b] = self.merged(a + b) == [a, b]
        return found

    def is_piece(self, s: str) -> bool:
        """A character, or a piece that merging its characters gives."""
        return len(s) == 1 or s in self.whole

    def paths(self, s: str, begin: int, end: int, before: str | None) -> list[int]:
        """For each place up to end: length of the last piece of the path from begin, or 0.

        before is the piece that ends at begin. From one state at most one path of weight 0
        leads to a place, so one number each is the whole row of the matrix.
        """
        last = [0] * (end + 1)
        whole, inside, known, longest = self.whole, self.inside, self.follows, self.longest
        for i in range(begin + 1, end + 1):
            for j in range(max(begin, i - longest), i):
                if j > begin:
                    if not last[j]:
                        continue
                    piece = s[j:i]
                    if i - j > 1 and piece not in whole:
                        continue
                    if s[j - 1 : j + 1] in inside:
                        prior = s[j - last[j] : j]
                        fits = known.get((prior, piece))
                        if not (self.may_follow(prior, piece) if fits is None else fits):
                            continue
                else:
                    piece = s[j:i]
                    if (i - j > 1 and piece not in whole) or (before is not None and not self.may_follow(before, piece)):
                        continue
                last[i] = i - j
                break
        return last

    def traced(self, s: str) -> list[str]:
        """The path of weight 0 through a whole string, which is what merging it gives."""
        last, at, parts = self.paths(s, 0, len(s), None), len(s), []
        while at:
            parts.append(s[at - last[at] : at])
            at -= last[at]
        return parts[::-1]

    def ids_of_word(self, s: str) -> list[int]:
        found = []
        for piece in self.merged(s) if len(s) <= SHORT else self.traced(s):
            i = self.id.get(piece)
            found.extend([i] if i is not None else (self.byte[b] for b in piece.encode()))
        return found

    def learn(self, words: set[str]) -> None:
        """Keep the ids of new words; the library merges the short ones behind a space."""
        if len(self.known) + len(words) > CACHE:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        short = [w for w in new if w[0] == SPACE and 1 < len(w) <= SHORT]
        self.known.update(zip(short, self.given.encode([w[1:] for w in short], num_threads=1), strict=True))
        self.known.update((w, self.ids_of_word(w)) for w in set(new).difference(short))

    def ids(self, s: str) -> list[int]:
        """Ids of a string in which spaces are marked."""
        out: list[int] = []
        words = self.words.findall(s)
        if any(w not in self.known for w in words):
            self.learn(set(words))
        for found in map(self.known.__getitem__, words):
            out += found
        return out

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of lists of any ids, also of parts of a text's; lists lie back to back.

        The space that encoding puts first goes if it is there. Unknown pieces give their
        sign, controls nothing, and bytes that are no character U+FFFD each. An id that is
        no piece is an error.
        """
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.begin) - 1):
            raise IndexError("an id is no piece of the model")
        first = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        at = 0
        while at < len(sizes):
            to = max(int(np.searchsorted(first, first[at] + DECODED_IDS, "right")) - 1, at + 1)
            own = ids[first[at] : first[to]]
            texts = W.gather(self.flat, self.begin[own], self.begin[own + 1])
            bounds, whole = texts.bounds[first[at : to + 1] - first[at]], texts.data.tobytes()
            real = np.flatnonzero(~self.control[own])
            head = np.append(real, len(own))[np.searchsorted(real, first[at:to] - first[at])]
            spaced = (head < first[at + 1 : to + 1] - first[at]) & np.append(self.spaced[own], False)[head]
            out += [whole[a:b].decode(errors=_EACH_BYTE) for a, b in zip(bounds[:-1] + spaced, bounds[1:], strict=True)]
            at = to
        return out

    def is_cut(self, s: str, i: int) -> bool:
        """Whether no piece can lie across place i."""
        return s[i - 1 : i + 1] not in self.inside

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """Pieces that may hold the character before a border: begin and end."""
        reach = self.longest
        return [
            (b, e)
            for b in range(max(0, at - reach), at)
            for e in range(at, min(len(s), b + reach) + 1)
            if self.is_piece(s[b:e])
        ]


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def load_model(path: str = MODEL) -> bytes:
    """A model's bytes, read where the driver runs; they are sent with the tasks."""
    with open(path, "rb") as file:
        model = file.read()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError("the model is too large to send to every executor")
    return model


def _marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _list_of(flat: array, sizes: list[int], valid: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)), mask=pa.array(~valid))


def _small(model, column: str = "text"):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in W.slices(batches, column):
            texts = batch.column(batch.schema.get_field_index(column))
            flat, sizes = array("i"), []
            for text in texts.to_pylist():
                found = pieces.ids(_marked(text)) if text else []
                flat.extend(found)
                sizes.append(len(found))
            ids = _list_of(flat, sizes, texts.is_valid().to_numpy(zero_copy_only=False))
            yield batch.drop_columns([column]).append_column("ids", ids)

    return encode


# Giant documents ----------------------------------------------------------------------


def _cut(model, chunk: int, kept: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _pieces(model.value).longest
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i in range(batch.num_rows):
                s = _marked(batch.column(at)[i].as_py())
                n = max(1, len(s) // chunk)
                own = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in kept]
                for k in range(n):
                    a, b = k * chunk, (k + 1) * chunk if k < n - 1 else len(s)
                    parts = [s[max(0, a - reach) : a], s[a:b], s[b : b + reach]]
                    yield pa.record_batch(
                        [pa.array([row]), pa.array([k]), *(pa.array([x]) for x in parts), *own], ["_row", "_chunk", "_before", "_body", "_after", *kept]
                    )
                row += 1

    return cut


_MATRIX = "_row long, _chunk long, rows int, weights binary"


def _borders(pieces: Pieces, before: str, body: str, after: str) -> tuple[str, int, int, list, list]:
    """The chunk with its surroundings, its borders in it, and the states at both."""
    s, a = before + body + after, len(before)
    b = a + len(body)
    begin = pieces.states(s, a) if before else [(0, 0)]
    end = pieces.states(s, b)
    return s, a, b, begin, end if after else [x for x in end if x[1] == b]


def _transfer(pieces: Pieces, before: str, body: str, after: str) -> np.ndarray:
    """Weights (0 or minus infinity) from each state at the begin to each at the end."""
    s, a, b, begin, end = _borders(pieces, before, body, after)
    reach = pieces.longest
    cut = next((i for i in range(a + reach, b - reach + 1) if pieces.is_cut(s, i)), None)
    weights = np.full((len(begin), len(end)), -np.inf)

    def reached(start: int, prior: str | None) -> np.ndarray:
        last = pieces.paths(s, start, b, prior)
        out = np.zeros(len(end), bool)
        for k, (i, j) in enumerate(end):
            if i == start:
                out[k] = prior is None or pieces.may_follow(prior, s[i:j])
            elif i > start and last[i]:
                out[k] = pieces.may_follow(s[i - last[i] : i], s[i:j])
        return out

    if cut is None:
        for k, (i, j) in enumerate(begin):
            weights[k, reached(j, s[i:j] or None)] = 0
        return weights
    alive = [pieces.paths(s, j, cut, s[i:j] or None)[cut] > 0 for i, j in begin]
    final = next(i for i in range(b - reach, cut - 1, -1) if i == cut or pieces.is_cut(s, i))
    weights[np.ix_(alive, reached(final, None))] = 0
    return weights


def _matrices(model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            found = [_transfer(pieces, *parts) for parts in zip(*(batch.column(c).to_pylist() for c in ("_before", "_body", "_after")), strict=True)]
            rows, loads = [len(x) for x in found], [W.packed(x.ravel()) for x in found]
            yield pa.record_batch([batch.column("_row"), batch.column("_chunk"), pa.array(rows, pa.int32()), pa.array(loads, pa.binary())], ["_row", "_chunk", "rows", "weights"])

    return measure


def _opened(table: pa.Table) -> list[np.ndarray]:
    return [W.unpacked(w)[0].reshape(n, -1) for n, w in zip(table.column("rows").to_pylist(), table.column("weights").to_pylist(), strict=True)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _multiplied(table: pa.Table) -> pa.Table:
    table = table.sort_by("_chunk")
    found = _opened(table)
    product = found[0]
    for x in found[1:]:
        product = _times(product, x)
    one = [table.column("_row")[0].as_py()], [table.column("_chunk")[0].as_py() // FAN], [len(product)], [W.packed(product.ravel())]
    kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary()
    return pa.table([pa.array(c, t) for c, t in zip(one, kinds, strict=True)], ["_row", "_chunk", "rows", "weights"])


_ENDS = "_row long, _chunk long, enter int, leave int"


def _split(table: pa.Table) -> pa.Table:
    """States between the factors of a product whose first and last states are known."""
    table = table.sort_by("_chunk")
    found = _opened(table)
    enter, leave = table.column("enter")[0].as_py(), table.column("leave")[0].as_py()
    reach = [np.where(np.arange(len(found[0])) == enter, 0.0, -np.inf)]
    for x in found:
        reach.append((reach[-1][:, None] + x).max(axis=0))
    states = [leave if leave is not None else int(reach[-1].argmax())]
    for k in range(len(found) - 1, -1, -1):
        states.append(int((reach[k] + found[k][:, states[-1]]).argmax()))
    states.reverse()
    return pa.table([table.column("_row"), table.column("_chunk"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], ["_row", "_chunk", "enter", "leave"])


def _traced(model, kept: list[str]):
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in W.slices(batches, "_body"):
            flat, sizes = array("i"), []
            for before, body, after, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("_before", "_body", "_after", "enter", "leave")), strict=True):
                s, _, _, begin, end = _borders(pieces, before, body, after)
                (i, j), (k, m) = begin[enter], end[leave]
                found = pieces.ids(s[i:m])[len(pieces.ids(s[i:j])) :]
                flat.extend(found)
                sizes.append(len(found))
            ids = _list_of(flat, sizes, np.ones(len(sizes), bool))
            yield pa.record_batch([batch.column(c) for c in ("_row", "_chunk")] + [ids] + [batch.column(c) for c in kept], ["_row", "_chunk", "ids", *kept])

    return trace


def _giant(docs: DataFrame, model, chunk: int) -> DataFrame:
    own = [c for c in docs.columns if c != "text"]
    names = [f"_kept{i}" for i in range(len(own))]
    docs = docs.select("text", *(F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)))
    kept = docs.schema.fields[1:]
    long, string = T.LongType(), T.StringType()
    head = [T.StructField(c, t) for c, t in (("_row", long), ("_chunk", long), ("_before", string), ("_body", string), ("_after", string))]
    chunks = anchor(docs.mapInArrow(_cut(model, chunk, names), T.StructType(head + kept)))
    levels = [anchor(chunks.select("_row", "_chunk", "_before", "_body", "_after").repartition("_row", "_chunk").mapInArrow(_matrices(model), _MATRIX))]
    last = levels[0].agg(F.max("_chunk")).first()[0] or 0
    while last:
        block = F.expr(f"_chunk div {FAN}").alias("_block")
        levels.append(anchor(levels[-1].groupBy("_row", block).applyInArrow(_multiplied, _MATRIX)))
        last //= FAN
    ends = levels[-1].select("_row", "_chunk", F.lit(0).alias("enter"), F.lit(None).cast("int").alias("leave"))
    for level in reversed(levels[:-1]):
        parents = ends.select("_row", F.col("_chunk").alias("_block"), "enter", "leave")
        met = level.withColumn("_block", F.expr(f"_chunk div {FAN}")).join(parents, ["_row", "_block"])
        ends = met.groupBy("_row", "_block").applyInArrow(_split, _ENDS)
    if len(levels) == 1:
        ends = levels[0].withColumn("enter", F.lit(0)).withColumn("leave", F.lit(None).cast("int")).groupBy("_row").applyInArrow(_split, _ENDS)
    schema = T.StructType(head[:2] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + kept)
    traced = chunks.join(ends, ["_row", "_chunk"]).mapInArrow(_traced(model, names), schema)
    whole = traced.groupBy("_row").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "ids"))), lambda x: x["ids"])).alias("ids"), *(F.first(c).alias(c) for c in names)
    )
    return whole.select(*(F.col(n).alias(c) for c, n in zip(own, names, strict=True)), "ids")


def encode(docs: DataFrame, model: bytes, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids in place of text, the model's piece ids of each whole text."""
    docs = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    giant = F.length("text") >= 2 * chunk
    schema = T.StructType([*docs.drop("text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    small = docs.filter(~F.coalesce(giant, F.lit(False))).mapInArrow(_small(shared), schema)
    return small.unionByName(_giant(docs.filter(giant), shared, chunk))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` with decoded, the text of their ids."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def decode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            there = column.is_valid().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = pieces.decoded(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            texts = [t if ok else None for t, ok in zip(found, there, strict=True)]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(decode_all, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
