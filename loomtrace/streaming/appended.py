"""A streaming source of growing text files: appended bytes are read once.

Spark's own file source takes a file once, when it appears. Here the offset is a map of
path to byte, kept in the query's checkpoint, so a trigger reads what was appended since
the last one and a restart goes on where it stopped. Only whole lines are taken; an
unfinished one waits for its end. A file that is shorter than what was read, or whose
first bytes changed, was begun anew and is read from its start. The bytes of a trigger
are cut into pieces of ``pieceBytes`` that tasks read side by side; a line belongs to the
piece in which it begins. Small pieces share a task, so that tasks do not outnumber cores
more than the bytes ask for.

Files are opened by path, so the folder has to be mounted alike on all machines.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
PIECE_BYTES, BATCH_LINES = 16 << 20, 10_000
#: Bytes of small pieces that one task reads, one piece after the other.
TASK_BYTES = 16 << 20
#: Tasks of a trigger before pieces share one.
LEAST_TASKS = 256
#: Bytes at a file's start by which it is known again.
HEAD_BYTES = 256
_STEP = 1 << 16


def local_path(path: str) -> str:
    """The path without a file: scheme; other schemes are no mounted folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {path}")
    return path


def whole_lines(path: str, size: int) -> int:
    """The byte after the last line end within the first ``size`` bytes."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            start = max(0, end - _STEP)
            file.seek(start)
            found = file.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def head_of(path: str, size: int) -> int:
    with open(path, "rb") as file:
        return zlib.crc32(file.read(size))


class Piece(InputPartition):
    """Lines that begin in [start, end) of a file of which all from ``first`` on is read."""

    def __init__(self, path: str, first: int, start: int, end: int):
        super().__init__((path, first, start, end))
        self.path, self.first, self.start, self.end = path, first, start, end


class Pieces(InputPartition):
    """Pieces that one task reads."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(tuple(p.value for p in pieces))
        self.pieces = pieces


class Appended(DataSourceStreamReader):
    """Offsets are {path: [bytes read, bytes of the head, crc32 of the head]}."""

    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes = local_path(path), piece_bytes
        self._known: dict[str, tuple[tuple[int, int], list[int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for folder, folders, names in os.walk(self.path):
            folders[:] = [f for f in folders if f[0] not in "._"]
            for name in names:
                if name[0] in "._":
                    continue
                path = os.path.join(folder, name)
                try:
                    found[path] = self._end(path)
                except FileNotFoundError:
                    continue
        return found

    def _end(self, path: str) -> list[int]:
        state = os.stat(path)
        seen = (state.st_size, state.st_mtime_ns)
        if path not in self._known or self._known[path][0] != seen:
            end = whole_lines(path, state.st_size)
            head = min(end, HEAD_BYTES)
            self._known[path] = seen, [end, head, head_of(path, head)]
        return self._known[path][1]

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        """Pieces side by side while they are few, else as many to a task as it reads."""
        pieces = self.pieces(start, end)
        share = max(1, min(TASK_BYTES // self.piece_bytes, len(pieces) // LEAST_TASKS))
        return [Pieces(pieces[a : a + share]) for a in range(0, len(pieces), share)]

    def pieces(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (to, _, _) in sorted(end.items()):
            since = self._since(path, start.get(path), to)
            out += [Piece(path, since, a, min(a + self.piece_bytes, to)) for a in range(since, to, self.piece_bytes)]
        return out

    def _since(self, path: str, before: list[int] | None, to: int) -> int:
        """Where to go on: what was read, or the start of a file begun anew."""
        if before is None or to < before[0] or head_of(path, before[1]) != before[2]:
            return 0
        return before[0]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._read(piece)

    def _read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        at, text = [], []
        with open(partition.path, "rb") as file:
            place = partition.start
            if place > partition.first:
                # the line that reaches into this piece belongs to the one before
                file.seek(place - 1)
                place += len(file.readline()) - 1
            else:
                file.seek(place)
            while place < partition.end:
                line = file.readline()
                if not line:
                    break
                at.append(place)
                text.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                place += len(line)
                if len(at) == BATCH_LINES:
                    yield _batch(partition.path, at, text)
                    at, text = [], []
        if at:
            yield _batch(partition.path, at, text)


def _batch(path: str, at: list[int], text: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(text)], ["path", "byte", "text"])


class AppendedLines(DataSource):
    """``spark.readStream.format("appended_lines").load(folder)``: path, byte, text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, byte long, text string"

    def streamReader(self, schema) -> Appended:
        return Appended(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


def appended_lines(spark: SparkSession, path: str, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, byte, text) of the lines below ``path``, as they are appended."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format(NAME).option("pieceBytes", piece_bytes).load(path)
