"""Packing of encoded documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import in_arrow


@dataclass(slots=True)
class Piece:
    """Ids of a document from `start` on; doc_tokens is the length of the whole document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


@dataclass(slots=True)
class Window:
    """A sequence that is being filled."""

    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Online packing into windows of `length` ids.

    counts[h] is the number of windows filled up to level h, and open[h] holds them. A piece of s ids goes to the
    level h (0: a new window) that leaves the sum of the squares of counts the least; a full window leaves at once and
    counts nothing. Of equally good levels the fullest is taken, so the result hangs on the order of pieces alone.
    """

    def __init__(self, length: int, most_open: int) -> None:
        self.length, self.most_open = length, most_open
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(length + 1)]
        self.n_open = 0

    def place(self, piece: Piece) -> Iterator[Window]:
        """Take a piece of at most `length` ids; yields the windows that are full by that."""
        s = len(piece.ids)
        levels = self.length - s + 1
        there, then = self.counts[:levels], self.counts[s:]
        change = np.where(there > 0, 2 * (then - there) + 2, np.iinfo(np.int64).max)
        if there[-1]:
            change[-1] = 1 - 2 * there[-1]
        change[0] = 2 * self.counts[s] + 1 if s < self.length else 0
        h = levels - 1 - int(change[::-1].argmin())
        if h:
            window = self.open[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        else:
            window = Window()
        window.add(piece)
        if window.fill == self.length:
            yield window
            return
        self.open[window.fill].append(window)
        self.counts[window.fill] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.drain()

    def drain(self) -> Iterator[Window]:
        """Fill the fullest open windows with ids cut from the emptiest, until one at most is left; that stays open."""
        left = [w for level in reversed(self.open) for w in level]
        for level in self.open:
            level.clear()
        self.counts[:] = 0
        i, j = 0, len(left) - 1
        while i < j:
            window, giver = left[i], left[j]
            while window.fill < self.length and giver.pieces:
                piece = giver.pieces.pop()
                room = self.length - window.fill
                if len(piece.ids) > room:
                    taken, rest = piece.cut(room)
                    giver.pieces.append(rest)
                    piece = taken
                giver.fill -= len(piece.ids)
                window.add(piece)
            if window.fill == self.length:
                yield window
                i += 1
            if not giver.pieces:
                j -= 1
        self.n_open = int(i == j and left[i].fill > 0)
        if self.n_open:
            self.open[left[i].fill].append(left[i])
            self.counts[left[i].fill] = 1

    def finish(self) -> Iterator[Window]:
        """The rest: full windows by drain(), and the last one cut into windows of powers of two, largest first."""
        yield from self.drain()
        for window in [w for level in self.open for w in level]:
            pieces, fill = window.pieces[::-1], window.fill
            while fill:
                part = Window()
                size = 1 << (fill.bit_length() - 1)
                while part.fill < size:
                    piece = pieces.pop()
                    if len(piece.ids) > size - part.fill:
                        piece, rest = piece.cut(size - part.fill)
                        pieces.append(rest)
                    part.add(piece)
                fill -= size
                yield part


_PIECE = "doc_id bigint, start bigint, offset bigint, length bigint, doc_tokens bigint"
SEQUENCES = f"sequence_id bigint, ids array<int>, pieces array<struct<{_PIECE.replace(' bigint', ': bigint')}>>"


def _rows(windows: list[Window], first_id: int) -> pa.RecordBatch:
    ids = [p.ids for w in windows for p in w.pieces]
    pieces = [p for w in windows for p in w.pieces]
    lengths = np.array([len(p.ids) for p in pieces], np.int64)
    ends = np.cumsum([0, *(w.fill for w in windows)])
    of = np.repeat(ends[:-1], [len(w.pieces) for w in windows])
    columns = [
        pa.array([p.doc_id for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(np.cumsum(lengths) - lengths - of),
        pa.array(lengths), pa.array([p.doc_tokens for p in pieces], pa.int64()),
    ]
    structs = pa.StructArray.from_arrays(columns, ["doc_id", "start", "offset", "length", "doc_tokens"])
    starts = np.cumsum([0, *(len(w.pieces) for w in windows)], dtype=np.int32)
    arrays = [
        pa.array(np.arange(first_id, first_id + len(windows))), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(starts), structs),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "ids", "pieces"])


def pack(encoded: DataFrame, end_id: int, length: int = 2048, id_col: str = "doc_id", ids_col: str = "ids", most_open: int = 4096) -> DataFrame:
    """Sequences (sequence_id, ids, pieces) of the ids of all rows of encoded, each followed by end_id.

    pieces is an array of structs doc_id, start (ids of the document before the piece), offset (in the sequence),
    length and doc_tokens (of the document, with end_id). Every id lies in exactly one piece. A document of more than
    `length` ids is cut into whole sequences and a rest; rests are packed by the sum-of-squares rule in the task that
    reads them. Nothing is shuffled: each task has its own level array, and sequence ids start at its partition's
    number times 2^33. At the end, and where more than most_open windows are open (as with a thousand equal lengths
    over half a sequence), open windows are filled with ids cut from the emptiest of them; what is left of a task is
    cut into powers of two. So a sequence has `length` ids or a power of two, and none needs padding.

    Null ids (of a null text) count as none: the row is end_id alone. Repeated and null doc_ids are documents of their
    own. Rows of equal length are placed in the order in which they are read; give a table that is stored, or a plan
    that has the same order on each run, so that a task that runs again gives the same sequences.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, most_open)
        next_id = TaskContext.get().partitionId() << 33
        full: list[Window] = []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            if len(full) >= least:
                yield _rows(full, next_id)
                next_id += len(full)
                full.clear()

        for b in batches:
            for k in range(b.num_rows):
                cell = b.column(1)[k]
                own = cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.zeros(0, np.int32)
                ids = np.append(own, np.int32(end_id))
                doc_id, n = b.column(0)[k].as_py(), len(ids)
                for start in range(0, n, length):
                    full += packer.place(Piece(doc_id, start, ids[start : start + length], n))
                    yield from out(256)
        full += packer.finish()
        yield from out(1)

    return rows.transform(in_arrow, run, SEQUENCES)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32 (CRC-32 of its ids as little-endian unsigned numbers of
    32 bits), doc_tokens, sequence_id, offset."""
    rows = sequences.select("sequence_id", "ids", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            pieces = lists.flatten()
            ids = b.column(1).flatten().to_numpy().astype("<u4")
            base = np.cumsum([0, *b.column(1).value_lengths().to_pylist()])[:-1]
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            starts = pieces.field("offset").to_numpy() + base[of]
            ends = starts + pieces.field("length").to_numpy()
            crc = pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
            columns = [pieces.field("doc_id"), pieces.field("start"), pieces.field("length"), crc, pieces.field("doc_tokens"), b.column(0).take(pa.array(of)), pieces.field("offset")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.transform(in_arrow, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
