"""Shapes of the same keys matched inside tasks: streams of whole groups, all pairs of a block of groups at once.

Spark brings the true and the found shapes of equal keys together, once and in order; a task then holds one block of
groups (or one large group), its pairs a million at a time, and of these only the pairs that overlap enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a block of groups, and pairs that are compared at once.
BLOCK_ROWS, BLOCK_BYTES, PAIRS = 100_000, 32 << 20, 1_000_000

#: Overlaps of the found rows f with the true rows t of a block, two arrays of the same length.
Overlaps = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """A kind of shape: the columns of it that tasks get, and the overlaps of a block's rows from these columns and crowd."""

    columns: Callable[[Column], list[Column]]
    overlaps: Callable[[list[pa.Array], np.ndarray], Overlaps]


def _box_overlaps(columns: list[pa.Array], crowd: np.ndarray) -> Overlaps:
    x1, y1, x2, y2 = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in columns)  # null: NaN
    own = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)

    def of(f: np.ndarray, t: np.ndarray) -> np.ndarray:
        common = np.maximum(np.minimum(x2[f], x2[t]) - np.maximum(x1[f], x1[t]), 0) * np.maximum(np.minimum(y2[f], y2[t]) - np.maximum(y1[f], y1[t]), 0)
        return _share(common, np.where(crowd[t], own[f], own[f] + own[t] - common))

    return of


def _mask_overlaps(columns: list[pa.Array], crowd: np.ndarray) -> Overlaps:
    lists = columns[0]
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten()
    first = np.cumsum(n) - n
    if flat.null_count:  # a mask with a null edge is none
        n = np.where(np.bincount(np.repeat(np.arange(len(n)), n), flat.is_null().to_numpy(zero_copy_only=False), len(n)) > 0, 0, n)
        flat = pc.fill_null(flat, 0)
    n -= n % 2  # a last edge without a partner starts nothing
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    edge = flat.to_numpy(zero_copy_only=False).astype(np.int64)[np.repeat(first, n) + inner]
    first = np.cumsum(n) - n
    opens = inner % 2 == 0
    # the pixels of a mask below each of its edges
    runs = np.where(opens, 0, edge - np.roll(edge, 1))
    sums = np.cumsum(runs)
    below = sums - np.repeat(np.concatenate(([0], sums))[first], n)
    own = np.bincount(owner, runs, len(n)).astype(np.int64) if len(owner) else np.zeros(len(n), np.int64)
    values, place = np.unique(edge, return_inverse=True)
    key = owner * np.int64(len(values) + 1) + place

    def of(f: np.ndarray, t: np.ndarray) -> np.ndarray:
        pair = np.repeat(np.arange(len(f)), n[f])
        e = np.arange(len(pair)) - np.repeat(np.cumsum(n[f]) - n[f], n[f]) + np.repeat(first[f], n[f])
        of_t = t[pair]
        at = np.searchsorted(key, of_t * np.int64(len(values) + 1) + place[e], "right") - 1  # the truth's last edge up to here
        there = at >= first[of_t]
        at = np.where(there, at, 0)
        covered = np.where(there, below[at] + np.where(opens[at], edge[e] - edge[at], 0), 0)
        common = np.bincount(pair, np.where(opens[e], -covered, covered), len(f)) if len(pair) else np.zeros(len(f))
        return _share(common, np.where(crowd[t], own[f], own[f] + own[t] - common))

    return of


def _share(common: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(common, whole, out=np.zeros(len(common)), where=whole > 0)


BOX = Shape(lambda s: [s[i].cast("double") for i in range(4)], _box_overlaps)
MASK = Shape(lambda s: [s.cast("array<bigint>")], _mask_overlaps)


def together(truth: DataFrame, found: DataFrame, keys: list[str], shape: Shape, order: Column, more: list[str]) -> DataFrame:
    """Both sides of equal keys in one stream: the true shapes by idx, then the found ones by order, then by idx."""
    kinds = dict(found.dtypes)

    def side(df: DataFrame, is_found: bool) -> DataFrame:
        crowd = F.lit(False) if is_found else F.coalesce("crowd", F.lit(False))
        score = F.col("score") if is_found else F.lit(None).cast(kinds["score"]).alias("score")
        return df.select(*keys, F.lit(is_found).alias("_found"), "idx", score, crowd.alias("_crowd"), *[F.col(c).cast("double").alias(f"_{c}") for c in more], *[c.alias(f"_s{i}") for i, c in enumerate(shape.columns(F.col("shape")))])

    return side(truth, False).unionByName(side(found, True)).repartition(*keys).sortWithinPartitions(*keys, "_found", order, "idx")


class Block:
    """Whole groups of a stream of together()."""

    def __init__(self, table: pa.Table, starts: np.ndarray, shape: Shape) -> None:
        column = lambda c: table.column(c).chunk(0)
        self.table, self.starts, rows = table, starts, table.num_rows
        self.found = column("_found").to_numpy(zero_copy_only=False)
        self.crowd = column("_crowd").to_numpy(zero_copy_only=False)
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
        self.truths = np.bincount(self.group[~self.found], minlength=len(starts))
        self.predicted = np.bincount(self.group[self.found], minlength=len(starts))
        #: the place of a found row, from 0, among those of its group
        self.rank = np.arange(rows) - (starts + self.truths)[self.group]
        self._overlaps = shape.overlaps([column(c) for c in table.column_names if c.startswith("_s")], self.crowd)

    def numbers(self, name: str) -> np.ndarray:
        return np.asarray(self.table.column(name).chunk(0).to_numpy(zero_copy_only=False), np.float64)

    def near(self, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """f, t, iou of the pairs of found rows with true ones of their groups that overlap by least (and above 0)."""
        count, start = self.truths[self.group[rows]], self.starts[self.group[rows]]
        ends = np.cumsum(count)
        none = np.zeros(0, np.int64)
        kept, at = [(none, none, np.zeros(0))], 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:to]
            f = np.repeat(rows[at:to], n)
            t = np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
            iou = self._overlaps(f, t)
            good = (iou >= least) & (iou > 0)
            kept.append((f[good], t[good], iou[good]))
            at = to
        f, t, iou = (np.concatenate(c) for c in zip(*kept, strict=True))
        return f, t, iou

    def rounds(self, f: np.ndarray) -> Iterator[slice]:
        """The slices of f, sorted by rank, that hold one rank each: no two found rows of a slice are of one group."""
        cuts = np.flatnonzero(np.diff(self.rank[f], prepend=-1, append=-1)) if len(f) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield slice(a, b)

    def hits(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """f, t, iou of the pairs that greedy matching takes: each found row in order the free true one that it overlaps
        most, the first of several."""
        f, t, iou = self.near(np.flatnonzero(self.found), least)
        order = np.lexsort((t, -iou, f, self.rank[f]))
        f, t, iou = f[order], t[order], iou[order]
        used, taken = np.zeros(self.table.num_rows, bool), [np.zeros(0, np.int64)]
        for s in self.rounds(f):
            free = np.arange(s.start, s.stop)[~used[t[s]]]
            best = free[np.diff(f[free], prepend=-1) != 0]
            used[t[best]] = True
            taken.append(best)
        rows = np.concatenate(taken)
        return f[rows], t[rows], iou[rows]


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], shape: Shape) -> Iterator[Block]:
    """The groups of a stream of together(), in blocks. Null keys are equal to none, so that their two sides are apart."""

    def starts(table: pa.Table) -> np.ndarray:
        new, null = np.ones(table.num_rows, bool), np.zeros(table.num_rows, bool)
        new[1:] = False
        for k in keys:
            codes = table.column(k).chunk(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
            null |= table.column(k).is_null().to_numpy()
        found = table.column("_found").to_numpy()
        new[1:] |= null[1:] & (found[1:] != found[:-1])
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    rows = size = 0
    enough, big = BLOCK_ROWS, BLOCK_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= enough or size >= big:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield Block(table.slice(0, at[-1]).combine_chunks(), at[:-1], shape)
            rest = table.slice(at[-1]).combine_chunks()  # may go on in the next batch
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
            enough, big = max(BLOCK_ROWS, 2 * rows), max(BLOCK_BYTES, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield Block(table, starts(table), shape)
