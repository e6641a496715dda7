"""Exact candidates for Jaccard similarity: prefix filtering on rare shingles, hot lists cut into blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, close_pairs, in_arrow, slices, whole_groups

#: So many common shingles of two prefixes are asked for, where the texts have as many.
COMMON = 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the shingles of a text; a text of fewer words is one shingle."""
    w = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(words, len(h))
    out = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def _needed(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """The least number of shingles that a set of n shares with any set that reaches the similarity."""
    return np.maximum(np.ceil(similarity * np.asarray(n) - 1e-9), 1).astype(np.int64)


def _common(n: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """The least number of shingles that two sets of the similarity have in common within their prefixes: as many as both
    must share, less what lies behind the prefix that ends first."""
    behind = [needed - np.minimum(COMMON, needed) for needed in (_needed(n, similarity), _needed(other, similarity))]
    both = np.ceil(similarity / (1 + similarity) * (n.astype(np.int64) + other) - 1e-6).astype(np.int64)
    return np.maximum(both - np.maximum(*behind), 1)


def _frequent(texts: DataFrame, words: int, one_of: int = 16, least: int = 4, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their numbers of texts, estimated on one of so many texts.

    They only set an order and the number of blocks of a list: whatever they are, the candidates are complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = np.concatenate([_distinct_shingles(x.as_py(), words) for x in b.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = texts.where(F.pmod(F.xxhash64("row"), F.lit(one_of)) == 0).select("text").transform(in_arrow, run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).collect()
    keys = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] * one_of for r in rows], np.int64)[order]


def _prefixes(words: int, similarity: float, keys: np.ndarray, counts: np.ndarray, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text its number of shingles and the lists that it is in, with its side there: 0 and 1 meet each other, 2
    meets all of its block, 3 all of a list that isn't cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, lists, sides, ends = [], [], [], [0]
            for row, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = _distinct_shingles(x.as_py(), words)
                seen = np.zeros(len(h), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    seen = np.where(keys[at] == h, counts[at], 0)
                order = np.lexsort((h, seen))
                needed = int(_needed(len(h), similarity))
                order = order[: len(h) - needed + min(COMMON, needed)]
                hot = seen[order] > block_rows
                own, side = [h[order][~hot]], [np.full(int((~hot).sum()), 3, np.int8)]
                for value, n in zip(h[order][hot], seen[order][hot].tolist(), strict=True):
                    k = -(-n // block_rows)
                    blk = int(_mix(np.array([row], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] % np.uint64(k))
                    other = np.arange(k)
                    pair = (np.minimum(other, blk) * k + np.maximum(other, blk) + 1).astype(np.uint64)
                    own.append(_mix(value ^ (pair * np.uint64(0xC4CEB9FE1A85EC53))))
                    side.append(np.where(other == blk, 2, other < blk).astype(np.int8))
                sizes.append(len(h))
                lists += own
                sides += side
                ends.append(ends[-1] + sum(map(len, own)))
            cells = pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.concatenate(sides))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), *[pa.ListArray.from_arrays(at, c) for c in cells]], ["row", "n", "cells", "sides"])

    return run


def _share_lists(similarity: float, at_once: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of each list that are of different groups and near enough in size, with the common shingles they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            u, v, n = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(n.astype(np.int32))], ["u", "v", "needed"])

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for t, starts in whole_groups(batches, ["cell"]):
            sizes = np.diff(np.append(starts, t.num_rows))
            t = t.filter(pa.array(np.repeat(sizes > 1, sizes)))
            sizes = sizes[sizes > 1]
            if not len(sizes):
                continue
            row, n, free, side, root = (t.column(c).to_numpy() for c in ("row", "n", "free", "side", "root"))
            for a, b in close_pairs(np.cumsum(sizes) - sizes, len(row)):
                good = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] >= 2))
                good &= (1 + similarity) * np.minimum(free[a], free[b]) >= similarity * (n[a].astype(np.int64) + n[b]) - 1e-6
                a, b = a[good], b[good]
                low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                good = low >= _needed(high, similarity)
                if good.any():
                    found.append((row[a[good]], row[b[good]], _common(low[good], high[good], similarity)))
                    held += int(good.sum())
                    if held >= at_once:
                        yield out()
                        held = 0
        if found:
            yield out()

    return run


def sharing_pairs(texts: DataFrame, roots: DataFrame, words: int, similarity: float, block_rows: int = 1024) -> DataFrame:
    """Pairs u < v of rows that hold every pair of the similarity whose rows have different roots.

    texts: row bigint and text; roots: node, root of the rows that were linked before, all others being their own root.
    In one order of all shingles, frequent ones last, two sets of the similarity share their first few common shingles
    within the prefixes of both, so rows meet in the lists of these. Pairs with too few common shingles in the prefixes
    for their two sizes can't reach the similarity, nor can those of too different sizes. A shingle that is alone in its list is in no other
    text, so a text has at most its others in common with any: texts too many of whose shingles are alone go before the
    lists are shuffled to form pairs, and pairs with too few others left aren't formed. Lists of more than block_rows rows, as estimated,
    are cut into blocks that meet in pairs.
    """
    keys, counts = _frequent(texts, words)
    rows = texts.select("row", "text").transform(in_arrow, _prefixes(words, similarity, keys, counts, block_rows), "row bigint, n int, cells array<bigint>, sides array<tinyint>")
    whole = rows.select("row", "n", F.explode(F.arrays_zip("cells", "sides")).alias("at")).where("at.sides = 3").select(F.col("at.cells").alias("cell"), "row", "n")
    single = whole.groupBy("cell").agg(F.count(F.lit(1)).alias("_in"), F.min(F.struct("row", "n")).alias("_of")).where("_in = 1")
    alone = checkpoint(single.groupBy("_of.row", "_of.n").agg(F.count(F.lit(1)).cast("int").alias("alone")).where((1 + similarity) * F.col("alone") > (1 - similarity) * F.col("n")).select("row", "alone"))
    linked = roots.where("node <> root").select(F.col("node").alias("row"), "root")
    free = F.col("n") - F.coalesce("alone", F.lit(0))
    rows = rows.join(broadcast_up_to(alone, F.lit(32)), "row", "left").withColumn("free", free).where(F.col("free") >= similarity * F.col("n") - 1e-6)
    rows = rows.join(broadcast_up_to(linked, F.lit(32)), "row", "left").select("row", "n", "free", F.coalesce("root", "row").alias("root"), F.explode(F.arrays_zip("cells", "sides")).alias("at"))
    lists = rows.select(F.col("at.cells").alias("cell"), F.col("at.sides").alias("side"), "row", "n", "free", "root").repartition("cell").sortWithinPartitions("cell")
    shared = lists.transform(in_arrow, _share_lists(similarity), "u bigint, v bigint, needed int").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return shared.where("n >= needed").select("u", "v")
