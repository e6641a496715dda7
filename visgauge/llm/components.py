"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import checkpoint, in_arrow, whole_groups


def _local_forest(batches: Iterator[pa.RecordBatch], links: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Replace each run of links by as many stars as it has components: fewer links, the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        roots = [(u, find(u)) for u in parent]
        parent.clear()
        pairs = [p for p in roots if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) >= links:
            yield stars()
    if parent:
        yield stars()


def _first_of_each(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the rows u, v, sorted by both, are not equal to the one before."""
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return first


def _large_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, v, sorted by both, of each node u and its neighbours: each larger neighbour goes to the least of them all
    and u, once. far: u has a smaller neighbour as well, so that these links weren't a star."""
    for t, starts in whole_groups(batches, ["u"]):
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        least = np.repeat(np.minimum(u[starts], v[starts]), np.diff(np.append(starts, len(u))))
        good = _first_of_each(u, v) & (v > u)
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (v, least, least < u)], ["u", "v", "far"])


def _small_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u > v, far, sorted by u and v, as _large_star gives them: u and its other smaller neighbours go to the least
    of these. far: one of the links was, or u had two smaller neighbours, each of which has given one row."""
    for t, starts in whole_groups(batches, ["u"]):
        u, v, far = (t.column(c).to_numpy() for c in ("u", "v", "far"))
        sizes = np.diff(np.append(starts, len(u)))
        far = np.logical_or.reduceat(far, starts) | (sizes > 1)
        least = np.repeat(v[starts], sizes)
        other = _first_of_each(u, v) & (v > least)
        columns = (np.append(u[starts], v[other]), np.append(v[starts], least[other]), np.append(far, np.zeros(int(other.sum()), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "far"])


def _in_few_tasks(e: DataFrame, tasks: int = 8) -> DataFrame:
    """The stars u, v of links u, v too few for a node of many links. Each round is one shuffle to each kind of star, of
    so many tasks: in as many as large inputs have, nearly all time and disk would go to empty ones."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("u").sortWithinPartitions("u", "v").coalesce(tasks)

    while True:
        e = e.select("u", "v").coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = dealt(both).transform(in_arrow, _large_star, "u bigint, v bigint, far boolean")
        e = checkpoint(dealt(large).transform(in_arrow, _small_star, "u bigint, v bigint, far boolean"))
        if not e.where("far").take(1):  # they were stars before this round, and it leaves stars as they are
            return e


def _with_least(rows: DataFrame, least: DataFrame, links: int, hot_links: int) -> DataFrame:
    """rows joined with the minimum m of their node u. Nodes of more than hot_links links are looked up by a broadcast: of
    `links` links, each with two ends, at most 2 * links / hot_links nodes are such, some 32 bytes each."""
    hot_links = max(hot_links, links // (1 << 19))  # so that the broadcast holds a million nodes at most
    if links <= hot_links:  # no node can have so many
        return rows.join(least.drop("c"), "u")
    hot = F.broadcast(least.where(F.col("c") > hot_links).drop("c"))
    cold = least.where(F.col("c") <= hot_links).drop("c")
    return rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(cold, "u"))


def connected_components(links: DataFrame, hot_links: int = 200_000) -> DataFrame:
    """links: two bigint columns. Return node, root for every node that has a link; root is the smallest node reachable.

    Links with a null end and links from a node to itself count for nothing; repeated links change nothing. No node
    gathers its neighbours in one task: minima are aggregated on the map side and joined back, those of nodes with more
    than hot_links links by a broadcast. Up to hot_links links in all no node can have more, and neighbours meet in
    sorted streams. Each round is checkpointed, so a lost executor costs a round at most.
    """
    u, v = links.columns[:2]
    e = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpoint(e.transform(in_arrow, _local_forest, "u bigint, v bigint").distinct())
    n = e.count()
    few = n <= hot_links
    if few:
        e = _in_few_tasks(e)
    while not few:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        e = _with_least(both.where("v > u"), least, n, hot_links).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = _with_least(e, least, 2 * n, hot_links)
        e = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = checkpoint(e)
        n = e.count()
        # stars: no node has two parents, and no parent has a parent
        if n == e.select("u").distinct().count() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
