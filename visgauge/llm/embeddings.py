"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, close_pairs, in_arrow, in_blocks, stars, whole_groups
from visgauge.llm.components import connected_components


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists all have the same length and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sign_buckets(tables: int, bits: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each vector, one bucket a table: the sides of `bits` random hyperplanes on which it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            out = np.zeros((b.num_rows, tables), np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                signs = (_matrix(b.column(2).take(pa.array(at))) @ planes[d] > 0).reshape(len(at), tables, bits)
                out[at] = signs @ (1 << np.arange(bits))
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), buckets], ["cid", "buckets"])

    return run


def _verify(threshold: float, small: int = 16, at_once: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact cosines within each group; a pair counts in the first table only in which it shares a bucket.

    Yields, for each vector of a group, how many rows it links to by pairs that count there (v is null), and as many
    links as join the group's components (n is 0): rows in proportion to the group, not to its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["tbl", "label", "dim", "bucket", "bi", "bj"], rows=4096):
            n = t.num_rows
            tbl, bi, bj, blk, dim, cid, m = (t.column(c).to_numpy() for c in ("tbl", "bi", "bj", "blk", "dim", "cid", "m"))
            buckets = t.column("buckets").combine_chunks().flatten().to_numpy().reshape(n, -1)
            values = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(dim) - dim
            ends = np.append(starts[1:], n)
            partners = np.zeros(n, np.int64)
            joined: list[tuple[np.ndarray, np.ndarray]] = []

            def unit(rows: np.ndarray) -> np.ndarray:
                x = values[begin[rows][:, None] + np.arange(dim[rows[0]])]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

            def found(a: np.ndarray, b: np.ndarray) -> None:
                first = (bi[a] == bj[a]) | (blk[a] != blk[b]) | ((bi[a] == 0) & (bj[a] == np.maximum(blk[a], 1)))
                a, b = a[first], b[first]
                earlier = np.arange(buckets.shape[1]) < tbl[a][:, None]
                new = ~((buckets[a] == buckets[b]) & earlier).any(axis=1)
                a, b = a[new], b[new]
                np.add.at(partners, a, m[b])
                np.add.at(partners, b, m[a])
                joined.append((a, b))

            few = ends - starts <= small
            for i, j in zip(starts[~few], ends[~few], strict=True):
                x = unit(np.arange(i, j))
                before = len(joined)
                for k in range(0, j - i, at_once):
                    a, b = np.nonzero(x[k : k + at_once] @ x[k:].T >= threshold)
                    found((a + k + i)[b > a], (b + k + i)[b > a])
                    if len(joined) - before > 8:
                        joined[before:] = [stars(*(np.concatenate(x) for x in zip(*joined[before:], strict=True)), n)]
                if len(joined) > before:
                    joined[before:] = [stars(*(np.concatenate(x) for x in zip(*joined[before:], strict=True)), n)]
            kept = np.flatnonzero(np.repeat(few, ends - starts))
            sizes = (ends - starts)[few]
            if len(kept):
                for a, b in close_pairs(np.cumsum(sizes) - sizes, len(kept)):
                    a, b = kept[a], kept[b]
                    for d in np.unique(dim[a]):
                        p, q = a[dim[a] == d], b[dim[a] == d]
                        near = np.einsum("ij,ij->i", unit(p), unit(q)) >= threshold
                        found(p[near], q[near])
            counted = np.flatnonzero(partners)
            if len(counted):
                u, v = stars(*(np.concatenate(x) for x in zip(*joined, strict=True)), n)
                none = pa.nulls(len(counted), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cid[counted]), none, pa.array(partners[counted])], ["u", "v", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(cid[u]), pa.array(cid[v]), pa.array(np.zeros(len(u), np.int64))], ["u", "v", "n"])

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.98, tables: int = 24, bits: int = 14, seed: int = 7, block_rows: int = 1024) -> DataFrame:
    """u, v, n: for distinct vectors (cid bigint, m copies, label, embedding) of one label, rows whose n sum up to the
    copies that u links to (v is null), and links u, v that join the components (n is 0).

    At a cosine of 0.98 a hyperplane separates two vectors with probability 0.064, so they share one of 24 buckets of
    14 signs with probability 0.999994; more bits make smaller buckets for larger inputs, more tables win back recall.
    """
    v = vectors.select("cid", "m", F.size("embedding").alias("dim"), "label", "embedding")
    hashed = v.select("cid", "dim", "embedding").transform(in_arrow, _sign_buckets(tables, bits, seed), "cid bigint, buckets array<int>")
    hashed = checkpoint(hashed.join(v.select("cid", "m", "dim", "label"), "cid"))
    cells = hashed.select("cid", "label", "dim", F.posexplode("buckets").alias("tbl", "bucket"))
    blocks = in_blocks(cells, ["tbl", "label", "dim", "bucket"], F.col("cid"), block_rows, drop_single=True)
    full = blocks.join(hashed.select("cid", "m", "buckets").join(v.select("cid", "embedding"), "cid"), "cid")
    keys = ["tbl", "label", "dim", "bucket", "bi", "bj"]
    rows = full.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "blk", "cid", "m", "buckets", "embedding")
    return rows.transform(in_arrow, _verify(threshold), "u bigint, v bigint, n bigint")


def embedding_near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, tables: int = 24, bits: int = 14, seed: int = 7, hot_copies: int = 10_000,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Rows link when their labels are equal and not null and the cosine, in double precision, is at least threshold.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
    label or id: they have n_links 0 and are their own component (null id: null, not kept). Equal vectors form one
    class before any pair is made, so copies never meet in pairs; repeated rows count as rows. Pairs of different vectors
    are counted where they are found and only a spanning forest of them goes on. Ids are taken to be unique: rows that
    share an id are one vector of the graph. Labels may be of any type that has a text.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("_label"))
    usable = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0.0), F.lit(False)
    )
    # a label of any type stands for itself by its hash; -0.0 and 0.0 are one value, as they are for cosines
    rows = rows.select("id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"), F.xxhash64("_label").alias("label"), (usable & F.col("id").isNotNull() & F.col("_label").isNotNull()).alias("ok"))
    classes = checkpoint(rows.where("ok").groupBy("label", "embedding").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("m")))
    links = checkpoint(embedding_links(classes, threshold, tables, bits, seed))
    partners = links.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("others"))
    roots = connected_components(links.where("v is not null").select("u", "v")).select(F.col("node").alias("cid"), "root")
    named = classes.join(partners, "cid", "left").join(roots, "cid", "left").select(
        "label", "embedding", "m", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id")
    )
    named = checkpoint(named)
    # a vector with very many copies is looked up by a broadcast, of a checked size, so that no key of the join is large
    often = broadcast_up_to(named.where(F.col("m") > hot_copies), F.size("embedding") * 8 + 64)
    good = rows.where("ok").select("id", "label", "embedding")
    keys = ["label", "embedding"]
    linked = good.join(often, keys).unionByName(good.join(often.select(keys), keys, "left_anti").join(named, keys)).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
