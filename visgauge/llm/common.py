"""What the corpus operators share: tables, checkpoints, hot groups cut into blocks, streams of whole groups."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors see: the one that the cluster names in
    spark.checkpoint.dir. Only on one machine (master local or local[...]), as in tests, a temporary folder is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("name a folder that the driver and all executors see in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, batch_bytes: int = 4 << 20) -> DataFrame:
    """df.mapInArrow, with batches of at most about batch_bytes, as rows with long texts or lists would fill the default
    of 64 MB in the executor and again in its Python workers. A limit that the session names stays as it is: larger
    batches are then cut where they arrive. Only where it names none is spark.sql.execution.arrow.maxBytesPerBatch set."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(limit, None) is None:
        conf.set(limit, str(batch_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, b.num_rows * batch_bytes // max(1, b.nbytes))
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
        pa.default_memory_pool().release_unused()  # workers live on, and the next stage's may not need what is held

    return df.mapInArrow(lambda batches: function(cut(batches)), schema)


def broadcast_up_to(df: DataFrame, row_bytes: Column, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, by row_bytes, sum up to limit bytes at most; as it is otherwise."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def in_blocks(cells: DataFrame, keys: list[str], member: Column, block_rows: int, drop_single: bool = False) -> DataFrame:
    """Add blk, bi and bj so that all pairs of rows of a cell meet in a group (keys, bi, bj) of about 2 * block_rows rows.

    Cells of up to block_rows rows stay whole (0, 0). Larger ones are cut into blocks by a hash of member, and every
    two blocks meet in a group of their own: a hot cell is spread over many tasks, and no pair is lost. Rows of the same
    block blk meet in each group of that block; (0, max(blk, 1)) is one of them. The counts are aggregated on the map
    side before they are shuffled; those of hot cells go on alone and are broadcast up to a checked size. With
    drop_single cells of one row, which have no pair, are left out as well: hot cells have gone to their blocks by then,
    so that no key of that join has more than block_rows rows.
    """
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = broadcast_up_to(checkpoint(sizes.where(F.col("_n") > block_rows)), F.lit(8 * len(keys) + 16))
    if drop_single:
        few = cells.join(hot, keys, "left_anti").join(sizes.where(F.col("_n").between(2, block_rows)), keys).select(*cells.columns, "_n")
        out = few.unionByName(cells.join(hot, keys).select(*cells.columns, "_n"))
    else:
        out = cells.join(hot, keys, "left").select(*cells.columns, "_n")
    out = out.withColumn("_k", F.coalesce(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1)).cast("int")).withColumn("blk", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    partners = F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: j != F.col("blk")))
    out = out.withColumn("_j", F.explode(partners))
    return out.withColumns({"bi": F.least("blk", "_j"), "bj": F.greatest("blk", "_j")}).drop("_n", "_k", "_j")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what is made of the texts of a part stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 16384) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys, yield tables of whole groups with the row at which each group starts."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            s = starts(t)
            if len(s) > 1:
                yield t.slice(0, s[-1]), s[:-1]
                t = t.slice(s[-1])
            held, n = t.to_batches(), t.num_rows if len(s) > 1 else 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def close_pairs(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, for all groups at once, one distance between rows after the other."""
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    left = np.arange(n)
    shift = 1
    while True:
        left = left[left + shift < n]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            return
        yield left, left + shift
        shift += 1


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b between n rows, as many as join the same components: each row and the first row of its component."""
    first = np.arange(n)
    while True:
        least = np.minimum(first[a], first[b])
        found = first.copy()
        np.minimum.at(found, a, least)
        np.minimum.at(found, b, least)
        found = found[found]
        if np.array_equal(found, first):
            rows = np.flatnonzero(first != np.arange(n))
            return rows, first[rows]
        first = found
