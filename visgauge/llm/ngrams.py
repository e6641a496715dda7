"""Hashed counts of byte n-grams over whole texts, and their document frequencies over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, in_arrow

#: Odd multipliers of a multiplicative hash, one for each n-gram length.
MULTIPLIERS = {1: 0x9E3779B1, 2: 0x85EBCA77, 3: 0xC2B2AE3D, 4: 0x27D4EB2F}


def hashed_counts(texts: Sequence[bytes], dims: int, orders: Sequence[int], piece: int = 1 << 18) -> np.ndarray:
    """A row for each text and a column for each of dims (a power of two) hash values: how often its n-grams occur."""
    out = np.zeros((len(texts), dims), np.float32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or (size + len(texts[last]) <= piece and last - first < 32)):
            size += len(texts[last])
            last += 1
        lengths = np.fromiter((len(t) for t in texts[first:last]), np.int64, last - first)
        raw = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        ends = np.cumsum(lengths)
        whole = out[first:last].reshape(-1)
        for begin in range(0, len(raw), piece):  # one long text is counted piece by piece, with its neighbours' edges
            part = raw[begin : begin + piece + max(orders) - 1].astype(np.uint32)
            at = np.arange(begin, min(begin + piece, len(raw)))
            owner = np.searchsorted(ends, at, "right")
            gram = np.zeros(len(part), np.uint32)
            for n in range(1, max(orders) + 1):
                gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
                if n in orders:
                    m = min(len(gram), len(at))
                    inside = at[:m] + n <= ends[owner[:m]]
                    slot = (gram[:m] * np.uint32(MULTIPLIERS[n])) >> shift
                    whole += np.bincount((owner[:m] * dims + slot)[inside], minlength=len(whole)).astype(np.float32)
        first = last
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int = 64) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of few rows, with the texts of a column as bytes (null: empty)."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            s = b.slice(i, rows)
            yield s, [(x or "").encode() for x in s.column(column).to_pylist()]


def document_frequencies(docs: DataFrame, text_col: str, dims: int, orders: Sequence[int], prepare: Callable[[bytes], bytes]) -> tuple[int, np.ndarray]:
    """The number of rows, and for each hash value the number of rows with one of its n-grams, over all rows of docs.

    Each task sends one row for each hash value: dims rows reach the driver, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for s, texts in blocks(batches, 0):
            total[:dims] += np.count_nonzero(hashed_counts([prepare(t) for t in texts], dims, orders), axis=0)
            total[dims] += s.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(total)], ["slot", "n"])

    rows = docs.select(F.col(text_col).cast("string")).transform(in_arrow, count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(dims + 1, np.int64)
    for r in rows:
        found[r["slot"]] = r["n"]
    return int(found[dims]), found[:dims]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (zero for texts without n-grams): log term frequency times idf."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def bounded_sample(rows: DataFrame, label_col: str, id_col: str, per_label: int) -> DataFrame:
    """About per_label ids of each label at most, chosen by a hash of the id: the same in every run. Of the rows of one
    id with one label, that of the least text counts, so that a repeated id is one row of the sample."""
    rest = [c for c in rows.columns if c not in (label_col, id_col)]
    share = rows.groupBy(label_col).agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias("_share")).withColumnRenamed(label_col, "_label")
    picked = rows.join(broadcast_up_to(checkpoint(share), F.lit(64)), F.col(label_col) == F.col("_label"))
    picked = picked.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < F.col("_share") * F.lit(float(1 << 30)))
    return picked.groupBy(label_col, id_col).agg(*[F.min(c).alias(c) for c in rest]) if rest else picked.select(label_col, id_col).distinct()


def collect_features(sample: DataFrame, features: Callable[[list[bytes]], np.ndarray], width: int) -> tuple[list[str], np.ndarray]:
    """Labels and feature rows, in the order of label and id, of a bounded sample with columns label, id and text.

    The texts stay on the executors; the driver gets the features that are not zero.
    """

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, texts in blocks(batches, 2):
            x = features(texts)
            slots = [np.flatnonzero(row).astype(np.int32) for row in x]
            values = [row[i] for row, i in zip(x, slots, strict=True)]
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "id", "slot", "x"])

    rows = sample.select(F.col("label").cast("string"), F.col("id").cast("string"), "text").transform(in_arrow, sparse, "label string, id string, slot array<int>, x array<float>")
    found = rows.toPandas().sort_values(["label", "id"])
    out = np.zeros((len(found), width), np.float32)
    for i, (slot, x) in enumerate(zip(found["slot"], found["x"], strict=True)):
        out[i, slot] = x
    return found["label"].tolist(), out
