"""Repeated questions, equal and nearly equal records, and what becomes of them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_groups(df: DataFrame, key: Column, order: Column, source: str, label: str) -> DataFrame:
    """One row per key: first order, rows, sorted sources, and whether its labels agree. One run answers all of them."""
    return df.groupBy(key.alias("key")).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(source)).alias("sources"), (F.count_distinct(label) <= 1).alias("consistent")
    )


def cached_cost(df: DataFrame, key: Column, order: Column, cost: Column) -> DataFrame:
    """One row: rows, keys, the cost of all rows, and the cost if only the first row of each key has to be paid."""
    each = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("all"), F.min_by(cost, order).alias("one"))
    return each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.round(F.sum("all"), 6).alias("uncached"), F.round(F.sum("one"), 6).alias("cached"))


def exact_groups(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Digests that several rows share: the smallest key, which stays, and the number of rows."""
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")


def near_pairs(df: DataFrame, key: str, signature: str, within: int, equal: int = 2) -> DataFrame:
    """left, right and distance of the pairs of 64-bit signatures that differ in at most `within` bits.

    The signatures are cut into within + equal parts, of which two such signatures have at least `equal` in common, so
    they meet in the cell of these parts; pairs that share several cells count in the first one. Candidates are joined by
    equal cells, never all with all. Two equal parts of 10 bits make some million cells; more make smaller cells and
    more rows for each signature. Equal signatures are one row of the join, and their pairs are made of its result.
    """
    n = within + equal
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    cells = list(combinations(range(n), equal))

    def mask(parts: tuple[int, ...]) -> int:
        bits = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in parts)
        return bits - (1 << 64) if bits >> 63 else bits

    keyed = df.select(F.col(key).alias("id"), F.col(signature).alias("s"))
    distinct = keyed.select("s").where("s is not null").distinct()
    rows = distinct.select("s", F.posexplode(F.array(*[F.col("s").bitwiseAND(F.lit(mask(c))) for c in cells])).alias("cell", "bits"))
    a, b = rows.alias("a"), rows.alias("b")
    xor = F.col("a.s").bitwiseXOR(F.col("b.s"))
    first = F.lit(len(cells))
    for k in reversed(range(len(cells))):
        first = F.when(xor.bitwiseAND(F.lit(mask(cells[k]))) == 0, k).otherwise(first)
    near = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.s") < F.col("b.s")))
    near = near.where((F.bit_count(xor) <= within) & (F.col("a.cell") == first)).select(F.col("a.s").alias("s"), F.col("b.s").alias("t"), F.bit_count(xor).alias("distance"))
    near = near.unionByName(distinct.select("s", F.col("s").alias("t"), F.lit(0).alias("distance")))
    pairs = near.join(keyed, "s").join(keyed.select(F.col("id").alias("other"), F.col("s").alias("t")), "t").where((F.col("s") != F.col("t")) | (F.col("id") < F.col("other")))
    return pairs.select(F.least("id", "other").alias("left"), F.greatest("id", "other").alias("right"), "distance")


def duplicate_status(df: DataFrame, key: str, digest: str, reference: DataFrame, reference_digest: str, near: DataFrame, invalid: Column) -> DataFrame:
    """key and status of each row: exact copies of references, then invalid rows, copies of a row with a smaller key,
    near-duplicates of another row, and accepted ones; the first that applies counts."""
    known = reference.select(F.col(reference_digest).alias(digest)).distinct().withColumn("_known", F.lit(True))
    first = df.where(~invalid).groupBy(digest).agg(F.min(key).alias("_first"))
    close = near.select(F.explode(F.array("left", "right")).alias(key)).distinct().withColumn("_near", F.lit(True))
    all_ = df.withColumn("_bad", invalid).join(known, digest, "left").join(first, digest, "left").join(close, key, "left")
    status = (
        F.when(F.col("_known"), "exact_reference").when(F.col("_bad"), "invalid").when(F.col(key) != F.col("_first"), "exact_copy").when(F.col("_near"), "near_duplicate").otherwise("accepted")
    )
    return all_.select(key, status.alias("status"))
