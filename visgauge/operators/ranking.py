"""Choices within groups: top k, strongest, first, round robin, orders by hash, last wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.hashing import salted_order


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in an order, which must leave no ties, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def strongest(df: DataFrame, group: list[str], value: Column, by: list[Column], name: str = "strongest") -> DataFrame:
    """The value with the greatest `by`, compared from left to right, of each group; aggregated on the map side."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])).alias(name))


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Rows for a report: the first of each group, groups with most rows first, then the second of each, up to limit."""
    sized = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))
    # no more than limit rows of a group, and no more than limit groups' first rows, can be taken
    deep = top_k(df, [group], order, limit, "depth").join(sized, group)
    return deep.orderBy("depth", F.desc("group_rows"), group).limit(limit)


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same key, the last in an order that leaves no ties; the others are superseded."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("_last"))
    return last.select(*key, "_last.*")


def stable_sample(df: DataFrame, key: str, salt: str, k: int, group: list[str] | None = None) -> DataFrame:
    """k rows, of each group if there are groups, that come first in a salted order of their keys."""
    ranked = df.withColumn("_order", salted_order(F.col(key), salt))
    if not group:
        return ranked.orderBy("_order", key).limit(k).drop("_order")
    return top_k(ranked, group, [F.col("_order"), F.col(key)], k, "_rank").drop("_order", "_rank")


def constrained_best(df: DataFrame, floor: Column, order: list[Column]) -> DataFrame:
    """The first row in an order among those that meet a floor; an error if none does."""
    best = df.where(floor).orderBy(*order).limit(1)
    met = df.agg(F.count_if(floor).alias("_met"))
    met = met.where(F.when(F.col("_met") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no row meets the floor"))))
    return met.join(best, how="left").drop("_met")
