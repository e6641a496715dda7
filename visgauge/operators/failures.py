"""Failure flags, weighted severities, taxonomies and the rows of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.stats import present, ratio, weighted


def flagged(df: DataFrame, flags: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """df with flags, the names of those that hold, and severity, the sum of their weights."""
    return df.withColumns({"flags": present(flags), "severity": weighted([(w, flags[f]) for f, w in weights.items()])})


def worst(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of greatest severity; equal ones by key."""
    return df.where("severity > 0").orderBy(F.desc("severity"), key).limit(limit)


def flag_counts(df: DataFrame, by: str) -> DataFrame:
    """Rows with each flag, over all (null) and for each value of by."""
    each = df.select(by, F.explode("flags").alias("flag"))
    return each.groupingSets([[F.col("flag")], [F.col("flag"), F.col(by)]], "flag", by).agg(F.count(F.lit(1)).alias("n")).select("flag", by, "n")


def stage_shares(df: DataFrame, stages: list[str]) -> DataFrame:
    """stage, the sum of its column and its share of the sums of all."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in stages]).withColumn("_all", sum((F.col(c) for c in stages[1:]), F.col(stages[0])))
    return sums.unpivot(["_all"], stages, "stage", "n").select("stage", "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def taxonomy(rules: list[tuple[str, Column]], other: str = "other") -> Column:
    """The name of the first rule that holds."""
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(other)
