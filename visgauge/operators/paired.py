"""Two runs over the same questions: outcomes side by side, exact tests, transitions, audits of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.stats import mcnemar, ratio


def paired_outcomes(df: DataFrame, first: Column, second: Column, by: list[str] | None = None) -> DataFrame:
    """both, first_only, second_only, neither, their sum n, the net gain, both accuracies and McNemar's exact p-value."""
    rows = df.withColumns({"_a": first, "_b": second})
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if(F.expr("_a and _b")).alias("both"), F.count_if(F.expr("_a and not _b")).alias("first_only"), F.count_if(F.expr("not _a and _b")).alias("second_only"),
        F.count_if(F.expr("not _a and not _b")).alias("neither"),
    )
    both, one, two, none = (F.col(c) for c in ("both", "first_only", "second_only", "neither"))
    n = both + one + two + none
    return counts.withColumns({
        "n": n, "net": two - one, "first_accuracy": ratio(both + one, n), "second_accuracy": ratio(both + two, n), "p_value": mcnemar(one, two),
    })


def transition(before: Column, after: Column) -> Column:
    return F.when(before & after, "kept_correct").when(before, "broken").when(after, "fixed").otherwise("kept_wrong")


def join_runs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both runs as structs a and b, by key; a key that one of them lacks or repeats is an error."""
    a, b = (df.groupBy(key).agg(F.first(F.struct("*")).alias(n), F.count(F.lit(1)).alias(f"_{n}")) for df, n in ((first, "a"), (second, "b")))
    both = a.join(b, key, "full")
    good = F.coalesce((F.col("_a") == 1) & (F.col("_b") == 1), F.lit(False))
    return both.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a run lacks or repeats the key "), F.col(key).cast("string"))))).select(key, "a", "b")


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """One row: expected and observed keys, those in both, missing and extra ones, and the share of expected keys seen."""
    e = expected.select(F.col(key).alias("k")).distinct().withColumn("e", F.lit(1))
    o = observed.select(F.col(key).alias("k")).distinct().withColumn("o", F.lit(1))
    counts = e.join(o, "k", "full").agg(
        F.count("e").alias("expected"), F.count("o").alias("observed"), F.count_if(F.expr("e = 1 and o = 1")).alias("common"), F.count_if(F.expr("e = 1 and o is null")).alias("missing"),
        F.count_if(F.expr("e is null and o = 1")).alias("extra"),
    )
    return counts.withColumn("coverage", ratio(F.col("common"), F.col("expected")))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and the number of rows that break it, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
