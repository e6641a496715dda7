"""Aggregated metrics: binary confusion, tasks, sources, latencies, confusion tables, sets, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.stats import exact_percentile, f1, ratio, rounded_mean

TOTAL = "all"


def _binary(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    n = tp + fp + tn + fn
    precision, recall = ratio(tp, tp + fp, None), ratio(tp, tp + fn, None)
    return [
        n.alias("n"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), ratio(tp + tn, n).alias("accuracy"), F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"), f1(precision, recall).alias("f1"), ratio(tp + fp, n).alias("yes_ratio"),
    ]


def binary_metrics(df: DataFrame, predicted: Column, target: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and the share of positives of two boolean columns, over all rows and for
    each value of each column of by. Rows with a null in either column are not counted."""
    rows = df.withColumns({"_p": predicted, "_t": target})
    counts = [F.count_if(c).alias(k) for k, c in {"tp": F.expr("_p and _t"), "fp": F.expr("_p and not _t"), "tn": F.expr("not _p and not _t"), "fn": F.expr("not _p and _t")}.items()]
    cols = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    if not by:
        return rows.agg(*counts).select(*_binary(*cols))
    sets = [[], *([F.col(c)] for c in by)]
    named = rows.groupingSets(sets, *by).agg(*counts, F.grouping_id().alias("_g"))
    every = (1 << len(by)) - 1
    scope, value = F.lit(TOTAL), F.lit(None).cast("string")
    for k, c in enumerate(by):
        own = F.col("_g") == F.lit(every ^ (1 << (len(by) - 1 - k)))
        scope, value = F.when(own, F.lit(c)).otherwise(scope), F.when(own, F.col(c).cast("string")).otherwise(value)
    return named.select(scope.alias("scope"), value.alias("value"), *_binary(*cols))


def grouped_metrics(df: DataFrame, score: Column, correct: Column, first: str, second: str) -> DataFrame:
    """Rows, mean score and accuracy over all, by each of two columns and by both; level names the grouping."""
    rows = df.withColumns({"_s": score.cast("double"), "_c": correct.cast("double")})
    a, b = F.col(first), F.col(second)
    out = rows.groupingSets([[], [a], [b], [a, b]], first, second).agg(
        F.count(F.lit(1)).alias("n"), rounded_mean(F.col("_s")).alias("mean_score"), rounded_mean(F.col("_c")).alias("accuracy"), F.grouping_id().cast("long").alias("level")
    )
    return out.select(first, second, "level", "n", "mean_score", "accuracy")


def latency_summary(df: DataFrame, seconds: Column, by: str) -> DataFrame:
    """Sum, mean, median and 95th percentile of the latencies of each group, and rows a second."""
    x = seconds.cast("double")
    return df.groupBy(by).agg(
        F.count(x).alias("n"), F.round(F.sum(x), 6).alias("total"), rounded_mean(x).alias("mean"), exact_percentile(x, 0.5).alias("median"), exact_percentile(x, 0.95).alias("p95"),
        ratio(F.count(x), F.sum(x)).alias("per_second"),
    )


def confusion(df: DataFrame, target: str, predicted: str, missing: str = "invalid") -> DataFrame:
    """Rows for each pair of target and prediction; a prediction that is null counts as missing."""
    return df.groupBy(F.col(target).alias("target"), F.coalesce(F.col(predicted), F.lit(missing)).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def balanced_accuracy(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, the mean of the accuracies of each target, and the share of the most frequent target."""
    hit = F.count_if(F.coalesce(F.col(target) == F.col(predicted), F.lit(False)))
    each = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), ratio(F.sum("hits"), F.sum("n")).alias("accuracy"), rounded_mean(F.col("hits") / F.col("n")).alias("balanced_accuracy"),
        ratio(F.max("n"), F.sum("n")).alias("majority_baseline"),
    )


def set_summary(df: DataFrame, scores: str, differences: str) -> DataFrame:
    """Micro and macro precision, recall and F1 from the structs of set_scores and set_differences."""
    tp, fp, fn = (F.sum(f"{differences}.{c}") for c in ("tp", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp, None), ratio(tp, tp + fn, None)
    macro = [rounded_mean(F.col(f"{scores}.{c}")).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.round(precision, 6).alias("micro_precision"), F.round(recall, 6).alias("micro_recall"), f1(precision, recall).alias("micro_f1"), *macro,
        rounded_mean(F.col(f"{scores}.exact_match").cast("double")).alias("exact_match"),
    )


def frequency(df: DataFrame, names: Column, as_name: str = "name") -> DataFrame:
    """How often each element occurs in an array column."""
    return df.select(F.explode(names).alias(as_name)).groupBy(as_name).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x: Column, edges: list[float]) -> DataFrame:
    """Rows in each half-open range between edges, by its number: 0 for null, 1 below the first edge, and so on."""
    place = F.when(x.isNull(), 0)
    for k, edge in enumerate(edges):
        place = place.when(x < edge, k + 1)
    return df.groupBy(place.otherwise(len(edges) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def error_rows(df: DataFrame, group: str, outcome: str, key: str) -> DataFrame:
    """For each group: rows of each outcome, different keys among its errors, recall, false-positive rate, errors."""
    n = {k: F.count_if(F.col(outcome) == k.upper()) for k in ("tp", "fp", "tn", "fn")}
    wrong = F.col(outcome).isin("FP", "FN")
    return df.groupBy(group).agg(
        *[c.alias(k) for k, c in n.items()], F.count_distinct(F.when(wrong, F.col(key))).alias("error_keys"), ratio(n["tp"], n["tp"] + n["fn"]).alias("recall"),
        ratio(n["fp"], n["fp"] + n["tn"]).alias("false_positive_rate"), (n["fp"] + n["fn"]).alias("errors"),
    )


def consistency(df: DataFrame, key: str, answer: str, repeats: str, complete: int) -> DataFrame:
    """One row: different keys, those asked by all of `complete` repeats, and those answered in several ways."""
    each = df.groupBy(key).agg(F.count_distinct(repeats).alias("r"), F.count_distinct(answer).alias("a"))
    return each.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("r") == complete).alias("complete"), F.count_if(F.col("a") > 1).alias("disagreeing"))


def unpivot_metrics(first: DataFrame, second: DataFrame, metrics: list[str], names: tuple[str, str]) -> DataFrame:
    """metric, its value in each of two one-row frames, and the second less the first."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], metrics, "metric", name)

    a, b = names
    return long(first, a).join(long(second, b), "metric").withColumn("delta", F.round(F.col(b) - F.col(a), 6))
