"""Scores of single answers against their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.stats import f1, ratio
from visgauge.functions.text import extract_categories, normalize_text, official_answer, outcome, parse_relation, parse_yes_no


def set_scores(predicted: Column, target: Column) -> Column:
    """struct(precision, recall, f1, exact_match) of two sets; an empty prediction has precision 0, but can be exact."""
    p, t = F.array_distinct(predicted), F.array_distinct(target)
    hits, n, m = F.size(F.array_intersect(p, t)), F.size(p), F.size(t)
    precision, recall = ratio(hits, n, None), ratio(hits, m, None)
    return F.struct(
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), f1(precision, recall).alias("f1"), ((hits == n) & (hits == m)).alias("exact_match")
    )


def set_differences(predicted: Column, target: Column) -> Column:
    """struct of the counts tp, fp, fn and the sorted lists hallucinated and missed of two sets."""
    p, t = F.array_distinct(predicted), F.array_distinct(target)
    extra, lost = F.array_except(p, t), F.array_except(t, p)
    return F.struct(
        F.size(F.array_intersect(p, t)).alias("tp"), F.size(extra).alias("fp"), F.size(lost).alias("fn"), F.array_sort(extra).alias("hallucinated"), F.array_sort(lost).alias("missed")
    )


def binary_evaluation(answer: Column, target: Column) -> Column:
    """struct of the official and the strict reading of a yes or no answer, and its outcome by the official one."""
    official, strict, wanted = official_answer(answer), parse_yes_no(answer), normalize_text(target)
    return F.struct(
        official.alias("official"), strict.alias("strict"), strict.isNotNull().alias("parse_valid"), wanted.alias("target"),
        (official == wanted).alias("is_correct"), outcome(official, wanted).alias("outcome"),
    )


def score_answers(samples: DataFrame, answer: str = "prediction", task: str = "task_type", target: str = "gt_answer", categories: str = "categories") -> DataFrame:
    """samples with the column evaluation: score, is_correct, parse_valid, parsed_prediction, parsed_target and the
    predicted and target categories, each as far as the task has it; other tasks compare normalised texts."""
    a, t, kind = F.col(answer), F.col(target), F.col(task)
    yes_no, wanted_yes_no = parse_yes_no(a), normalize_text(t)
    relation, wanted_relation = parse_relation(a), F.coalesce(parse_relation(t), normalize_text(t))
    found = extract_categories(a)
    wanted = F.when(F.size(categories) > 0, F.array_sort(F.array_distinct(categories))).otherwise(extract_categories(t))
    df = samples.withColumns({"_found": F.when(kind == "object_listing", found), "_wanted": F.when(kind == "object_listing", wanted)})
    sets = set_scores(F.col("_found"), F.col("_wanted"))
    listing = kind == "object_listing"
    parsed = F.when(kind == "object_existence", yes_no).when(kind == "spatial_relation", relation).when(~listing, normalize_text(a))
    expected = F.when(kind == "object_existence", wanted_yes_no).when(kind == "spatial_relation", wanted_relation).when(~listing, normalize_text(t))
    correct = F.when(listing, sets["exact_match"]).otherwise(F.coalesce(parsed == expected, F.lit(False)))
    score = F.when(listing, sets["f1"]).otherwise(correct.cast("double"))
    evaluation = F.struct(
        score.alias("score"), correct.alias("is_correct"), F.when(~listing, parsed.isNotNull()).alias("parse_valid"), parsed.alias("parsed_prediction"), expected.alias("parsed_target"),
        F.col("_found").alias("predicted_categories"), F.col("_wanted").alias("target_categories"),
    )
    return df.withColumn("evaluation", evaluation).drop("_found", "_wanted")
