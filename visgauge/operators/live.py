"""Joint scores of an answer, the targets it names and the boxes found for it, and the exchange with COCO tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.functions.boxes import area
from visgauge.functions.stats import f1, ratio, rounded_mean
from visgauge.functions.text import extract_categories, normalize_text
from visgauge.operators.detection import match_boxes
from visgauge.operators.scoring import set_differences


def canonical_targets(df: DataFrame, key: str, targets: str, out: str = "canonical") -> DataFrame:
    """df with the sorted distinct targets of each key: a target that names one category is that category, and any other
    is its normal form; blank ones go."""
    each = df.select(key, F.explode(targets).alias("_t")).where("trim(_t) <> ''").distinct()
    named = each.withColumn("_found", extract_categories(F.col("_t")))
    name = F.when(F.size("_found") == 1, F.get("_found", F.lit(0))).otherwise(normalize_text(F.col("_t")))
    return df.join(named.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(out)), key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def evidence_success(samples: DataFrame, truth: DataFrame, found: DataFrame, key: str = "id", correct: str = "is_correct", threshold: float = 0.5) -> DataFrame:
    """samples with gt, predicted, tp, fp, fn, evidence_required, evidence_supported, evidence_complete, success and
    complete_success.

    truth: key, category, idx, box; found: the same and score. Boxes are matched within a category. Where boxes are
    expected, one match supports an answer and all of them make its evidence complete; where none are, finding none does
    both. A success is a correct answer that is supported.
    """
    sums = match_boxes(truth, found, [key, "category"], threshold).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("gt", "predicted", "tp", "fp", "fn")])
    df = samples.join(sums, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gt", "predicted", "tp", "fp", "fn")})
    required = F.col("gt") > 0
    supported = F.when(required, F.col("tp") > 0).otherwise(F.col("predicted") == 0)
    complete = F.when(required, F.col("fn") == 0).otherwise(F.col("predicted") == 0)
    right = F.coalesce(F.col(correct), F.lit(False))
    return df.withColumns({"evidence_required": required, "evidence_supported": supported, "evidence_complete": complete, "success": right & supported, "complete_success": right & complete})


def live_summary(scored: DataFrame, by: list[str], correct: str = "is_correct") -> DataFrame:
    """Rows, rates of correct, supported, complete and successful answers, and micro precision, recall and F1 of boxes, of
    evidence_success by some columns."""
    rates = {"accuracy": F.coalesce(F.col(correct), F.lit(False)), "support_rate": F.col("evidence_supported"), "complete_rate": F.col("evidence_complete"), "success_rate": F.col("success"), "complete_success_rate": F.col("complete_success")}
    sums = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[rounded_mean(c.cast("double")).alias(n) for n, c in rates.items()], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), None), ratio(F.col("tp"), F.col("tp") + F.col("fn"), None)
    return sums.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": f1(precision, recall)})


def target_scores(samples: DataFrame, expected: str, named: str) -> DataFrame:
    """samples with tp, fp, fn, hallucinated and missed of the targets that were named against those expected."""
    return samples.withColumn("_t", set_differences(F.col(named), F.col(expected))).select("*", "_t.*").drop("_t")


def oracle_annotations(annotations: DataFrame, categories: DataFrame, questions: DataFrame) -> DataFrame:
    """The annotations of each image that are of a category which one of its listing questions asks for, of any size.

    annotations: image_id, category_id; categories: id, name; questions: image_id, task_type, categories. A category that
    is asked for and isn't among categories is an error.
    """
    asked = questions.where("task_type = 'object_listing'").select("image_id", F.explode("categories").alias("_name")).distinct()
    known = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_known"))
    wanted = asked.join(known, F.col("_name") == F.col("_known"), "left")
    number = F.when(F.col("category_id").isNull(), F.raise_error(F.concat(F.lit("no category has the name "), "_name")).cast("bigint")).otherwise(F.col("category_id").cast("bigint"))
    return annotations.join(wanted.select("image_id", number.alias("category_id")), ["image_id", "category_id"], "left_semi")


def filtered_report(annotations: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: annotations before and after, how many went, and the share that stayed."""
    counts = annotations.agg(F.count(F.lit(1)).alias("before")).crossJoin(kept.agg(F.count(F.lit(1)).alias("after")))
    return counts.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), ratio(F.col("after"), F.col("before")).alias("retention_rate"))


def coco_results(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (x, y, width, height, rounded to four places), score and skipped of each detection.

    predictions: image_id, class_name, box (corners), score. skipped is null for a result, `unmapped_label` where no
    category has that name, and `invalid_bbox` where the box isn't four numbers that span an area from its first corner.
    The categories, a vocabulary, are sent to the tasks: names are few, so that rows would meet by name in a few of them.
    """
    known = categories.select(F.col("id").alias("category_id"), normalize_text(F.col("name")).alias("_name"))
    df = predictions.join(F.broadcast(known), normalize_text(F.col("class_name")) == F.col("_name"), "left")
    b = F.col("box")
    good = F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)) & F.coalesce(F.get(b, F.lit(2)) > F.get(b, F.lit(0)), F.lit(False)) & F.coalesce(F.get(b, F.lit(3)) > F.get(b, F.lit(1)), F.lit(False))
    skipped = F.when(F.col("category_id").isNull(), "unmapped_label").when(~good, "invalid_bbox")
    xywh = F.when(skipped.isNull(), F.transform(F.array(F.get(b, F.lit(0)), F.get(b, F.lit(1)), F.get(b, F.lit(2)) - F.get(b, F.lit(0)), F.get(b, F.lit(3)) - F.get(b, F.lit(1))), lambda x: F.round(x, 4)))
    return df.select("image_id", "category_id", xywh.alias("bbox"), "score", skipped.alias("skipped"))


def size_shares(annotations: DataFrame, box: str, by: list[str]) -> DataFrame:
    """Rows and mean area of boxes by some columns and by size."""
    a = area(F.col(box))
    size = F.when(a < 32**2, "small").when(a < 96**2, "medium").otherwise("large")
    return annotations.groupBy(*by, size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a), 6).alias("mean_area"))
