"""Questions made for a model: prompts of relations by source, query plans, jobs of second reviews, and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.text import candidate_key, extract_categories, grounding_prompt, normalize_text, parse_yes_no, question_entities
from visgauge.functions.vocabulary import COCO_CATEGORIES
from visgauge.operators.ranking import top_k

# The texts of the relation prompts, and the number of targets that each prompt policy allows.
RELATION_PROMPTS = {
    "v2": (
        "Treat both named instances as present in this image, even if a category label is broad. Compare their visual center positions. Where is the center of ",
        " relative to the center of ",
        "? Reply with exactly one label: above; below; to the left of; to the right of.",
    ),
    "v3": (
        "Treat both named object instances as present in this image, even if a category label is broad or unusual. Judge their depicted spatial relationship, not category definitions or real-world size. Where is ",
        " relative to ",
        "? Reply with exactly one label: above; below; to the left of; to the right of.",
    ),
}
TARGET_LIMITS = {"generic": 6, "task_aware_coco": len(COCO_CATEGORIES), "task_aware_coco_v2": 8}


def instance_phrase(category: Column, rule: Column) -> Column:
    """How a question names one instance: the largest one where the rule says so."""
    return F.concat(F.when(F.coalesce(F.contains(rule, F.lit("largest")), F.lit(False)), "the largest visible ").otherwise("the visible "), category)


def relation_prompt(categories: Column, rules: Column, variant: str) -> Column:
    """The forced-choice question of a relation; rules is a struct of subject and object. Other than two categories are
    an error."""
    before, between, after = RELATION_PROMPTS[variant]
    text = F.concat(F.lit(before), instance_phrase(F.get(categories, F.lit(0)), rules["subject"]), F.lit(between), instance_phrase(F.get(categories, F.lit(1)), rules["object"]), F.lit(after))
    return F.when(F.coalesce(F.size(categories) == 2, F.lit(False)), text).otherwise(F.raise_error(F.lit("a relation has two categories")).cast("string"))


def source_prompts(questions: DataFrame, policies: DataFrame) -> DataFrame:
    """questions with the question of each relation by the prompt that is locked for its source; other tasks stay.

    questions: source, task_type, question, categories, rules; policies: source, variant, passed. A source without an
    accepted policy, or with an unknown variant, is an error.
    """
    locked = policies.select(F.col("source").alias("_source"), "variant", "passed")
    df = questions.join(locked, F.col("source") == F.col("_source"), "left")
    relation = F.col("task_type") == "spatial_relation"
    made = F.raise_error(F.concat(F.lit("no accepted relation prompt for "), F.coalesce(F.col("source"), F.lit("null")))).cast("string")
    for variant in RELATION_PROMPTS:
        made = F.when(F.coalesce(F.col("passed"), F.lit(False)) & (F.col("variant") == variant), relation_prompt(F.col("categories"), F.col("rules"), variant)).otherwise(made)
    return df.withColumn("question", F.when(relation, made).otherwise(F.col("question"))).select(*questions.columns)


def query_plan(question: Column, task: Column, structured: Column) -> Column:
    """struct(source, categories, prompt): what a detector is asked for. A listing asks for the structured categories, which
    it must have; other tasks for the entities of the question."""
    listing = task == "object_listing"
    named = F.array_sort(F.array_distinct(F.transform(structured, normalize_text)))
    asked = F.when(listing & structured.isNull(), F.raise_error(F.lit("a listing needs structured categories")).cast("array<string>")).when(listing, named).otherwise(question_entities(question, task))
    return F.struct(F.when(listing, "structured_vlm_coco80").otherwise("question_parser").alias("source"), asked.alias("categories"), grounding_prompt(asked).alias("prompt"))


def target_limit(policy: Column) -> Column:
    """How many evidence targets a prompt policy allows; an unknown one is an error."""
    found = F.lit(None).cast("int")
    for name, limit in TARGET_LIMITS.items():
        found = F.when(policy == name, limit).otherwise(found)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown prompt policy "), F.coalesce(policy, F.lit("null")))).cast("int")).otherwise(found)


def select_records(df: DataFrame, key: str, strategy: str, order: str, strategies: list[str], each: int | None = None) -> DataFrame:
    """The first `each` rows (None: all) of each strategy by order. A strategy without rows, and a repeated key among the
    rows that are chosen, are errors when the result is used."""
    wanted = df.where(F.col(strategy).isin(strategies))
    if each is not None:
        wanted = top_k(wanted, [strategy], [F.col(order)], each).drop("rank")
    faults = wanted.agg(F.count_distinct(strategy).alias("_s"), (F.count(key) - F.count_distinct(key)).alias("_d"))
    message = F.when(F.col("_s") < len(strategies), "a strategy has no rows").when(F.col("_d") > 0, "a key is repeated")
    checked = faults.select(F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    # the check is one row, and comes first so that it also fails where no row is chosen
    return checked.join(wanted, F.col("_ok"), "left").where(F.col(key).isNotNull()).select(*wanted.columns)


def present_ranking(objects: DataFrame, image: str = "image") -> DataFrame:
    """image, category and rank of the categories of an image, as a question takes them: those with an occluded or truncated
    instance first, then by the smallest area, then by name."""
    each = objects.groupBy(image, "category").agg(F.bool_or(F.coalesce(F.col("occluded") | F.col("truncated"), F.lit(False))).alias("_hard"), F.min("area").alias("_area"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy(image).orderBy(F.desc("_hard"), "_area", "category"))).select(image, "category", "rank")


def segmentation_score(score: Column, mask_score: Column, mode: str) -> Column:
    """The score of a mask by the detector, by the mask (that of the detector where it has none), or their product."""
    mask = F.coalesce(mask_score, score)
    if mode not in ("detector", "mask", "product"):
        raise ValueError(f"unknown mode {mode}")
    return {"detector": score, "mask": mask, "product": score * mask}[mode]


def without_masks(annotations: Column) -> Column:
    """An array of detections without their masks (the field segmentation)."""
    return F.transform(annotations, lambda a: a.dropFields("segmentation"))


def review_jobs(answers: DataFrame, candidates: DataFrame, question: Column, k: int = 3) -> DataFrame:
    """The jobs of a second review: candidate_key, query_key, idx, rank and semantic_question for the k best candidates of
    each query that was answered with no. answers: query_key, prediction, object, one row or more for a query; answers that
    are neither yes nor no, or differ within a query, are an error. candidates: query_key, idx, score."""
    said = parse_yes_no(F.col("prediction"))
    each = answers.groupBy("query_key").agg(F.min(said).alias("_one"), F.max(said).alias("_other"), F.count_if(said.isNull()).alias("_odd"), F.min("object").alias("object"))
    fault = F.when(F.col("_odd") > 0, "an answer is neither yes nor no").when(F.col("_one") != F.col("_other"), "answers differ within a query")
    no = each.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.col("_one") == "no")).select("query_key", "object")
    best = top_k(candidates.join(no, "query_key"), ["query_key"], [F.desc("score"), F.col("idx")], k)
    return best.select(candidate_key(F.col("query_key"), F.col("idx").cast("int")).alias("candidate_key"), "query_key", "object", "idx", "rank", question.alias("semantic_question"))


def oracle_targets(questions: DataFrame) -> DataFrame:
    """image_id and categories: the sorted categories that an image's listing questions name."""
    named = questions.where("task_type = 'object_listing'").select("image_id", F.explode("categories").alias("c"))
    return named.groupBy("image_id").agg(F.array_sort(F.collect_set("c")).alias("categories"))


def mentioned(df: DataFrame, text: str, out: str = "mentioned") -> DataFrame:
    """df with the categories that a free text mentions."""
    return df.withColumn(out, extract_categories(F.col(text)))
