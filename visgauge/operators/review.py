"""Second opinions on negative answers: a choice among similar categories, and policies locked for each kind of task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.text import normalize_text, parse_yes_no


def ontology_faults(groups: DataFrame, group: str, category: str, expected: DataFrame) -> DataFrame:
    """reason and category of what is wrong with an ontology: categories in several groups or several times in one,
    missing from it or unknown to expected (a table with the column category). An ontology without faults has no rows."""
    own = groups.select(normalize_text(F.col(group)).alias("g"), normalize_text(F.col(category)).alias("category"))
    each = own.groupBy("category").agg(F.count_distinct("g").alias("groups"), F.count(F.lit(1)).alias("n"))
    wanted = expected.select(normalize_text(F.col("category")).alias("category")).distinct().withColumn("_w", F.lit(True))
    both = each.join(wanted, "category", "full")
    reason = F.when(F.col("groups") > 1, "several_groups").when(F.col("n") > 1, "repeated").when(F.col("n").isNull(), "missing").when(F.col("_w").isNull(), "unknown")
    return both.select(reason.alias("reason"), "category").where("reason is not null")


def contrastive_options(groups: DataFrame, group: str, category: str, none: str = "none") -> DataFrame:
    """category and options: the sorted categories of its group, itself included, and the label of none of them."""
    own = groups.select(normalize_text(F.col(group)).alias("_g"), normalize_text(F.col(category)).alias("category")).distinct()
    options = own.groupBy("_g").agg(F.array_sort(F.array_union(F.collect_set("category"), F.array(F.lit(none)))).alias("options"))
    return own.join(options, "_g").select("category", "options")


def contrastive_question(options: Column) -> Column:
    """A question that does not tell which of its options is asked for."""
    return F.concat(F.lit("Allowed labels: "), F.array_join(options, ", "), F.lit("."))


def parse_choice(answer: Column, options: Column) -> Column:
    """The option that an answer names exactly, but for case and blanks around it; null for anything else."""
    said = F.lower(F.trim(answer))
    return F.when(F.array_contains(F.transform(options, normalize_text), said), said)


def normalize_review(answer: Column) -> Column:
    """struct(parsed, exact, valid): the yes or no of an answer, whether it is nothing else, and whether there is one."""
    parsed = parse_yes_no(answer)
    return F.struct(parsed.alias("parsed"), F.coalesce(normalize_text(answer).isin("yes", "no"), F.lit(False)).alias("exact"), parsed.isNotNull().alias("valid"))


def contrastive_cascade(baseline: DataFrame, jobs: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    """baseline with selected, final_answer, status and correction.

    baseline: key, prediction, gt_answer; jobs: key, v3_key, object, options; reviews: v3_key, answer. A `no` for which
    there is a job becomes `yes` if its review names the object among the options. A baseline answer that is neither yes
    nor no, a job without a review, and a repeated job or review are errors.
    """
    one_job = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("_jobs"), F.first("v3_key").alias("v3_key"), F.first("object").alias("_object"), F.first("options").alias("_options"))
    one_review = reviews.groupBy("v3_key").agg(F.count(F.lit(1)).alias("_reviews"), F.first("answer").alias("_answer"))
    df = baseline.join(one_job, key, "left").join(one_review, "v3_key", "left").withColumn("_was", parse_yes_no(F.col("prediction")))
    fault = F.when(F.col("_was").isNull(), "a baseline answer is neither yes nor no").when(F.col("_jobs") > 1, "a job is repeated").when(F.col("_reviews") > 1, "a review is repeated").when(F.col("v3_key").isNotNull() & F.col("_reviews").isNull(), "a job has no review")
    asked = (F.col("_was") == "no") & F.col("v3_key").isNotNull()
    selected = F.when(asked, parse_choice(F.col("_answer"), F.col("_options")))
    raised = F.coalesce(asked & (selected == F.col("_object")), F.lit(False))
    final = F.when(raised, "yes").otherwise(F.col("_was"))
    # The names of the states.
    status = (
        F.when(fault.isNotNull(), F.raise_error(fault).cast("string"))
        .when(raised, "promoted_by_contrastive_target_match")
        .when(asked & selected.isNull(), "negative_preserved_invalid_contrastive_answer")
        .when(asked, "negative_preserved_by_contrastive_rejection")
        .when(F.col("_was") == "yes", "positive_preserved_without_negative_recheck")
        .otherwise("baseline_unchanged")
    )
    was_right, is_right = (F.coalesce(c == normalize_text(F.col("gt_answer")), F.lit(False)) for c in (F.col("_was"), final))
    correction = F.when(~raised, "unchanged").when(~was_right & is_right, "beneficial").when(was_right & ~is_right, "harmful").otherwise("neutral")
    return df.select(*baseline.columns, selected.alias("selected"), final.alias("final_answer"), status.alias("status"), correction.alias("correction"))


def listing_policy(categories: Column) -> Column:
    """struct(forced, selective, status): a list of categories as the answer; without one there is no selective answer."""
    named = F.array_sort(F.array_distinct(categories))
    answer = F.array_join(named, ", ")
    some = F.coalesce(F.size(named) > 0, F.lit(False))
    return F.struct(F.coalesce(answer, F.lit("")).alias("forced"), F.when(some, answer).alias("selective"), F.when(some, "structured_vlm_output").otherwise("empty_vlm_output").alias("status"))


def locked_answers(df: DataFrame, policies: DataFrame, modes: dict[str, Column], task: str = "task_type") -> DataFrame:
    """df with candidate_id, mode, forced, selective and status, by the policy that is locked for each row's task.

    policies: task, mode and candidate_id, one row a task; modes: for each mode, struct(forced, selective, status) of a
    row. A task without a policy, a policy without a candidate, and a mode that is not in modes are errors.
    """
    locked = policies.select(F.col(task).alias("_task"), "mode", "candidate_id")
    df = df.join(locked, F.col(task) == F.col("_task"), "left")
    empty = F.lit(None).cast("struct<forced:string,selective:string,status:string>")
    made = empty
    for mode, answer in modes.items():
        made = F.when(F.col("mode") == mode, answer.cast("struct<forced:string,selective:string,status:string>")).otherwise(made)
    fault = F.when(F.col("mode").isNull(), "a task has no locked policy").when(F.coalesce(F.col("candidate_id"), F.lit("")) == "", "a locked policy has no candidate").when(~F.col("mode").isin(*modes), "a locked policy has an unknown mode")
    made = F.when(fault.isNotNull(), F.raise_error(fault).cast("struct<forced:string,selective:string,status:string>")).otherwise(made)
    return df.withColumn("_made", made).select("*", "_made.*").drop("_made", "_task")
