"""Building and dividing benchmark sets: difficulty, splits, questions, negatives, frozen digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.hashing import row_digest, salted_order
from visgauge.functions.stats import present
from visgauge.functions.vocabulary import DIFFICULTY_WEIGHTS


def tail_threshold(frequencies: DataFrame, n: str, share: float = 0.2) -> DataFrame:
    """One row, threshold: the frequency at rank ceil(share * rows) from below, and rank 1 at least."""
    return frequencies.agg(F.expr(f"cast(percentile_disc({share}) within group (order by {n}) as bigint)").alias("threshold"))


def difficulty(df: DataFrame) -> DataFrame:
    """df with tags and score, from min_area, occluded, truncated, group_of, n_objects, max_per_category, n_categories,
    rare (holds a category of the tail) and n_relations of each sample."""
    c = F.col
    flags = {
        "tiny_object": c("min_area") <= 0.005, "small_object": (c("min_area") > 0.005) & (c("min_area") <= 0.02), "occluded": c("occluded"), "truncated": c("truncated"), "group_of": c("group_of"),
        "dense_instances": c("n_objects") >= 8, "repeated_category": c("max_per_category") >= 3, "category_diversity": c("n_categories") >= 5, "long_tail_category": c("rare"),
        "spatial_relation": c("n_relations") >= 1, "dense_relations": c("n_relations") >= 5,
    }
    tags = present(flags)
    weights = F.create_map(*[F.lit(x) for kv in DIFFICULTY_WEIGHTS.items() for x in kv])
    score = F.aggregate(tags, F.lit(0.0), lambda a, t: a + F.element_at(weights, t))
    return df.withColumns({"tags": tags, "score": F.round(score, 3)})


def stratified_split(df: DataFrame, key: str, strata: list[str], share: float, salt: str, one: str = "dev", other: str = "test") -> DataFrame:
    """df with split: in each stratum, the share of rows (rounded, but 1 of 2 rows or more) that come first in a salted
    order of their keys is in `one`. Null strata are strata of their own.

    The order is cut by its first two hex digits: a stratum of any size is sorted in 256 parts, whose ranks go on from
    the aggregated sizes of the parts before them.
    """
    rows = df.select("*", salted_order(F.col(key), salt).alias("_o")).withColumn("_b", F.substring("_o", 1, 2))
    parts = rows.groupBy(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(strata)], F.col("_b").alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    of = [F.col(f"_of{i}") for i in range(len(strata))]
    whole = W.partitionBy(*of)
    parts = parts.withColumns({"_n": F.sum("_c").over(whole), "_before": F.coalesce(F.sum("_c").over(whole.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).drop("_c")
    quota = F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.round(F.col("_n") * share))))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_o", key)))
    same = F.col("_b") == F.col("_at")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    split = F.when(F.col("_r") + F.col("_before") <= quota, one).otherwise(other)
    return ranked.join(parts, same).select(*df.columns, split.alias("split"))


def quota_selection(df: DataFrame, key: str, group: str, score: Column, quota: int, salt: str) -> DataFrame:
    """The quota rows of each group with the greatest score; equal ones in a salted order of their keys. Spark limits
    each group to its quota before the shuffle as well, so that a large group sends quota rows a task."""
    w = W.partitionBy(group).orderBy(F.desc("_score"), salted_order(F.col(key), salt), key)
    return df.withColumn("_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota).drop("_score")


def negatives(present_: DataFrame, vocabulary: DataFrame, sample: str, category: str, group: str, salt: str) -> DataFrame:
    """For each sample and category of it, an absent one of the same group: sample, category, negative.

    present_: sample, category; vocabulary: category, group. Of the absent ones, the first in a salted order of sample,
    category and negative is taken, so that uses are even without a running count over all samples. Rows whose group has
    no absent category are left out. A sample's categories meet once; its options are then made in the row.
    """
    names = vocabulary.groupBy(F.col(group).alias("_g")).agg(F.collect_set(category).alias("_names"))
    kinds = vocabulary.select(F.col(category).alias("_c"), F.col(group).alias("_of")).distinct().join(names, F.col("_of") == F.col("_g")).select("_c", "_names")
    here = present_.groupBy(sample).agg(F.collect_set(category).alias("_here")).select(sample, "_here", F.explode("_here").alias(category))
    options = here.join(kinds, F.col(category) == F.col("_c")).withColumn("_absent", F.array_except("_names", "_here")).where("size(_absent) > 0")

    def ranked(name: Column) -> Column:
        return F.struct(F.sha2(F.concat_ws(":", F.lit(salt), F.col(sample).cast("string"), category, name), 256).alias("o"), name.alias("n"))

    return options.select(sample, category, F.array_min(F.transform("_absent", ranked))["n"].alias("negative"))


def split_check(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row: keys of the whole, of the parts, in several parts, missing from and unknown to the parts."""
    marked = whole.select(F.col(key).alias("k"), F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        marked = marked.unionByName(part.select(F.col(key).alias("k"), F.lit(0).alias("w"), F.lit(1).alias("p")))
    each = marked.groupBy("k").agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
    return each.agg(
        F.count_if(F.expr("w > 0")).alias("whole"), F.count_if(F.expr("p > 0")).alias("parts"), F.count_if(F.expr("p > 1")).alias("overlap"), F.count_if(F.expr("w > 0 and p = 0")).alias("missing"),
        F.count_if(F.expr("w = 0 and p > 0")).alias("unknown"),
    )


def frozen_digest(df: DataFrame, row: Column, by: str) -> DataFrame:
    """by, rows and digest of each group: a sum over rows that any two equal sets of rows share, in whatever order."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(row_digest(row)).cast("string").alias("digest"))


def ids_digest(df: DataFrame, key: str, by: str, separator: str, end: str = "") -> DataFrame:
    """by, n and digest: the SHA-256 of the sorted keys of each group joined by separator, with end behind the last. The
    keys of one group meet in one row: for benchmark sets, whose lists of ids are published with their digest. frozen_digest
    is a digest for tables of any size."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), separator)
    return df.where(F.col(key).isNotNull()).groupBy(by).agg(F.count(key).alias("n"), F.sha2(F.concat(ids, F.lit(end)), 256).alias("digest"))
