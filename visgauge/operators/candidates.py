"""Candidates for hard benchmark sets: one row an image, from its objects and the relations that are beyond doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.text import canonical_text
from visgauge.operators.datasets import difficulty, tail_threshold
from visgauge.operators.detection import largest_relation
from visgauge.operators.spread import partitions


def surface_name(names: Column, name: Column) -> Column:
    """The first of several names, or else the name, in canonical form."""
    return canonical_text(F.coalesce(F.when(F.size(names) > 0, F.get(names, F.lit(0))), name))


def entity_name(synsets: Column, names: Column, name: Column) -> Column:
    """The lemma of the first synset (`dog` of `dog.n.01`); without one the surface name, less a genitive `'s`."""
    lemma = F.when(F.size(synsets) > 0, F.substring_index(F.get(synsets, F.lit(0)), ".", 1))
    plain = F.trim(F.regexp_replace(surface_name(names, name), "'s$", ""))
    return F.when(F.coalesce(lemma, F.lit("")) != "", canonical_text(lemma)).otherwise(plain)


def unit_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners of a box of pixels as shares of the image, cut at its edges; null without an area or a size."""
    ends = ((x, width), (y, height), (x + w, width), (y + h, height))
    good = (width > 0) & (height > 0) & (w > 0) & (h > 0)
    return F.when(good, F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") / size)) for v, size in ends]))


def instance_rules(entities: DataFrame, image: str = "image") -> DataFrame:
    """image, entity and rule: `unique_category` for the only entity of its category in an image, `largest_instance` for the
    one that is larger than all others of it, and null for the rest. entities: image, entity, category, area; an entity
    that is listed several times counts once, with its first category by name."""
    once = entities.groupBy(image, "entity").agg(F.min(F.struct("category", "area")).alias("_e")).select(image, "entity", "_e.*")
    kind = W.partitionBy(image, "category")
    order = kind.orderBy(F.desc("area"), "entity")
    ranked = once.withColumns({"_n": F.count(F.lit(1)).over(kind), "_r": F.row_number().over(order), "_next": F.lead("area").over(order)})
    largest = (F.col("_r") == 1) & (F.col("area") > F.col("_next") + 1e-8)
    return ranked.select(image, "entity", "category", F.when(F.col("_n") == 1, "unique_category").when(largest, "largest_instance").alias("rule"))


def safe_relations(entities: DataFrame, relations: DataFrame, image: str = "image", parts: int | None = None) -> DataFrame:
    """image, subject, predicate, object with subject_category, object_category, subject_rule and object_rule, of the
    relations between two categories of which both ends are beyond doubt: a name alone tells which entity is meant.

    relations: image, subject, predicate, object (entities); repeated ones count once. Ends that are no entity, and
    relations within one category, are left out. Rows are dealt to so many parts (None: by the rows of entities).
    """
    parts = parts or partitions(entities)
    rules = instance_rules(entities.repartition(parts, image), image)
    out = relations.select(image, "subject", "predicate", "object").where("predicate is not null").repartition(parts, image).distinct()
    for role in ("subject", "object"):
        ends = rules.select(image, F.col("entity").alias(role), F.col("category").alias(f"{role}_category"), F.col("rule").alias(f"{role}_rule"))
        out = out.repartition(parts, image, role).join(ends.repartition(parts, image, role), [image, role])
    return out.where("subject_category <> object_category and subject_rule is not null and object_rule is not null")


def image_candidates(objects: DataFrame, relations: DataFrame, image: str = "image", share: float = 0.2, parts: int | None = None) -> DataFrame:
    """image, categories, n_objects, n_relations, tags and score of the images that have a relation.

    objects: image, category, area (a share of the image), occluded, truncated, group_of; relations: image. A category is
    of the tail if no more images hold it than the least frequent share of categories reach. An image's rows meet once, in
    one of so many parts (None: by the rows of objects); the categories, a vocabulary, are sent to the tasks.
    """
    parts = parts or partitions(objects)
    linked = relations.repartition(parts, image).groupBy(image).agg(F.count(F.lit(1)).alias("n_relations"))
    here = objects.repartition(parts, image).join(linked.select(image), image, "left_semi")
    held = here.select(image, "category").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("_images"))
    rare = held.crossJoin(tail_threshold(held, "_images", share)).select("category", (F.col("_images") <= F.col("threshold")).alias("_rare"))
    kinds = here.groupBy(image, "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("area").alias("a"), *[F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("occluded", "truncated", "group_of")]
    ).join(F.broadcast(rare), "category")
    each = kinds.groupBy(image).agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.min("a").alias("min_area"), F.bool_or("occluded").alias("occluded"), F.bool_or("truncated").alias("truncated"), F.bool_or("group_of").alias("group_of"),
        F.sum("n").alias("n_objects"), F.max("n").alias("max_per_category"), F.count(F.lit(1)).alias("n_categories"), F.bool_or("_rare").alias("rare"),
    )
    return difficulty(each.join(linked, image)).select(image, "categories", "n_objects", "n_relations", "tags", "score")


def box_candidates(objects: DataFrame, image: str = "image") -> DataFrame:
    """image_candidates of images with boxes, whose one relation is the clearest between the largest objects that are no
    group, with subject, predicate and object. objects: as for image_candidates, with idx and box (corners, 0 to 1)."""
    relation = largest_relation(objects.where(~F.coalesce(F.col("group_of"), F.lit(False))), image)
    return image_candidates(objects, relation, image).join(relation.select(image, "subject", "predicate", "object"), image)
