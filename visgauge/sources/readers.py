"""Scans of JSON Lines, JSON and CSV files that say where a bad record stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visgauge.sources.json_arrays import read_json_array

CORRUPT = "_corrupt_record"


class BadInput(ValueError):
    """Input that breaks the rules of its format or of its schema."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped. A line that is no object of the schema is an error with its text."""
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    message = F.concat(F.lit("bad JSON line in "), F.input_file_name(), F.lit(": "), F.substring(CORRUPT, 1, 200))
    good = F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(F.raise_error(message))
    return rows.where(good).drop(CORRUPT)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file that is one array, one object or JSON Lines, told apart by the ends of its first lines. An array
    may be of any size and on one line: it is read by read_json_array()."""
    line = F.trim("value")
    head = spark.read.text(path).where("trim(value) <> ''").select(F.left(line, F.lit(1)).alias("first"), F.right(line, F.lit(1)).alias("last")).first()
    if head is None:
        raise BadInput(f"{path} is empty")
    if head["first"] == "[":
        return read_json_array(spark, path, schema)
    if head["first"] != "{":
        raise BadInput(f"{path} holds no objects")
    if head["last"] == "}":
        return read_jsonl(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header as strings; columns that are missing are an error."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise BadInput(f"{path} lacks the columns {', '.join(missing)}")
    return rows


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str], header: tuple[str, str] | None = None) -> DataFrame:
    """A CSV of two columns without a header; rows that are short, or the header, are skipped."""
    rows = spark.read.schema(f"{names[0]} string, {names[1]} string").csv(path).dropna()
    return rows if header is None else rows.where((F.col(names[0]) != header[0]) | (F.col(names[1]) != header[1]))


def read_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key and its place from a JSON list or an object with the list `key`s; repeated or no ids are an error."""
    document = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", f"$.{key}s"), "array<string>"))
    rows = document.select(F.posexplode(listed).alias("place", key))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if not counts["n"] or counts["n"] != counts["d"]:
        raise BadInput(f"{path} has no ids or repeats some")
    return rows


def read_candidates(spark: SparkSession, boxes: str, classes: str) -> DataFrame:
    """image, label, x1, y1, x2, y2, occluded, truncated, group_of of valid boxes, corners between 0 and 1, with names."""
    names = read_pairs(spark, classes, ("LabelName", "label"))
    rows = read_table(spark, boxes, ["ImageID", "LabelName", "XMin", "XMax", "YMin", "YMax", "IsOccluded", "IsTruncated", "IsGroupOf"])
    sides = {n: F.col(c).try_cast("double") for n, c in {"x1": "XMin", "y1": "YMin", "x2": "XMax", "y2": "YMax"}.items()}
    flags = {n: F.col(c) == "1" for n, c in {"occluded": "IsOccluded", "truncated": "IsTruncated", "group_of": "IsGroupOf"}.items()}
    full = rows.join(names, "LabelName").withColumns(sides | flags)
    valid = full.where("x1 >= 0 and y1 >= 0 and x2 <= 1 and y2 <= 1 and x2 > x1 and y2 > y1")
    return valid.select(F.col("ImageID").alias("image"), F.lower("label").alias("label"), *sides, *flags)


def read_graph(spark: SparkSession, relationships: str, images: str, excluded: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """image_id, predicate, subject, object of scene-graph relations with one of the known predicates, less those of
    images whose COCO id is excluded. subject and object are structs of id, name and a box of pixels."""
    entity = "object_id bigint, name string, names array<string>, x double, y double, w double, h double"
    graph = spark.read.schema(f"image_id bigint, relationships array<struct<predicate:string,subject:struct<{_struct(entity)}>,object:struct<{_struct(entity)}>>>").option("multiLine", True).json(relationships)
    sizes = spark.read.schema("image_id bigint, coco_id bigint, width double, height double").option("multiLine", True).json(images)
    known = F.create_map(*[F.lit(x) for kv in predicates.items() for x in kv])
    rows = graph.select("image_id", F.explode("relationships").alias("r")).withColumn("predicate", F.element_at(known, F.lower(F.trim("r.predicate"))))
    kept = sizes.join(excluded.select("coco_id").where("coco_id is not null"), "coco_id", "left_anti")
    return rows.where("predicate is not null").join(kept, "image_id").select("image_id", "width", "height", "predicate", "r.subject", "r.object").dropDuplicates(["image_id", "predicate", "subject", "object"])


def _struct(fields: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in fields.split(", "))
