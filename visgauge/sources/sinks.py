"""Sinks of reports and records with one form for the same content."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visgauge.sources.folders import Folder


def canonical_json(df: DataFrame) -> DataFrame:
    """Each row as JSON with its columns in the order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Canonical JSON Lines, in as many files as df has partitions."""
    canonical_json(df).write.mode("overwrite").text(path)


def flat(df: DataFrame, separator: str = ";") -> DataFrame:
    """df for CSV: lists of plain values joined by separator, other nested values as JSON."""

    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.ArrayType, T.MapType, T.StructType)):
            return F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name)

    return df.select(*map(cell, df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small report as JSON with sorted keys, in place at once or not at all, on any file system that Spark knows."""
    folder, _, name = path.rpartition("/")
    Folder(spark, folder or ".").replace(name, (json.dumps(document, sort_keys=True, indent=2) + "\n").encode())
