"""A corpus made ready for training in stages, each of which calls one operator of visgauge.llm."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visgauge.llm import bpe
from visgauge.llm.common import shared_folder, table
from visgauge.llm.decontaminate import decontaminate
from visgauge.llm.langid import fit_languages, identify_languages
from visgauge.llm.lines import drop_boilerplate
from visgauge.llm.simhash import keep_one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; those far from all of its centroids go."""
    rows = docs.select("text", F.struct(*docs.columns).alias("doc"))
    return identify_languages(rows, fit_languages(docs), keep=("doc",)).where(~F.col("rejected")).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that are boilerplate of their source."""
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")])  # out of the way of the counts' names
    left = drop_boilerplate(docs.select(F.col("source"), F.col("text"), rest.alias("doc")))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, their number and digest, and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = bpe.encode(docs, path, decoded=True)
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot tell the language, near-duplicate and encoding stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are written to the shared folder and read again; those of
    the stage before go when the next ones are complete."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
