"""Runs that can be taken up again: what is left to do, and metrics kept up to date as answers arrive."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visgauge.operators.ranking import last_wins
from visgauge.sources.folders import Folder

#: The configuration of a run, in its folder.
CONFIG = "run_config.json"


def pending(samples: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The samples that have no answer yet."""
    return samples.join(answers.select(key).distinct(), key, "left_anti")


def current(answers: DataFrame, key: str, order: str) -> DataFrame:
    """Of several answers to a sample, the last."""
    return last_wins(answers, [key], [F.col(order)])


def run_status(samples: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """One row: expected and answered samples, and completed or incomplete."""
    done = answers.select(key).distinct().withColumn("_d", F.lit(1))
    counts = samples.select(key).distinct().join(done, key, "left").agg(F.count(F.lit(1)).alias("expected"), F.count("_d").alias("answered"))
    return counts.withColumn("status", F.when(F.col("expected") == F.col("answered"), "completed").otherwise("incomplete"))


def config_differences(existing: Column, current: Column, keys: list[str]) -> Column:
    """The keys, as `key: old -> new`, in which two run configurations (JSON objects) differ; a run that is taken up again
    with other settings belongs to another folder. A key that one of them lacks is null there."""
    kind = "map<string,string>"
    old, new = (F.from_json(c, kind) for c in (existing, current))
    parts = []
    for k in keys:
        a, b = (F.try_element_at(m, F.lit(k)) for m in (old, new))
        said = F.concat(F.lit(f"{k}: "), F.coalesce(a, F.lit("null")), F.lit(" -> "), F.coalesce(b, F.lit("null")))
        parts.append(F.when(~a.eqNullSafe(b), said))
    return F.array_compact(F.array(*parts))


class RunConflict(ValueError):
    """A run folder that belongs to a run with another configuration."""


def claim(spark: SparkSession, folder: str, config: dict, keys: list[str]) -> str:
    """Take a run folder before the first row is written: `started` for the run that creates its configuration, `resumed`
    for one that finds the same there. Of runs that start at once exactly one creates it; one whose keys differ is
    refused, with what differs, so that two runs never write to one folder. keys that neither has are alike."""
    place = Folder(spark, folder)
    if place.create(CONFIG, (json.dumps(config, sort_keys=True, indent=2) + "\n").encode()):
        return "started"
    there = json.loads(place.read(CONFIG))
    wrong = [f"{k}: {json.dumps(there.get(k))} -> {json.dumps(config.get(k))}" for k in keys if there.get(k) != config.get(k)]
    if wrong:
        raise RunConflict(f"{folder} belongs to another run: {'; '.join(wrong)}")
    return "resumed"


class Sums:
    """A table of sums by some keys, kept as commits that are numbered by the stream's batches.

    Commit n is the commit before it with the sums of batch n added, so that a batch costs what it holds and as many
    rows as there are keys, whatever came before. A batch that is run again makes its commit again from the one before;
    commits older than that go."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], sums: list[str]) -> None:
        self.spark, self.path, self.by, self.sums, self.folder = spark, path, by, sums, Folder(spark, path)

    def commits(self) -> list[int]:
        """Numbers of the commits that are complete."""
        if not self.folder.exists():
            return []
        found = [c for c in self.folder.children() if c.startswith("commit=") and self.folder.exists(f"{c}/_SUCCESS")]
        return sorted(int(c.removeprefix("commit=")) for c in found)

    def at(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/commit={number}")

    def add(self, number: int, rows: DataFrame) -> DataFrame:
        """Commit `number`: the sums so far with those of rows (by and sums), which may be partial."""
        before = [n for n in self.commits() if n < number]
        new = rows.select(*self.by, *self.sums)
        every = self.at(before[-1]).select(*self.by, *self.sums).unionByName(new) if before else new
        every.groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in self.sums]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commit={number}")
        for old in before[:-1]:
            self.folder.delete(f"commit={old}")
        return self.at(number)


def follow_sums(
    spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, by: list[str], parts: dict[str, Column], finish: Callable[[DataFrame], DataFrame], metrics_out: str, valid: str = "true", metrics_every: int = 1
) -> StreamingQuery:
    """As follow(), for metrics that are made by finish of sums of parts by the columns `by`: the sums are kept as state
    beside out, so no batch reads the answers of those before."""
    state = Sums(spark, f"{out}_sums", by, list(parts))

    def metrics(batch: DataFrame, number: int) -> None:
        sums = state.add(number, batch.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in parts.items()]))
        if number % metrics_every == 0:
            finish(sums).write.mode("overwrite").json(metrics_out)

    return _followed(spark, source, schema, out, checkpoint, key, valid, metrics)


def follow(
    spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, metrics: Callable[[DataFrame], DataFrame], metrics_out: str, valid: str = "true", metrics_every: int = 1
) -> StreamingQuery:
    """Append JSON answers that arrive in source to the Parquet table out, each key once, and rewrite metrics_out.

    Rows that are not valid go to `<out>_errors`. The keys seen are kept in the stream's state, so that a batch costs what
    it holds, however many came before. The metrics are made of all answers, in every metrics_every-th batch. Each batch
    is written to a part of its own, so a batch that is run again after a failure replaces what it had written.
    """

    def every(batch: DataFrame, number: int) -> None:
        if number % metrics_every == 0:
            metrics(spark.read.parquet(out)).write.mode("overwrite").json(metrics_out)

    return _followed(spark, source, schema, out, checkpoint, key, valid, every)


def _followed(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, valid: str, metrics: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where("_ok").drop("_ok", "_once")
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where("not _ok").drop("_ok", "_once").write.mode("overwrite").json(f"{out}_errors/batch={number}")
        metrics(good, number)
        batch.unpersist()

    good = F.coalesce(F.expr(valid), F.lit(False))
    once = F.when(F.col("_ok"), F.concat(F.lit("key "), F.col(key).cast("string"))).otherwise(F.concat(F.lit("row "), F.uuid()))  # all errors are kept
    stream = spark.readStream.schema(schema).json(source).withColumn("_ok", good).withColumn("_once", once).dropDuplicates(["_once"])
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
