"""Frozen releases: tables as canonical files with a manifest of sizes and digests, put in place at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visgauge.sources.folders import Folder
from visgauge.sources.sinks import flat

MANIFEST = "manifest.json"


class BrokenRelease(ValueError):
    """A release that can't be made, isn't there, or isn't what its manifest says."""


def document_bytes(document: object) -> bytes:
    """The one form of a report: JSON of sorted keys, two blanks a level, one line end."""
    return (json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (in the folder), bytes and sha256 of every file of a folder and its subfolders. A file is read whole by one
    task, so files are best no larger than a partition."""
    root = Folder(spark, path).root
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.ltrim(F.replace("path", F.lit(root), F.lit("")), F.lit("/")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _listed(spark: SparkSession, path: str) -> list[dict]:
    """All files but the manifest, in order of their paths: a row each comes to the driver."""
    if not Folder(spark, path).files():
        return []
    return sorted((r.asDict() for r in file_digests(spark, path).where(F.col("path") != MANIFEST).collect()), key=lambda f: f["path"])


def _write_table(df: DataFrame, keys: list[str], kind: str, folder: str, files: int) -> None:
    """The rows in files by a hash of their keys, in order of the keys: the same whatever partitions df comes in."""
    spark, columns = df.sparkSession, sorted(df.columns)
    rows = df.withColumn("_f", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(files)).cast("int"))
    ordered = rows.repartition("_f").sortWithinPartitions("_f", *keys)
    if kind == "csv":
        flat(ordered.select(*columns, "_f")).write.partitionBy("_f").option("header", True).csv(folder)
    else:
        ordered.select(F.to_json(F.struct(*columns)).alias("value"), "_f").write.partitionBy("_f").text(folder)
    written = Folder(spark, folder)
    for name in sorted(written.files()):
        if name.startswith("_f=") and not name.rsplit("/", 1)[1].startswith((".", "_")):
            written.move(name, f"part-{int(name.split('/')[0][3:]):05d}.{kind}")
    for name in written.children():
        if not name.startswith("part-"):
            written.delete(name)


def freeze(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]], facts: dict[str, object] | None = None, formats: dict[str, str] | None = None, files: int = 1) -> dict:
    """Write a release of some tables to the folder path, and return its manifest.

    A table is a subfolder of `files` canonical files at most (give as many as make each the size of a partition), its
    rows dealt out by a hash of keys[name] and in their order: JSON Lines with sorted keys, or, with the format csv, CSV
    with a header of sorted columns and lists joined by semicolons. Keys must name a row: a repeated or null key is an
    error. The manifest has the facts, the rows, columns, keys and format of each table, and size and SHA-256 of each
    file. All is written beside path and put there by one rename, so that a release is there as a whole or not at all.
    If path is there already, its files stay, and an error names those that differ from what would be written.
    """
    spark = next(iter(tables.values())).sparkSession
    part, described = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part", {}
    try:
        for name, df in sorted(tables.items()):
            own, kind = keys[name], (formats or {}).get(name, "jsonl")
            if kind not in ("jsonl", "csv"):
                raise ValueError(f"no format {kind}")
            missing = F.lit(False)
            for k in own:
                missing = missing | F.col(k).isNull()
            if not df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where(missing | (F.col("_n") > 1)).isEmpty():
                raise BrokenRelease(f"the rows of {name} aren't named by {', '.join(own)}")
            _write_table(df, own, kind, f"{part}/{name}", files)
            described[name] = {"format": kind, "keys": own, "columns": sorted(df.columns), "rows": df.count()}
        manifest = {"facts": facts or {}, "tables": described, "files": _listed(spark, part)}
        made = Folder(spark, part)
        made.create(MANIFEST, document_bytes(manifest))
        if Folder(spark, path).exists() or not made.rename(path):
            wrong = verify(spark, path) or _differences(read_manifest(spark, path), manifest)
            if wrong:
                raise BrokenRelease(f"{path} is there already and differs: {'; '.join(wrong)}")
        return manifest
    finally:
        if Folder(spark, part).exists():
            Folder(spark, part).delete()


def read_manifest(spark: SparkSession, path: str) -> dict:
    folder = Folder(spark, path)
    if not folder.exists(MANIFEST):
        raise BrokenRelease(f"{path} has no manifest")
    return json.loads(folder.read(MANIFEST))


def _differences(manifest: dict, other: dict) -> list[str]:
    there, here = ({f["path"]: f for f in m["files"]} for m in (manifest, other))
    out = [f"{p}: missing" for p in there if p not in here] + [f"{p}: not in the manifest" for p in here if p not in there]
    for p in there.keys() & here.keys():
        if there[p] != here[p]:
            out.append(f"{p}: {'changed' if there[p]['bytes'] == here[p]['bytes'] else 'of another size'}")
    return sorted(out) + [f"{k} differ" for k in ("facts", "tables") if k in other and manifest[k] != other[k]]


def verify(spark: SparkSession, path: str) -> list[str]:
    """What differs between a release and its manifest, file by file; nothing if all is as it was frozen."""
    return _differences(read_manifest(spark, path), {"files": _listed(spark, path)})


def read_release(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a release, after a check of all of its files."""
    wrong = verify(spark, path)
    if wrong:
        raise BrokenRelease(f"{path} isn't as it was frozen: {'; '.join(wrong)}")
    kind = read_manifest(spark, path)["tables"][name]["format"]
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("header", True).csv(f"{path}/{name}") if kind == "csv" else reader.json(f"{path}/{name}")
