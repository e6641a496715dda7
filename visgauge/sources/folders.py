"""Files and folders of the cluster's file system, by Hadoop's API, and tables stored in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see; a temporary one only on one
    machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that the driver and all executors see in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


class Steps:
    """The versions of a table that is made step by step, each written to the shared folder and read again, so that
    neither lineage nor what the optimizer knows of a plan grows with the steps. Only the last two are kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.number = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.number}"
        df.write.parquet(path)
        if self.number > 1:
            Folder(self.spark, self.path).delete(str(self.number - 2))
        self.number += 1
        return self.spark.read.parquet(path)


class Folder:
    """A folder, by a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def root(self) -> str:
        """The folder's path in full, as Spark names its files."""
        return self._fs.getFileStatus(self._at("")).getPath().toString()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes:
        """The bytes of a small file."""
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> bool:
        """Write a small file, whole, if there is none of that name: of several that try at once one succeeds, and the
        others get False. On a local disk, where Hadoop looks first and writes then, a link to a finished file decides."""
        if self._fs.getScheme() == "file":
            target = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(content)
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return True

    def replace(self, name: str, content: bytes) -> None:
        """Put a small file in place at once or not at all; one of the same name goes."""
        part = f".{name}.{uuid.uuid4().hex}"
        self.create(part, content)
        if self.exists(name):
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(self._at(part), self._at(name)):
            raise OSError(f"{self.path}/{name} can't be put in place")

    def rename(self, to: str) -> bool:
        """Move the folder to a path where there is none yet."""
        target = self._jvm.org.apache.hadoop.fs.Path(to)
        return not self._fs.exists(target) and self._fs.rename(self._at(""), target)

    def move(self, name: str, to: str) -> None:
        """Another name for a file of the folder."""
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} can't be moved")

    def children(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def files(self) -> dict[str, int]:
        """Sizes of all files by their paths in the folder."""
        found, walk, root = {}, self._fs.listFiles(self._at(""), True), self.root
        while walk.hasNext():
            status = walk.next()
            found[status.getPath().toString().removeprefix(root).lstrip("/")] = status.getLen()
        return found
