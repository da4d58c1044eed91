"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
            found = context._jsc.sc().getCheckpointDir().get()
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def unused(taken: list[str], *names: str) -> list[str]:
    """Column names that no column of the input has (names are compared as Spark does, without case)."""
    held = {n.lower() for n in taken}
    out = []
    for name in names:
        made = f"_{name}"
        while made.lower() in held:
            made = f"_{made}"
        held.add(made.lower())
        out.append(made)
    return out


class Scratch:
    """Tables written once and read again; a lost executor never forces more than a reread.

    ``keep`` cuts the lineage of a DataFrame, ``finish`` does so for a result and removes what was
    kept before it.  Whatever remains goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self._fs("deleteOnExit", self.root)

    def _fs(self, method: str, path: str, *args) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        getattr(files, method)(target, *args)

    def path(self, label: str) -> str:
        made = f"{self.root}/{len(self.paths):03d}-{label}"
        self.paths.append(made)
        return made

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        for path in [p for p in self.paths if p not in keep]:
            self._fs("delete", path, True)
            self.paths.remove(path)

    def finish(self, df: DataFrame, label: str = "result") -> DataFrame:
        out = self.keep(df, label)
        self.drop(self.paths[-1])
        return out
