"""The log store: Parquet by day, ordered by time inside files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import utc, whole_units

ROWS_PER_FILE = 8_000_000


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Adds rows (``_time_ns`` is their time) under the day's folder; tasks take ranges of time, so a busy hour is spread over several."""
    day = F.date_format(utc(whole_units(F.col("_time_ns"), 10**9)), "yyyy-MM-dd")
    dealt = df.withColumn("_date", day).repartitionByRange("_date", "_time_ns")
    dealt.sortWithinPartitions("_date", "_time_ns").write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").partitionBy("_date").parquet(path)


def read(spark: SparkSession, path: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """The rows of [from, to): whole days are left out by folder, rows by the time column's statistics."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    df = df.withColumn("_date", F.col("_date").cast("string"))
    if from_ns is not None:
        df = df.where((F.col("_date") >= _day(from_ns)) & (F.col("_time_ns") >= from_ns))
    if to_ns is not None:
        df = df.where((F.col("_date") <= _day(to_ns)) & (F.col("_time_ns") < to_ns))
    return df.drop("_date")


def _day(ns: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=ns // 10**9)).strftime("%Y-%m-%d")


def _days(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, sorted((s.getPath().getName().split("=", 1)[1], s.getPath()) for s in files.listStatus(target) if s.getPath().getName().startswith("_date="))


def retain(spark: SparkSession, path: str, cutoff_ns: int) -> list[str]:
    """Deletes the days that end at or before the cutoff; gives their names."""
    files, days = _days(spark, path)
    gone = [(d, p) for d, p in days if d < _day(cutoff_ns)]
    for _, p in gone:
        files.delete(p, True)
    return [d for d, _ in gone]


def demote(spark: SparkSession, path: str, cold: str, cutoff_ns: int) -> list[str]:
    """Moves the days before the cutoff to another folder; ``promote`` is the same the other way."""
    files, days = _days(spark, path)
    moved = [(d, p) for d, p in days if d < _day(cutoff_ns)]
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(cold))
    for d, p in moved:
        if not files.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{cold}/_date={d}")):
            raise OSError(f"cannot move {d}")
    return [d for d, _ in moved]


def promote(spark: SparkSession, cold: str, path: str) -> list[str]:
    return demote(spark, cold, path, 1 << 62)


def retain_streams(spark: SparkSession, path: str, cutoffs: dict[str, int]) -> list[str]:
    """Drops the rows of each stream (by its label) before the stream's cutoff; whole days are rewritten beside the old ones and then take their place."""
    files, days = _days(spark, path)
    last = max(cutoffs.values(), default=0)
    changed = []
    for day, place in days:
        if day > _day(last):
            continue
        df = spark.read.parquet(place.toString())
        gone = F.lit(False)
        for label, cutoff in cutoffs.items():
            gone = gone | ((F.coalesce(F.col("_stream"), F.lit("")) == label) & (F.col("_time_ns") < cutoff))
        if df.where(gone).isEmpty():
            continue
        _rewrite(spark, files, place, df.where(~gone))
        changed.append(day)
    return changed


def recompact(spark: SparkSession, path: str, cutoff_ns: int, files_of_day: int = 1) -> list[str]:
    """Rewrites the days before the cutoff in few files, ordered by time, at a high compression level."""
    files, days = _days(spark, path)
    done = [(d, p) for d, p in days if d < _day(cutoff_ns)]
    for _, place in done:
        df = spark.read.option("mergeSchema", "true").parquet(place.toString())
        _rewrite(spark, files, place, df.repartitionByRange(files_of_day, "_time_ns").sortWithinPartitions("_time_ns"))
    return [d for d, _ in done]


def _rewrite(spark: SparkSession, files, place, df: DataFrame) -> None:
    made = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".new-{place.getName()}")
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "19").parquet(made.toString())
    files.delete(place, True)
    if not files.rename(made, place):
        raise OSError(f"cannot replace {place}")


def restore(spark: SparkSession, backup_path: str, path: str) -> None:
    """Puts a backup's rows into a store that doesn't exist yet."""
    df = spark.read.option("mergeSchema", "true").parquet(backup_path)
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy("_date").parquet(path)


def backup(spark: SparkSession, path: str, to: str) -> None:
    """A copy of the rows as they are now; ``restore`` puts them back."""
    spark.read.option("mergeSchema", "true").parquet(path).write.partitionBy("_date").parquet(to)
