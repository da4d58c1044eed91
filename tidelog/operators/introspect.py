"""What a log holds: its fields, their values, its streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import fnv1a64, stream_label
from tidelog.log import EXTRA, Log

MAX_FACET_VALUES = 1000


def stream_text(log: Log) -> Column:
    return log.text("_stream") if log.has("_stream") else stream_label(log.stream, log.text)


def stream_id(log: Log) -> Column:
    return fnv1a64(stream_text(log))


def _fields(log: Log, names: list[str] | None = None, time: bool = False) -> list[str]:
    return names or [n for n, t in log.df.dtypes if n != EXTRA and (time or n != log.time) and not t.startswith(("array", "map", "struct"))]


def _pairs(log: Log, names: list[str]) -> DataFrame:
    """A row (field, value) for each non-empty field of each row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), log.text(n).alias("value")) for n in names])
    if log.has(EXTRA):
        more = F.transform(F.map_entries(EXTRA), lambda e: F.struct(e["key"].alias("field"), F.coalesce(e["value"], F.lit("")).alias("value")))
        pairs = F.concat(pairs, F.coalesce(more, F.array()))
    return log.df.select(F.inline(pairs)).where("value <> ''")


def field_names(log: Log, names: list[str] | None = None, time: bool = False) -> DataFrame:
    """name, hits: rows with a non-empty value, in one pass that has one row for each field."""
    names = _fields(log, names, time)
    if log.has(EXTRA):
        return _pairs(log, names).groupBy(F.col("field").alias("name")).agg(F.count(F.lit(1)).alias("hits"))
    counts = log.df.agg(*[F.count_if(log.text(n) != "").alias(f"c{k}") for k, n in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{k}").alias("hits")) for k, n in enumerate(names)]))).where("hits > 0")


def field_values(log: Log, name: str, limit: int | None = None) -> DataFrame:
    counts = log.df.groupBy(log.key(name).alias("value")).agg(F.count(F.lit(1)).alias("hits"))
    return counts.orderBy(F.desc("hits"), F.col("value").cast("string")).limit(limit) if limit else counts


def facets(log: Log, limit: int = 10, names: list[str] | None = None, max_values: int | None = None, keep_const: bool = True) -> DataFrame:
    """field, value, hits: the most frequent values of each field."""
    counts = _pairs(log, _fields(log, names)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("hits"))
    if max_values or not keep_const:
        each = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
        each = each.where(F.col("n").between(1 if keep_const else 2, max_values or (1 << 62)))
        # as many rows as the log has fields
        counts = counts.join(each.select("field"), "field", "left_semi")
    best = Window.partitionBy("field").orderBy(F.desc("hits"), "value")
    return counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).drop("r")


def streams(log: Log) -> DataFrame:
    return log.df.groupBy(stream_text(log).alias("value")).agg(F.count(F.lit(1)).alias("hits"))


def stream_ids(log: Log) -> DataFrame:
    return streams(log).select(fnv1a64(F.col("value")).alias("value"), "hits")


def _labels(log: Log) -> DataFrame:
    names = F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), 1)
    values = F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), 2)
    return streams(log).select(F.inline(F.arrays_zip(names.alias("n"), values.alias("v"))), "hits").toDF("name", "value", "hits")


def stream_field_names(log: Log) -> DataFrame:
    return _labels(log).groupBy(F.col("name").alias("value")).agg(F.sum("hits").alias("hits"))


def stream_field_values(log: Log, name: str) -> DataFrame:
    return _labels(log).where(F.col("name") == name).groupBy("value").agg(F.sum("hits").alias("hits"))


def block_stats(log: Log) -> DataFrame:
    """file, rows of each file that the filter leaves rows in."""
    return log.df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def blocks_count(log: Log) -> DataFrame:
    return block_stats(log).agg(F.count(F.lit(1)).alias("blocks_count"))
