"""Live tail, continuous loading and rules on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidelog.functions.predicates import condition
from tidelog.functions.text import utc, whole_units
from tidelog.log import Log
from tidelog.plans.compiler import run
from tidelog.plans.language import parse

OPERATORS: dict[str, Callable[[float, float], bool]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}


def tail(spark: SparkSession, path: str, schema, text: str, from_ns: int | None = None, time: str = "_time_ns") -> DataFrame:
    """New rows of a Parquet store that a query's filter accepts; stages after the filter are left out."""
    stream = Log(spark.readStream.schema(schema).parquet(path), time=time)
    df = stream.df.where(condition(stream, parse(text).filter, top=True))
    return df.where(F.col(time) >= from_ns) if from_ns is not None else df


def ingest(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of records to a store, a day's folder each."""
    day = F.date_format(utc(whole_units(F.col("_time_ns"), 10**9)), "yyyy-MM-dd")
    return records.withColumn("_date", day).writeStream.format("parquet").partitionBy("_date").option("checkpointLocation", checkpoint).start(path)


def windowed(df: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts for each window; rows later than ``late`` behind the newest are dropped by the watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("hits"))


def rule_value(log: Log, text: str, by: str | None = None) -> DataFrame:
    """The count that a rule states, by label if one is given."""
    left = run(log, text)
    keys = [left.key(by).alias(by)] if by else []
    return left.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def alert(log: Log, name: str, text: str, op: str, threshold: float) -> dict:
    """A rule's state now."""
    value = rule_value(log, text).first()["value"]
    return {"name": name, "firing": OPERATORS[op](value, threshold), "value": value, "op": op, "threshold": threshold}
