"""Time-bucketed counts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.predicates import within
from tidelog.log import Log
from tidelog.operators.aggregates import stats
from tidelog.plans.language import ParseError, Query

MAX_BUCKETS = 100_000


def histogram(log: Log, step_ns: int) -> DataFrame:
    """bucket_ns, hits of the buckets that have rows."""
    ns = log.ns()
    return log.df.groupBy((ns - F.pmod(ns, F.lit(step_ns))).alias("bucket_ns")).agg(F.count(F.lit(1)).alias("hits"))


def hits(log: Log, step_ns: int, by: str | None = None, fields_limit: int | None = None) -> DataFrame:
    """bucket_ns, hits (and the field's value) with the empty buckets, from the window's start or the first row."""
    low, high = log.window
    if low is None or high is None:
        first, last = log.df.agg(F.min(log.ns()), F.max(log.ns())).first()
        if first is None:
            return log.df.select(*([log.key(by).alias(by)] if by else []), F.lit(0).cast("bigint").alias("bucket_ns"), F.lit(0).cast("bigint").alias("hits")).limit(0)
        low, high = first if low is None else low, last + 1 if high is None else high
    start = low - low % step_ns
    count = -(-(high - start) // step_ns)
    if count > MAX_BUCKETS:
        raise ValueError(f"{count} buckets are more than {MAX_BUCKETS}")
    keys = [log.key(by).alias(by)] if by else []
    ns = log.ns()
    found = log.df.where(within(log, low, high)).groupBy(*keys, (ns - F.pmod(ns, F.lit(step_ns))).alias("bucket_ns")).agg(F.count(F.lit(1)).alias("hits"))
    if by and fields_limit:
        busiest = found.groupBy(by).agg(F.sum("hits").alias("n")).orderBy(F.desc("n"), by).limit(fields_limit)
        # fields_limit rows
        marked = found.join(F.broadcast(busiest.select(F.col(by).alias("__kept"))), F.col(by) == F.col("__kept"), "left")
        found = marked.groupBy(F.coalesce(F.col("__kept").cast("string"), F.lit("")).alias(by), "bucket_ns").agg(F.sum("hits").alias("hits"))
    spine = found.select(by).distinct() if by else log.df.sparkSession.range(1).select()
    spine = spine.select(*([by] if by else []), F.explode(F.sequence(F.lit(start), F.lit(start + (count - 1) * step_ns), F.lit(step_ns))).alias("bucket_ns")) if count > 0 else spine.withColumn("bucket_ns", F.lit(0).cast("bigint")).limit(0)
    return spine.join(found, [*([by] if by else []), "bucket_ns"], "left").select(*([by] if by else []), "bucket_ns", F.coalesce("hits", F.lit(0)).alias("hits"))


def _stats_of(query: Query):
    found = [p for p in query.pipes if p.name == "stats"]
    if len(found) != 1 or query.pipes[-1] is not found[0]:
        raise ParseError("the query must end in one stats stage")
    return found[0]


def stats_range(log: Log, query: Query, step_ns: int, start_ns: int) -> DataFrame:
    """The query's statistics for each bucket from ``start_ns`` on, in one grouping; empty buckets are absent."""
    from tidelog.plans.compiler import run

    node = _stats_of(query)
    left = run(log, Query(query.filter, query.pipes[:-1]))
    ns = left.ns()
    bucket = F.lit(start_ns) + (ns - F.lit(start_ns) - F.pmod(ns - F.lit(start_ns), F.lit(step_ns)))
    return stats(left, node.args["by"], node.args["aggs"], step_ns / 1e9, {"bucket_ns": bucket})


def stats_instant(log: Log, query: Query) -> DataFrame:
    """name, labels, value: a sample for each group and aggregate."""
    from tidelog.plans.compiler import run

    node = _stats_of(query)
    out = run(log, query).df
    by = node.args["by"]
    labels = F.create_map(*[x for b in by for x in (F.lit(b), F.col(f"`{b}`").cast("string"))]) if by else F.create_map().cast("map<string,string>")
    items = F.array(*[F.struct(F.lit(a.alias).alias("name"), F.col(f"`{a.alias}`").cast("string").alias("value")) for a in node.args["aggs"]])
    return out.select(labels.alias("labels"), F.inline(items)).select("name", "labels", "value")
