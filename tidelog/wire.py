"""Results as the response texts of a log server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import number_text, utc, whole_units
from tidelog.log import EXTRA, Log


def rfc3339(ns: Column) -> Column:
    """Nanoseconds as UTC text without trailing zeros of the fraction; whatever the session's zone."""
    whole = F.date_format(utc(whole_units(ns, 10**9)), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), "0+$", "")
    return F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def ndjson(log: Log) -> DataFrame:
    """A line of JSON for each row: the time first, then every value as text; empty fields are left out."""
    kinds = log.types
    names = [n for n in log.df.columns if n not in (EXTRA, log.time)]
    text = lambda n: number_text(F.col(f"`{n}`")) if kinds[n] in ("float", "double") else F.col(f"`{n}`").cast("string")
    columns = [F.nullif(text(n), F.lit("")).alias(n) for n in names]
    if log.time and log.has(log.time):
        columns = [rfc3339(log.ns()).alias("_time"), *columns]
    return log.df.select(F.to_json(F.struct(*columns)).alias("value"))


def values(df: DataFrame) -> DataFrame:
    """{"values":[{"value":…,"hits":…}]} of a limited (value, hits) result."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), F.col("value").cast("string").alias("v"), "hits")))
    return df.agg(F.to_json(F.struct(F.transform(items, lambda x: F.struct(x["v"].alias("value"), x["hits"].alias("hits"))).alias("values"))).alias("value"))


def hits(df: DataFrame, by: str | None = None) -> DataFrame:
    """{"hits":[{"fields":{…},"timestamps":[…],"values":[…],"total":n}]}: a series for each value, busiest first; its buckets ascend."""
    label = F.col(f"`{by}`").cast("string") if by else F.lit("")
    own = df.select(label.alias("label"), rfc3339(F.col("bucket_ns")).alias("t"), "bucket_ns", "hits")
    # as many points as a series has buckets, as many series as the request keeps
    points = F.array_sort(F.collect_list(F.struct("bucket_ns", "t", "hits")))
    series = own.groupBy("label").agg(points.alias("p"), F.sum("hits").alias("total"))
    fields = F.when(F.col("label") != "", F.create_map(F.lit(by or ""), F.col("label"))).otherwise(F.create_map().cast("map<string,string>"))
    # maps have no order: a series is text before it is sorted
    item = F.struct((-F.col("total")).alias("o"), "label", F.to_json(F.struct(fields.alias("fields"), F.transform("p", lambda x: x["t"]).alias("timestamps"), F.transform("p", lambda x: x["hits"]).alias("values"), "total")).alias("v"))
    items = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]))
    return series.agg(F.concat(F.lit('{"hits":['), items, F.lit("]}")).alias("value"))


def _sample(labels: Column, name: Column) -> Column:
    """A sample's labels, its name among them."""
    return F.map_concat(F.create_map(F.lit("__name__"), name), labels)


def vector(df: DataFrame, at_ns: int) -> DataFrame:
    """An instant result (name, labels, value) as a vector envelope."""
    own = df.select(F.struct(_sample(F.col("labels"), F.col("name")).alias("metric"), F.array(F.lit(at_ns // 10**9).cast("string"), "value").alias("value")).alias("r"), "name", F.to_json("labels").alias("l"))
    return _envelope(own, "vector")


def matrix(df: DataFrame, by: tuple[str, ...], aggregates: tuple[str, ...]) -> DataFrame:
    """A range result (bucket_ns, the keys, the aggregates) as a matrix envelope: a series for each key and aggregate, its points ascending."""
    kinds = dict(df.dtypes)
    text = lambda n: number_text(F.col(f"`{n}`")) if kinds[n] in ("float", "double") else F.col(f"`{n}`").cast("string")
    labels = F.create_map(*[x for b in by for x in (F.lit(b), F.coalesce(text(b), F.lit("")))]) if by else F.create_map().cast("map<string,string>")
    items = F.array(*[F.struct(F.lit(n).alias("name"), text(n).alias("value")) for n in aggregates])
    rows = df.select("bucket_ns", labels.alias("labels"), F.inline(items)).withColumn("l", F.to_json("labels"))
    points = F.array_sort(F.collect_list(F.struct("bucket_ns", "value")))
    series = rows.groupBy("l", "name").agg(F.any_value("labels").alias("labels"), points.alias("p"))
    values_ = F.transform("p", lambda x: F.array(whole_units(x["bucket_ns"], 10**9).cast("string"), x["value"]))
    return _envelope(series.select(F.struct(_sample(F.col("labels"), F.col("name")).alias("metric"), values_.alias("values")).alias("r"), "name", "l"), "matrix")


def _envelope(df: DataFrame, kind: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l", "name", F.to_json("r").alias("r"))))
    # times are numbers, values are text
    body = F.regexp_replace(F.concat_ws(",", F.transform(items, lambda x: x["r"])), r'\["(-?[0-9]+)",', r"[$1,")
    return df.agg(F.concat(F.lit(f'{{"status":"success","data":{{"resultType":"{kind}","result":['), body, F.lit("]}}")).alias("value"))


def facets(df: DataFrame) -> DataFrame:
    """{"facets":[{"field_name":…,"values":[{"field_value":…,"hits":…}]}]} of a (field, value, hits) result, by field name."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "value", "hits")))
    fields = df.groupBy("field").agg(F.transform(each, lambda x: F.struct(x["value"].alias("field_value"), x["hits"].alias("hits"))).alias("values"))
    items = F.array_sort(F.collect_list(F.struct(F.col("field").alias("field_name"), "values")))
    return fields.agg(F.to_json(F.struct(items.alias("facets"))).alias("value"))


def search_hits(log: Log) -> DataFrame:
    """{"hits":{"total":{"value":n,"relation":"eq"},"hits":[{"_source":{…}}]}} of a search request's rows, in the log's order."""
    kinds = log.types
    names = [n for n in log.df.columns if n not in (EXTRA, log.time) and not n.startswith("__o")]
    stamp = [rfc3339(log.ns()).alias("@timestamp")] if log.time and log.has(log.time) else []
    source = F.struct(*stamp, *[F.nullif(log.text(n), F.lit("")).alias(n) for n in names if not kinds[n].startswith(("array", "map", "struct"))])
    order = [F.col(f"`{n}`") for n in log.order if log.has(n)]
    rows = log.df.select(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.to_json(F.struct(source.alias("_source"))).alias("row")).alias("r"))
    items = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]))
    return rows.agg(F.concat(F.lit('{"hits":{"total":{"value":'), F.count(F.lit(1)).cast("string"), F.lit(',"relation":"eq"},"hits":['), items, F.lit("]}}")).alias("value"))


def count(log: Log) -> DataFrame:
    """{"count":n}"""
    return log.df.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"))).alias("value"))


def metrics(values: dict[str, tuple[str, str, int]], prefix: str = "tidelog") -> str:
    """Counters and gauges as exposition text: name to (help, type, value)."""
    return "".join(f"# HELP {prefix}_{n} {text}\n# TYPE {prefix}_{n} {kind}\n{prefix}_{n} {value}\n" for n, (text, kind, value) in values.items())
