"""Readers of log wire formats.

Each reader turns lines (or bodies, one in ``value``) into records: ``_time_ns`` (null where none was given) and
``fields``, a map of text.  ``load`` makes records into columns.  Lines that hold no record are dropped; ``skipped``
counts them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import stream_label
from tidelog.operators.pipes import RFC3164, RFC5424, logfmt_map

#: Names of syslog severities by number: fixed values of RFC 5424.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file."""
    return spark.read.text(path, wholetext=True)


def parse_time(c: Column) -> Column:
    """Nanoseconds of a text: signed digits are nanoseconds, else a date and time with up to nine decimals."""
    fraction = F.rpad(F.regexp_extract(c, r"\.(\d{1,9})", 1), 9, "0").try_cast("bigint")
    # a time without a zone is UTC, whatever the session's zone
    bare = F.regexp_replace(c, r"\.\d+", "")
    zoned = F.when(bare.rlike(r"(Z|[+-]\d\d:\d\d)$") & bare.contains(":"), bare).when(bare.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(bare, F.lit("T00:00:00Z"))).otherwise(F.concat(bare, F.lit("Z")))
    whole = F.unix_seconds(zoned.try_cast("timestamp"))
    dated = F.when(c.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$"), whole * 10**9 + F.coalesce(fraction, F.lit(0)))
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint")).otherwise(dated)


def _without(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def _timed(df: DataFrame, m: Column, *names: str) -> DataFrame:
    """The first of the named fields that is a time becomes the time; one that isn't stays a field."""
    df = df.select(m.alias("fields")).where("fields is not null and size(fields) > 0")
    df = df.withColumn("_time_ns", F.coalesce(*[parse_time(F.col("fields")[n]) for n in names]))
    return df.select("_time_ns", F.when(F.col("_time_ns").isNotNull(), _without(F.col("fields"), *names)).otherwise(F.col("fields")).alias("fields"))


def _object(c: Column) -> Column:
    return F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>"))


def ndjson(df: DataFrame, time_field: str = "_time") -> DataFrame:
    """An object on each line; nested values are kept as their JSON text."""
    return _timed(df, F.map_filter(_object(F.col("value")), lambda _, v: v.isNotNull()), time_field, "@timestamp")


def logfmt(df: DataFrame, time_field: str = "_time") -> DataFrame:
    return _timed(df, logfmt_map(F.col("value")), time_field)


def bulk(df: DataFrame, time_field: str = "_time") -> DataFrame:
    """Bulk bodies: action lines, each but ``delete`` followed by its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an action line holds one of four keys; its document is the line after it
        action = re.compile(r'\s*\{\s*"(index|create|update|delete)"\s*:\s*\{')
        for batch in batches:
            for body in batch.column(0):
                kept, due = [], False
                for line in (body.as_py() or "").split("\n"):
                    if not line.strip():
                        continue
                    if due:
                        kept.append(line)
                        due = False
                    else:
                        found = action.match(line)
                        due = bool(found) and found[1] != "delete"
                yield pa.record_batch([pa.array(kept, pa.string())], names=["value"])

    return ndjson(df.select("value").mapInArrow(run, "value string"), time_field)


def loki(df: DataFrame) -> DataFrame:
    """Push bodies: streams of labels with values [nanoseconds, line]."""
    body = F.from_json("value", "struct<streams:array<struct<stream:map<string,string>,values:array<array<string>>>>>")
    rows = df.select(F.inline(body["streams"])).select("stream", F.explode("values").alias("v")).where("size(v) >= 2")
    labels = F.coalesce(_without(F.col("stream"), "_msg"), F.create_map().cast("map<string,string>"))
    return rows.select(parse_time(F.get("v", F.lit(0))).alias("_time_ns"), F.map_concat(labels, F.create_map(F.lit("_msg"), F.get("v", F.lit(1)))).alias("fields"))


def datadog(df: DataFrame) -> DataFrame:
    """An array of objects or one object; ``ddtags`` become fields, times are milliseconds."""
    c = F.trim("value")
    many = F.when(c.startswith("["), F.from_json(c, "array<map<string,string>>")).otherwise(F.array(_object(c)))
    m = F.map_filter(F.col("m"), lambda _, v: v.isNotNull())
    tags = F.filter(F.split(F.coalesce(m["ddtags"], F.lit("")), ","), lambda x: x.contains(":"))
    entries = F.transform(tags, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.substr(x, F.instr(x, ":") + 1).alias("value")))
    own = F.transform(F.map_entries(_without(m, "ddtags", "timestamp", "date", "message")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    text = F.when(m["message"].isNotNull(), F.array(F.struct(F.lit("_msg").alias("key"), m["message"].alias("value")))).otherwise(F.array())
    stamp = F.coalesce(m["timestamp"], m["date"])
    ns = F.when(stamp.rlike(r"^\d+(\.\d+)?$"), (stamp.try_cast("double").cast("bigint") * 10**6)).otherwise(parse_time(stamp))
    rows = df.select(F.explode(many).alias("m")).where("m is not null")
    return rows.select(ns.alias("_time_ns"), _from_entries(F.concat(entries, own, text)).alias("fields"))


def _from_entries(entries: Column) -> Column:
    """A map in which of equal keys the last wins."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
_OTLP = f"""struct<resourceLogs:array<struct<resource:struct<attributes:array<struct<key:string,value:{_VALUE}>>>,scopeLogs:array<struct<logRecords:array<struct<
timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:{_VALUE},attributes:array<struct<key:string,value:{_VALUE}>>>>>>>>>""".replace("\n", "")


def otlp_json(df: DataFrame) -> DataFrame:
    """Resource and record attributes become fields; the record's win."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"], F.lit(""))
    pairs = lambda c: F.coalesce(F.transform(c, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value"))), F.array())
    one = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.struct(F.lit(name).alias("key"), c.alias("value")))).otherwise(F.array())
    rows = df.select(F.inline(F.from_json("value", _OTLP)["resourceLogs"])).select("resource", F.explode("scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("r"))
    r = F.col("r")
    ns = F.coalesce(F.nullif(r["timeUnixNano"].try_cast("bigint"), F.lit(0)), r["observedTimeUnixNano"].try_cast("bigint"))
    entries = F.concat(pairs(F.col("resource")["attributes"]), pairs(r["attributes"]), one("severity", r["severityText"]), one("_msg", value(r["body"])))
    return rows.select(ns.alias("_time_ns"), _from_entries(entries).alias("fields"))


def syslog(df: DataFrame, year: int) -> DataFrame:
    """Both syslog formats; another line is kept as text.  The older format has no year: ``year`` is taken, in UTC."""
    c = F.col("value")
    new, old = c.rlike(RFC5424), c.rlike(RFC3164)
    both = lambda x, y: F.when(new, F.regexp_extract(c, RFC5424, x)).when(old, F.regexp_extract(c, RFC3164, y) if y else F.lit(""))
    pri = both(1, 1).try_cast("int")
    stamp = F.regexp_replace(F.regexp_extract(c, RFC3164, 2), " +", " ")
    older = F.unix_micros(F.try_to_timestamp(F.concat(F.lit(f"{year} "), stamp, F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss xx"))) * 1000
    named = {
        "facility": F.floor(pri / 8).cast("string"), "severity": F.element_at(F.array(*map(F.lit, SEVERITIES)), pri % 8 + 1), "hostname": both(4, 3), "app_name": both(5, 4),
        "proc_id": both(6, 5), "msg_id": both(7, 0), "structured_data": both(8, 0), "_msg": F.coalesce(both(9, 6), c),
    }
    m = F.create_map(*[x for n, v in named.items() for x in (F.lit(n), v)])
    rows = df.where(F.trim("value") != "")
    return rows.select(F.when(new, parse_time(F.regexp_extract(c, RFC5424, 3))).when(old, older).alias("_time_ns"), F.map_filter(m, lambda _, v: v.isNotNull() & ~v.isin("", "-")).alias("fields"))


_RECORDS = "_time_ns long, fields map<string,string>"


def _journal(data: bytes) -> Iterator[tuple[int | None, dict]]:
    at, entry = 0, {}
    while at <= len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        after = end + 1 if end >= 0 else len(data) + 1
        if not line:
            if entry:
                stamp = entry.pop("__REALTIME_TIMESTAMP", "")
                message = entry.pop("MESSAGE", None)
                fields = {k.lstrip("_").lower(): v for k, v in entry.items()}
                yield (int(stamp) * 1000 if stamp.isdigit() else None), fields | ({} if message is None else {"_msg": message})
            entry = {}
        elif b"=" in line:
            name, value = line.split(b"=", 1)
            entry[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        else:
            # a binary field: its name, eight bytes of length, the value, a newline
            size = int.from_bytes(data[after : after + 8], "little")
            if after + 8 + size > len(data):
                return
            entry[line.decode("utf-8", "replace")] = data[after + 8 : after + 8 + size].decode("utf-8", "replace")
            after += 8 + size + 1
        at = after


def _framed(df: DataFrame, column: str, decode) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                found = list(decode(data.as_py() or b""))
                yield pa.record_batch([pa.array([t for t, _ in found], pa.int64()), pa.array([list(f.items()) for _, f in found], kind)], names=["_time_ns", "fields"])

    return df.select(F.col(column).cast("binary")).mapInArrow(run, _RECORDS)


def journald(spark: SparkSession, path: str) -> DataFrame:
    """Export files; their length-prefixed fields can't be split by line, so a file is read in one piece."""
    return _framed(spark.read.format("binaryFile").load(path), "content", _journal)


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""

    def varint(at):
        value = shift = 0
        while at < len(data):
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at
        return None, at

    at = 0
    while at < len(data):
        # a message that ends too early is read as far as it goes
        tag, at = varint(at)
        if tag is None:
            return
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
            if value is None:
                return
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            if size is None or at + size > len(data):
                return
            value, at = data[at : at + size], at + size
        else:
            return
        if at > len(data):
            return
        yield tag >> 3, value


def _any_value(data: bytes) -> str:
    import struct

    for number, value in _wire(data):
        if number == 1:
            return value.decode("utf-8", "replace")
        if number == 2:
            return "true" if value else "false"
        if number == 3:
            return str(value - (1 << 64) if value >> 63 else value)
        if number == 4:
            return repr(struct.unpack("<d", value)[0])
    return ""


def _attribute(data: bytes) -> tuple[str, str]:
    parts = dict(_wire(data))
    return parts.get(1, b"").decode("utf-8", "replace"), _any_value(parts.get(2, b""))


def _otlp(data: bytes) -> Iterator[tuple[int | None, dict]]:
    for _, resource_logs in (x for x in _wire(data) if x[0] == 1):
        parts = list(_wire(resource_logs))
        shared = dict(_attribute(a) for n, r in parts if n == 1 for m, a in _wire(r) if m == 1)
        for record in (r for n, s in parts if n == 2 for m, r in _wire(s) if m == 2):
            fields, ns, observed = dict(shared), 0, 0
            for number, value in _wire(record):
                if number == 1:
                    ns = int.from_bytes(value, "little")
                elif number == 11:
                    observed = int.from_bytes(value, "little")
                elif number == 3 and value:
                    fields["severity"] = value.decode("utf-8", "replace")
                elif number == 5:
                    fields["_msg"] = _any_value(value)
                elif number == 6:
                    key, text = _attribute(value)
                    fields[key] = text
            yield (ns or observed or None), fields


def otlp_protobuf(df: DataFrame, column: str = "content") -> DataFrame:
    """The same records from the binary encoding, a message in each row."""
    return _framed(df, column, _otlp)


def load(records: DataFrame, names: list[str], fallback_ns: int | None = None, msg_field: str | None = None, ignore: tuple = (), extra: dict | None = None, stream_fields: tuple = ()) -> DataFrame:
    """Records as columns ``_time_ns``, the named fields and ``_stream``; other fields stay in the hidden map."""
    m = F.col("fields")
    if msg_field:
        moved = F.when(m[msg_field].isNotNull(), F.map_concat(_without(m, msg_field, "_msg"), F.create_map(F.lit("_msg"), m[msg_field]))).otherwise(m)
        records = records.withColumn("fields", moved)
    if ignore:
        records = records.withColumn("fields", _without(m, *ignore))
    if extra:
        records = records.withColumn("fields", F.map_concat(_without(m, *extra), F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])))
    time = F.coalesce("_time_ns", F.lit(fallback_ns).cast("bigint"))
    out = records.select(time.alias("_time_ns"), *[m[n].alias(n) for n in names], _without(m, *names).alias("_extra") if names else m.alias("_extra"), m.alias("__m"))
    if stream_fields:
        out = out.withColumn("_stream", stream_label(tuple(stream_fields), lambda n: F.coalesce(F.col("__m")[n], F.lit(""))))
    return out.drop("__m")


def skipped(df: DataFrame, records: DataFrame) -> int:
    return df.count() - records.count()
