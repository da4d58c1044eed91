import json
import re
import time
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.log import Log
from tidelog.operators import numbering
from tidelog.plans.compiler import query, run
from tidelog.sources import formats, store
from tidelog.streaming import tail
from tidelog import wire


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
    return f"{h:x}"


def logs(spark, rows, columns="_time_ns long, _msg string, a string, b string"):
    return Log(spark.createDataFrame(rows, columns), time="_time_ns", order=("_time_ns",))


ROWS = [(1, "one", "x", "5"), (2, None, "", None), (3, "three 33", "y", "nope"), (4, "user=7 s=\"a b\"", "x", "10")]


def test_missing_is_empty(spark):
    log = logs(spark, ROWS)
    got = lambda text: [r[0] for r in query(log, text).orderBy("_time_ns").collect()]
    assert got('b:=""') == [2]
    assert got("NOT a:=x") == [2, 3]
    assert got("b:>4") == [1, 4]
    assert got("b:lt_field(a)") == [1, 3, 4]
    assert got("nosuch:=x") == []
    assert got("a:=x OR _msg:*33*") == [1, 3, 4]


def test_hash_and_math(spark):
    texts = ["", "a", "héllo", "x" * 50]
    out = query(logs(spark, [(k, t, None, None) for k, t in enumerate(texts)]), "* | hash(_msg) as h | math b / 0 + 2 as m").orderBy("_time_ns").collect()
    assert [r.h for r in out] == [fnv(t) for t in texts]
    assert [r.m for r in out] == [2.0] * 4


def test_positions(spark):
    log = logs(spark, [(k, f"m{k}", str(k % 3), str(k)) for k in range(100)])
    assert [r[0] for r in query(log, "* | fields _time_ns | tail 3").collect()] == [97, 98, 99]
    assert [r[0] for r in query(log, "* | sample 25 | fields b").orderBy(F.col("b").cast("int")).collect()] == ["0", "25", "50", "75"]
    assert sorted(int(r.b) for r in query(log, "b:=50 OR b:=0 | stream_context before 2 after 1").collect()) == [0, 1, 48, 49, 50, 51]
    assert [r.b for r in query(log, "* | sort by (b) desc | offset 1 | limit 2").collect()] == ["98", "97"]


def test_unpack(spark):
    log = logs(spark, ROWS)
    assert query(log, "* | unpack_logfmt | filter user:=7 | fields user, s").first().asDict() == {"user": "7", "s": "a b"}
    log = logs(spark, [(1, "<165>1 2003-10-11T22:14:15.003Z host app 12 ID47 - hello", None, None), (2, "<34>Oct 11 22:14:15 box su[9]: failed", None, None)])
    out = query(log, "* | unpack_syslog | fields severity, hostname, app_name, proc_id, message").collect()
    assert sorted(map(tuple, out)) == [("2", "box", "su", "9", "failed"), ("5", "host", "app", "12", "hello")]


def test_empty_global_aggregate_has_no_row(spark):
    assert query(logs(spark, ROWS), "a:=none | stats count() n").count() == 0


def test_formats(spark):
    one = lambda df: [(r[0], dict(r[1])) for r in df.collect()]
    text = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    assert one(formats.ndjson(text('{"_time":"2024-01-01T00:00:00.000000001Z","a":"x","n":12345678901234567890}', "bad", "[1]"))) == [(1704067200000000001, {"a": "x", "n": "12345678901234567890"})]
    assert one(formats.ndjson(text('{"_time":"soon","a":true}'))) == [(None, {"_time": "soon", "a": "true"})]
    assert one(formats.logfmt(text('_time=5 a="b c" d=e'))) == [(5, {"a": "b c", "d": "e"})]
    assert one(formats.bulk(text('{"create":{}}\n{"_time":"7","a":"1"}\n{"delete":{"_id":"3"}}\n{"index":{}}\n{"index":{"x":1}}\n'))) [0] == (7, {"a": "1"})
    assert one(formats.loki(text('{"streams":[{"stream":{"app":"x"},"values":[["9","line"],["1"]]}]}'))) == [(9, {"app": "x", "_msg": "line"})]
    assert one(formats.datadog(text('[{"message":"m","ddtags":"env:dev,v:a:b","timestamp":3}]'))) == [(3000000, {"env": "dev", "v": "a:b", "_msg": "m"})]
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "s", "value": {"stringValue": "r"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "8", "severityText": "WARN", "body": {"stringValue": "b"}, "attributes": [{"key": "s", "value": {"intValue": "4"}}]}]}]}]}
    assert one(formats.otlp_json(text(json.dumps(body)))) == [(8, {"s": "4", "severity": "WARN", "_msg": "b"})]
    got = one(formats.syslog(text("<165>1 2003-10-11T22:14:15.003Z host app - - - hi", "just text"), 2024))
    assert got[0][1]["severity"] == "notice" and got[1] == (None, {"_msg": "just text"})


def test_journald_and_protobuf(spark, tmp_path):
    (tmp_path / "a.export").write_bytes(b"__REALTIME_TIMESTAMP=5\nMESSAGE\n" + (3).to_bytes(8, "little") + b"a\nb\n_PID=1\n\nMESSAGE=x\n")
    got = formats.journald(spark, str(tmp_path / "a.export")).collect()
    assert [(r[0], dict(r[1])) for r in got] == [(5000, {"pid": "1", "_msg": "a\nb"}), (None, {"_msg": "x"})]

    def part(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    attribute = lambda k, v: part(1, k) + part(2, part(1, v))
    record = bytes([1 << 3 | 1]) + (8).to_bytes(8, "little") + part(3, b"WARN") + part(5, part(1, b"b")) + part(6, attribute(b"s", b"4"))
    data = part(1, part(1, part(1, attribute(b"s", b"r"))) + part(2, part(2, record)))
    got = formats.otlp_protobuf(spark.createDataFrame([(bytearray(data),)], "content binary")).collect()
    assert [(r[0], dict(r[1])) for r in got] == [(8, {"s": "4", "severity": "WARN", "_msg": "b"})]


def test_store_and_tail(spark, tmp_path):
    day = 86400 * 10**9
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(k * day // 2, f"m{k}") for k in range(6)], "_time_ns long, _msg string")
    store.write(df, path)
    assert store.read(spark, path, day, 2 * day).count() == 2
    stream = tail.tail(spark, path, "_time_ns long, _msg string, _date string", "_msg:=m3 OR _msg:=m5").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r[0] for r in spark.sql("select _msg from tailed").collect()) == ["m3", "m5"]
    assert store.demote(spark, path, str(tmp_path / "cold"), day) == ["1970-01-01"]
    assert store.read(spark, path).count() == 4
    assert store.promote(spark, str(tmp_path / "cold"), path) == ["1970-01-01"]
    assert store.retain(spark, path, 2 * day) == ["1970-01-01", "1970-01-02"]
    assert tail.alert(logs(spark, ROWS), "r", "a:=x", ">", 1) == {"name": "r", "firing": True, "value": 2, "op": ">", "threshold": 1}


def test_wire(spark):
    out = [json.loads(r[0]) for r in wire.ndjson(run(logs(spark, ROWS), "a:=y")).collect()]
    assert out == [{"_time": "1970-01-01T00:00:00.000000003Z", "_msg": "three 33", "a": "y", "b": "nope"}]


def test_text_of_numbers(spark):
    # shortest digits, an exponent below 1e-4 and from 1e6 on
    shown = {2.0: "2", 0.1: "0.1", 1e7: "1e+07", 999999.5: "999999.5", 1234567.5: "1.2345675e+06", 1e-4: "0.0001", 1.5e-12: "1.5e-12", -3.25: "-3.25", 0.0: "0", 1e100: "1e+100", 100000.0: "100000"}
    df = spark.createDataFrame([(v, t) for v, t in shown.items()], "v double, t string")
    got = query(Log(df, order=("v",)), '* | format "<v>" as k').collect()
    assert [r.k for r in got] == [r.t for r in got]


def test_logfmt_values(spark):
    lines = ['a=1 flag b="q\\"z" c= d', "=x k=v k=w", 'open="never closed', "\t t=1\tu=2"]
    got = [dict(r.fields) for r in formats.logfmt(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [{"a": "1", "flag": "", "b": 'q"z', "c": "", "d": ""}, {"k": "w"}, {"open": "never closed"}, {"t": "1", "u": "2"}]


def test_regexp_sets(spark):
    log = logs(spark, [(1, "abc", "x", "1"), (2, "12", "x", "1"), (3, "d:", "x", "1"), (4, "a[b", "x", "1"), (5, "p+q", "x", "1")])
    got = lambda text: sorted(r[0] for r in query(log, text).collect())
    assert got('_msg:~"[[:digit:]]+"') == [2]
    assert got('_msg:~"^[[:alpha:]]+$"') == [1]
    assert got('_msg:~"[[:^alpha:]]"') == [2, 3, 4, 5]
    assert got('_msg:~"[[&&]"') == [4]
    assert got(r'_msg:~"p\\Q+\\Eq"') == [5]


def test_unpack_json_keeps_spelling(spark):
    log = logs(spark, [(1, '{"a":1.50,"b":"x: 2, y","c":[1,2.0],"d":-1e3}', "", "")])
    assert query(log, "* | unpack_json | fields a, b, d").first().asDict() == {"a": "1.50", "b": "x: 2, y", "d": "-1e3"}


def test_truncated_message(spark):
    # a record whole, then a length that reaches past the end
    whole = bytes([10, 10, 18, 8, 18, 6, 42, 4, 10, 2, 104, 105])
    df = spark.createDataFrame([(bytearray(whole + bytes([10, 200])),), (bytearray(whole),), (bytearray(b"\x0a"),)], "content binary")
    assert [r.fields for r in formats.otlp_protobuf(df).collect()] == [{"_msg": "hi"}] * 2


def test_other_zone(spark):
    from tidelog import queries

    names = ["time_day", "time_range", "time_day_range", "time_week_range", "stats_range", "hits_dense", "ingest_syslog", "ndjson_rows", "request_window"]
    rows = lambda n: sorted(map(str, queries.queries()[n](spark, "/root/testdata/sf0.001").collect()))
    wanted = {n: rows(n) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for n in names:
            assert rows(n) == wanted[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_window_reaches_the_scan(spark):
    from tidelog import queries
    from tidelog.operators import series

    log = queries.log(spark, "/root/testdata/sf0.001", "events", window=queries.JANUARY)
    for df in (query(log, "* | stats count() n"), series.hits(log, queries.DAY)):
        plan = df._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_metrics_text():
    assert wire.metrics({"rows": ("Rows stored.", "gauge", 3)}) == "# HELP tidelog_rows Rows stored.\n# TYPE tidelog_rows gauge\ntidelog_rows 3\n"


def _times(spark, rows):
    df = spark.range(0, rows, 1, 1).select(F.col("id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 3)").alias("ts"), F.lit("x").alias("kind"))
    return Log(df, time="ts", order=("ts", "id"))


def test_context_looks_up_ranges_by_search(spark):
    # a row's range takes some comparisons, not one with each bound; a match without a time is found too
    began = time.monotonic()
    assert sorted(r.id for r in query(_times(spark, 150_000), "id:=0 OR id:=75000 | stream_context before 2 after 1").collect()) == [0, 1, 74998, 74999, 75000, 75001]
    assert time.monotonic() - began < 30
    log = logs(spark, [(None, "none", "x", "0"), (1, "one", "x", "1"), (2, "two", "x", "2"), (3, "three", "x", "3")])
    assert sorted(r.b for r in query(log, "b:=0 | stream_context before 1 after 1").collect()) == ["0", "1"]


def test_sample_over_a_time_that_repeats(spark):
    # ranges are parted by the order's second key too where the first is the same
    df = spark.range(0, 100_000, 1, 1).select(F.col("id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 50000)").alias("ts"))
    began = time.monotonic()
    assert sorted(r.id for r in query(Log(df, time="ts", order=("ts", "id")), "* | sample 1000").collect()) == list(range(0, 100_000, 1000))
    assert time.monotonic() - began < 30
    assert _tasks_with_rows(spark, Log(df.where("id < 50000").repartition(4), time="ts", order=("ts", "id")), "* | sample 1") > 3


def test_ranges_are_found_by_compiled_steps(spark):
    # a lambda is interpreted for each row and bound; and a query with 256 bounds is built without a column for each
    df = spark.range(0, 30_000, 1, 1).select(F.col("id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 50)").alias("ts"))
    found = query(Log(df, time="ts", order=("ts", "id")), "* | sample 10000")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in found.collect()) == [0, 10_000, 20_000]


def test_ranges_of_five_keys_fit_a_compiled_method(spark):
    # the JVM compiles no method of 8000 bytes or more
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 3000, 1, 1).select(F.col("id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
        found = query(Log(df, time="ts", order=("ts", "id")), "* | sort by (kind) desc | sample 40 | fields id")
        code = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000, sizes


def test_positions_in_orders_of_all_types(spark):
    rows = []
    for k in range(2000):
        n = k * 7919 % 2000
        text = f"\"{n:04}\\ 'é\n{chr(0x1F300 + n % 50)}\x01" if n % 9 else f"{n % 5}" * (255 + n % 5)
        rows.append((k, *(None if n % 17 == m else x for m, x in enumerate((
            datetime(1970, 1, 1) + timedelta(days=n - 1000, microseconds=n * 86_399_999_999 // 2000), (-1) ** n * 1.1**(n % 700) if n % 13 else float(("nan", "inf", "-inf")[n % 3]),
            Decimal(n - 1000) * Decimal("1e12") / 8, text, n % 2 == 0, (datetime(1900, 1, 1) + timedelta(days=n * 50)).date(), n * 3 - 3000,
        )))))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, x double, d decimal(30, 3), t string, b boolean, day date, n int").repartition(3)
    for name, down in (("ts", None), ("x", True), ("d", False), ("t", True), ("b", False), ("day", True), ("n", None)):
        log = Log(df, order=(name, "id"), ranked=() if down is None else ((F.col(name), down), (F.col("id"), not down)))
        keys = numbering._comparable(log.order_keys(), df)
        most = numbering._ranged(df, numbering._bounds(df, keys, bool(log.ranked)), keys, bool(log.ranked)).groupBy("__range").count().agg(F.max("count")).first()[0]
        # all rows were drawn; of the long texts, those with the same 256 first characters stay together
        assert most < (100 if name == "t" else 20), (name, most)
        found = numbering.numbered(log, "__n").withColumn("wanted", F.row_number().over(Window.orderBy(*log.order_columns())) - 1)
        assert found.where("__n <> wanted or __n is null").count() == 0, name


def test_sort_by_few_texts_is_parted(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.col("id"), F.element_at(F.array(*map(F.lit, ("view", "error"))), (F.col("id") % 2 + 1).cast("int")).alias("kind"))
    log = Log(df, order=("id",))
    assert sorted(r.id for r in query(log, "* | sort by (kind) | sample 4000").collect()) == [1, 4000, 8001, 12000, 16001]
    assert _tasks_with_rows(spark, log, "* | sort by (kind) | sample 1") > 3
    assert "Sort [" not in query(log, "* | sort by (kind) | sample 4")._jdf.queryExecution().optimizedPlan().toString()


def _tasks_with_rows(spark, log, text):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return query(log, text).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_offset_gathers_no_whole_table(spark):
    log = logs(spark, [(k, f"m{k}", str(k % 3), str(k)) for k in range(100)])
    for text, wanted in (
        ("* | sort by (_time_ns) | offset 10 | limit 3", [10, 11, 12]),
        ("* | sort by (a) desc | offset 2 | fields _time_ns | limit 2", [8, 11]),
        ("* | offset 98 | limit 5", [98, 99]),
        ("* | sort by (_time_ns) desc | offset 90 | filter a:=0 | limit 2", [9, 6]),
        ("* | offset 3 | offset 4 | limit 1", [7]),
        ("* | offset 90 | tail 2", [98, 99]),
        ("* | offset 5 | limit 0", []),
        ("* | sort by (_time_ns) | offset 10 | limit 1000000", list(range(10, 100))),
    ):
        found = query(log, text)
        assert [r[0] for r in found.select("_time_ns").collect()] == wanted, text
        assert "SinglePartition" not in found._jdf.queryExecution().sparkPlan().toString(), text
        assert "GlobalLimit" not in found._jdf.queryExecution().sparkPlan().toString(), text
