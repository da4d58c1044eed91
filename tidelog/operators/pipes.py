"""Stages of a query: each takes a log and its node and returns a log, all lazily."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import NUMERIC_TYPES, fnv1a64, java_regexp, java_replacement, valid_regexp
from tidelog.log import EXTRA, Log
from tidelog.operators import introspect
from tidelog.operators.aggregates import stats
from tidelog.operators.numbering import numbered
from tidelog.plans.language import And, Everything, Leaf, Not, Or, Query

#: Prefix of columns that carry the order and never reach a result.
HIDDEN = "__o"

#: First rows that one task may hold; to leave out more, rows are numbered.
FIRST_ROWS = 100_000


def _set(log: Log, name: str, value: Column) -> Log:
    return log.at(log.df.withColumn(name, value))


def _target(log: Log, args: dict, key: str = "from") -> str:
    return args.get(key) or log.msg


def _quote(text: str) -> str:
    return re.escape(text)


# projections


def fields(log: Log, a: dict, later) -> Log:
    hidden = []
    order = log.order or ((log.time,) if log.time else ())
    if later.positional and not log.ranked:
        order = [n for n in order if log.has(n)]
        hidden = [F.col(f"`{n}`").alias(f"{HIDDEN}{k}") for k, n in enumerate(order)]
    named = [log.raw(n).alias(n) for n in dict.fromkeys(a["fields"])]
    hidden += [F.col(f"`{n}`") for n in log.df.columns if n.startswith(f"{HIDDEN}s")]
    return log.at(log.df.select(*named, *hidden), order=tuple(f"{HIDDEN}{k}" for k in range(len(order))) if later.positional and not log.ranked and hidden else log.order)


def delete(log: Log, a: dict, later) -> Log:
    gone = [log.time if n == "_time" and not log.has(n) else n for n in a["fields"]]
    order = log.order or ((log.time,) if log.time else ())
    df = log.df
    if later.positional and set(gone) & set(order):
        for k, n in enumerate(order):
            df = df.withColumn(f"{HIDDEN}{k}", F.col(f"`{n}`"))
        log = log.at(df, order=tuple(f"{HIDDEN}{k}" for k in range(len(order))))
    if log.has(EXTRA):
        df = df.withColumn(EXTRA, F.map_filter(EXTRA, lambda k, _: ~k.isin(gone)))
    return log.at(df.drop(*[n for n in gone if n]))


def rename(log: Log, a: dict, later) -> Log:
    for old, new in a["pairs"]:
        if log.has(old) and old != new:
            order = tuple(new if n == old else n for n in log.order)
            log = log.at(log.df.drop(new).withColumnRenamed(old, new), order=order, time=new if log.time == old else log.time)
        elif log.has(EXTRA) and old != new:
            log = delete(_set(log, new, log.raw(old)), {"fields": [old]}, later)
    return log


def copy(log: Log, a: dict, later) -> Log:
    for old, new in a["pairs"]:
        log = _set(log, new, log.raw(old) if log.has(old) else log.text(old))
    return log


def drop_empty_fields(log: Log, a: dict, later) -> Log:
    text = [n for n, t in log.df.dtypes if t == "string"]
    df = log.df.withColumns({n: F.nullif(F.col(f"`{n}`"), F.lit("")) for n in text}) if text else log.df
    return log.at(df.withColumn(EXTRA, F.map_filter(EXTRA, lambda _, v: v != "")) if log.has(EXTRA) else df)


# filters


def keep(log: Log, node) -> Log:
    """The rows that a filter tree is true for; subqueries become semi and anti joins."""
    from tidelog.functions.predicates import condition

    if isinstance(node, Everything) or node is None:
        return log
    parts = node.parts if isinstance(node, And) else (node,)
    joins, marks = [], []

    def marked(x):
        if isinstance(x, Leaf) and x.op == "in_query":
            marks.append(x)
            return Leaf(f"__in{len(marks) - 1}", "eq", ("true",))
        if isinstance(x, And | Or):
            return type(x)(tuple(map(marked, x.parts)))
        return Not(marked(x.part)) if isinstance(x, Not) else x

    plain = []
    for part in parts:
        inner = part.part if isinstance(part, Not) else part
        if isinstance(inner, Leaf) and inner.op == "in_query":
            joins.append((inner, "left_anti" if isinstance(part, Not) else "left_semi"))
        else:
            plain.append(marked(part))
    for k, x in enumerate(marks):
        found = _values(log, x).distinct().withColumn(f"__in{k}", F.lit(True))
        log = log.at(log.df.join(found, log.text(x.name) == F.col("__value"), "left").drop("__value"))
    for part in plain:
        log = log.at(log.df.where(condition(log, part, top=True)))
    for x, how in joins:
        log = log.at(log.df.join(_values(log, x), log.text(x.name) == F.col("__value"), how))
    return log.at(log.df.drop(*[f"__in{k}" for k in range(len(marks))])) if marks else log


def _sub(log: Log, query: Query) -> Log:
    from tidelog.plans.compiler import run

    return run(log.at(log.whole, ranked=()), query)


def _values(log: Log, x: Leaf):
    sub = _sub(log, x.args[0])
    name = (x.name or log.msg) if sub.has(x.name or log.msg) else sub.df.columns[-1]
    return sub.df.select(sub.text(name).alias("__value"))


def filter(log: Log, a: dict, later) -> Log:  # noqa: A001
    return keep(log, a["filter"])


# row transforms


def format(log: Log, a: dict, later) -> Log:  # noqa: A001
    parts = [log.text(x[1:-1]) if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"(<[^<>]*>)", a["template"]))]
    return _set(log, a["as"] or log.msg, F.concat(*parts))


def extract(log: Log, a: dict, later) -> Log:
    c, bits = log.text(_target(log, a)), re.split(r"<([^<>]*)>", a["template"])
    literals, names = bits[::2], bits[1::2]
    made, before = {}, rf"(?s)\A(?>.*?{_quote(literals[0])})"
    for k, name in enumerate(names):
        after = literals[k + 1]
        own = before + (rf"(.*?)(?:{_quote(after)}|\z)" if after else r"(.*)")
        if name and name != "_":
            made[name] = F.when(c.rlike(own), F.regexp_extract(c, own, 1)).otherwise(log.text(name))
        before += rf"(?>.*?{_quote(after)})" if after else ".*"
    return log.at(log.df.withColumns(made)) if made else log


def extract_regexp(log: Log, a: dict, later) -> Log:
    c = log.text(_target(log, a))
    pattern, names = java_regexp(a["template"])
    made = {n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k)).otherwise(log.text(n)) for n, k in names.items()}
    return log.at(log.df.withColumns(made)) if made else log


def _unpacked(log: Log, found: Column, prefix: str, later) -> Log:
    """Later stages' fields become columns; the rest stays in the hidden map unless a later stage drops it."""
    df = log.df.withColumn("__found", found)
    names = [n for n in sorted(later.reads) if n.startswith(prefix)]
    made = {n: F.coalesce(F.col("__found")[n[len(prefix) :]], log.raw(n).cast("string")) for n in names}
    if later.open:
        shown = F.transform_keys("__found", lambda k, _: F.concat(F.lit(prefix), k)) if prefix else F.col("__found")
        shown = F.coalesce(shown, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        made[EXTRA] = F.map_zip_with(F.col(EXTRA), shown, lambda k, x, y: F.coalesce(y, x)) if log.has(EXTRA) else shown
        for n in log.df.columns:
            if n.startswith(prefix) and n not in made and n != EXTRA and log.type_of(n) == "string" and n not in log.order:
                made[n] = F.coalesce(F.col("__found")[n[len(prefix) :]], F.col(f"`{n}`"))
    return log.at((df.withColumns(made) if made else df).drop("__found"))


def unpack_json(log: Log, a: dict, later) -> Log:
    text = log.text(_target(log, a))
    # numbers keep their spelling; where the quotes put around them break the text, it is read as it stands
    spelled = F.regexp_replace(text, r'((?<!\\)"\s*:\s*)(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?=\s*[,}])', '$1"$2"')
    found = F.coalesce(F.from_json(spelled, "map<string,string>"), F.from_json(text, "map<string,string>"))
    return _unpacked(log, F.transform_values(found, lambda _, v: F.coalesce(v, F.lit(""))), a["prefix"], later)


def logfmt_map(c: Column) -> Column:
    """k=v and k="v" pairs, where a backslash in quotes takes the next character as it is, and keys without a value; of equal keys the last wins."""
    pair = F.lit(r'([^ \t=]+)(?:=("(?:[^"\\]|\\.)*(?:"|\\?$)|[^ \t]*))?|=("(?:[^"\\]|\\.)*(?:"|\\?$)|[^ \t]*)')
    keys = F.regexp_extract_all(c, pair, 1)
    quoted = lambda v: F.regexp_replace(F.regexp_replace(v, r'(?s)^"((?:[^"\\]|\\.)*)"?(\\?)$', "$1$2"), r"(?s)\\(.)", "$1")
    values = F.transform(F.regexp_extract_all(c, pair, 2), lambda v: F.when(v.startswith('"'), quoted(v)).otherwise(v))
    both = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(both, lambda x, i: (x["k"] != "") & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.map_from_entries(last)


def unpack_logfmt(log: Log, a: dict, later) -> Log:
    return _unpacked(log, logfmt_map(log.text(_target(log, a))), a["prefix"], later)


RFC5424 = r"(?s)^<(\d{1,3})>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(.*)$"
RFC3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(.*)$"


def unpack_syslog(log: Log, a: dict, later) -> Log:
    c = log.text(_target(log, a))
    new, old = c.rlike(RFC5424), c.rlike(RFC3164)
    pri = F.when(new, F.regexp_extract(c, RFC5424, 1)).when(old, F.regexp_extract(c, RFC3164, 1)).cast("int")
    both = lambda x, y: F.when(new, F.regexp_replace(F.regexp_extract(c, RFC5424, x), "^-$", "")).when(old, F.regexp_extract(c, RFC3164, y) if y else F.lit(""))
    made = {
        "priority": pri.cast("string"), "facility": F.floor(pri / 8).cast("string"), "severity": (pri % 8).cast("string"), "timestamp": both(3, 2), "hostname": both(4, 3),
        "app_name": both(5, 4), "proc_id": both(6, 5), "msg_id": both(7, 0), "message": both(9, 6),
    }
    return log.at(log.df.withColumns({n: F.coalesce(v, log.text(n)) for n, v in made.items()}))


def unpack_words(log: Log, a: dict, later) -> Log:
    words = F.regexp_extract_all(log.text(_target(log, a)), F.lit(r"([A-Za-z0-9_]+)"), 1)
    return _set(log, a["as"], F.to_json(F.array_sort(F.array_distinct(words))))


def _packed(log: Log, a: dict) -> list[str]:
    return list(a["fields"] or [n for n in log.df.columns if n != EXTRA and not n.startswith(HIDDEN)])


def pack_json(log: Log, a: dict, later) -> Log:
    return _set(log, a["as"] or log.msg, F.to_json(F.struct(*[log.text(n).alias(n) for n in _packed(log, a)])))


def pack_logfmt(log: Log, a: dict, later) -> Log:
    quoted = lambda v: F.when(v.rlike(r'[\s="]'), F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)
    return _set(log, a["as"] or log.msg, F.concat_ws(" ", *[F.concat(F.lit(n + "="), quoted(log.text(n))) for n in _packed(log, a)]))


def replace(log: Log, a: dict, later) -> Log:
    name = _target(log, a)
    return _set(log, name, F.replace(log.text(name), F.lit(a["old"]), F.lit(a["new"])))


def replace_regexp(log: Log, a: dict, later) -> Log:
    name = _target(log, a)
    if not valid_regexp(a["old"]):
        return log
    return _set(log, name, F.regexp_replace(log.text(name), java_regexp(a["old"])[0], java_replacement(a["old"], a["new"])))


def collapse_nums(log: Log, a: dict, later) -> Log:
    name = _target(log, a)
    return _set(log, name, F.regexp_replace(log.text(name), "[0-9]+", "<N>"))


_IDENTIFIER = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{8,}(?![0-9A-Za-z])"


def pattern(log: Log, a: dict, later) -> Log:
    name = _target(log, a)
    return _set(log, name, F.regexp_replace(F.regexp_replace(log.text(name), _IDENTIFIER, "<ID>"), "[0-9]+", "<N>"))


def decolorize(log: Log, a: dict, later) -> Log:
    name = _target(log, a)
    return _set(log, name, F.regexp_replace(log.text(name), "\x1b\\[[0-9;?]*[ -/]*[@-~]", ""))


def math(log: Log, a: dict, later) -> Log:
    def value(e) -> Column:
        if e[0] == "num":
            return F.lit(e[1])
        if e[0] == "field":
            return F.coalesce(log.number(e[1]), F.lit(0.0))
        if e[0] == "neg":
            return -value(e[1])
        x, y = value(e[1]), value(e[2])
        if e[0] == "/":
            return F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, y))
        return {"+": x + y, "-": x - y, "*": x * y}[e[0]]

    return _set(log, a["as"], value(a["expr"]))


def len_(log: Log, a: dict, later) -> Log:
    return _set(log, a["as"], F.octet_length(log.text(a["from"])))


def hash_(log: Log, a: dict, later) -> Log:
    return _set(log, a["as"], fnv1a64(log.text(a["from"])))


def json_array_len(log: Log, a: dict, later) -> Log:
    return _set(log, a["as"], F.coalesce(F.json_array_length(log.text(a["from"])), F.lit(0)))


def unroll(log: Log, a: dict, later) -> Log:
    c = log.text(a["from"])
    items = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    words = F.when(F.trim(c, F.lit(" \t\r\n")) != "", F.split(F.trim(c, F.lit(" \t\r\n")), r"\s+"))
    found = F.coalesce(items, words, F.array(F.lit("")))
    return log.at(log.df.withColumn(a["from"], F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))))))


# order


def sort(log: Log, a: dict, later) -> Log:
    keys = []
    for name, desc in a["keys"]:
        kind = log.type_of(name)
        if kind in NUMERIC_TYPES or kind in ("timestamp", "timestamp_ntz", "date", "boolean") or kind.startswith("decimal"):
            keys.append((log.raw(name), desc))
        else:
            keys += [(log.number(name), desc), (log.text(name), desc)]
    ties = [(F.col(f"`{n}`"), False) for n in (log.order or ()) if log.has(n) and n not in dict(a["keys"])]
    log = _held(log, tuple(keys + list(log.ranked or ties)), later)
    if a.get("limit") is None and later is not None and later.positional:
        # the stage that depends on the order sorts by the kept keys, or numbers the rows: sorting here would be done twice
        return log
    df = log.df.orderBy(*log.order_columns())
    return log.at(df.limit(a["limit"]) if a.get("limit") is not None else df)


def _held(log: Log, ranked: tuple, later) -> Log:
    """The log in this order; where later stages depend on it, its keys are kept beside the fields."""
    if later is None or later.positional:
        taken = sum(n.startswith(f"{HIDDEN}s") for n in log.df.columns)
        held = {f"{HIDDEN}s{taken + k}": c for k, (c, _) in enumerate(ranked)}
        log = log.at(log.df.withColumns(held))
        ranked = tuple((F.col(n), d) for n, (_, d) in zip(held, ranked, strict=True))
    return log.at(log.df, ranked=ranked)


first = last = sort


def _ordered(log: Log):
    order = log.order_columns()
    return log.df.orderBy(*order) if order else log.df


def limit(log: Log, a: dict, later) -> Log:
    return log.at(_ordered(log).limit(a["n"]))


def offset(log: Log, a: dict, later) -> Log:
    if not log.order_columns():
        return log.at(log.df.offset(a["n"]))
    if later.most is not None and a["n"] + later.most <= FIRST_ROWS:
        # a limit follows: what is left lies among the first rows, and each task keeps only these
        return log.at(_ordered(log).limit(a["n"] + later.most).offset(a["n"]))
    # by number: no task has to hold all the rows that follow
    return log.at(numbered(log, "__n").where(F.col("__n") >= a["n"]).drop("__n"))


def tail(log: Log, a: dict, later) -> Log:
    back = log.order_columns(desc=True)
    df = log.df.orderBy(*back).limit(a["n"]) if back else log.df.limit(a["n"])
    forth = log.order_columns()
    return log.at(df.orderBy(*forth) if forth else df)


def sample(log: Log, a: dict, later) -> Log:
    return log.at(numbered(log, "__n").where(F.col("__n") % a["n"] == 0).drop("__n"))


def rank(log: Log, a: dict, later) -> Log:
    c = log.text(_target(log, a))
    score = sum((F.regexp_count(c, F.lit(_quote(t))) for t in a["terms"]), F.lit(0)).cast("bigint")
    return sort(_set(log, "_score", score), {"keys": (("_score", True),)}, later)


def top(log: Log, a: dict, later) -> Log:
    names = [f"`{n}`" for n in a["fields"]]
    counts = log.df.select(*[log.key(n).alias(n) for n in a["fields"]]).groupBy(*names).agg(F.count(F.lit(1)).alias("hits"))
    ranked = ((F.col("hits"), True), *((F.col(n).cast("string"), False) for n in names))
    return log.at(counts.orderBy(*[c.desc() if d else c.asc() for c, d in ranked]).limit(a["n"]), ranked=ranked, order=())


def uniq(log: Log, a: dict, later) -> Log:
    if not a["fields"]:
        return limit(log, {"n": 1}, later)
    df = log.df.select(*[log.key(n).alias(n) for n in a["fields"]]).distinct()
    return log.at(df.orderBy(*[f"`{n}`" for n in a["fields"]]).limit(a["limit"]) if a["limit"] is not None else df, ranked=(), order=())


# groups and sets


def stats_(log: Log, a: dict, later) -> Log:
    low, high = log.window
    seconds = (high - low) / 1e9 if low is not None and high is not None else None
    return log.at(stats(log, a["by"], a["aggs"], seconds), ranked=(), order=())


def join(log: Log, a: dict, later) -> Log:
    sub = _sub(log, a["query"])
    keys = [sub.text(k).alias(f"__k{n}") for n, k in enumerate(a["keys"])]
    # the rows' own time and order stay those of the left side
    others = [n for n in sub.df.columns if n not in a["keys"] and n not in log.order and n != log.time and n != EXTRA and not n.startswith(HIDDEN)]
    right = sub.df.select(*keys, *[F.col(f"`{n}`").alias(f"__s{k}") for k, n in enumerate(others)])
    on = log.text(a["keys"][0]) == F.col("__k0")
    for n, k in enumerate(a["keys"][1:], 1):
        on = on & (log.text(k) == F.col(f"__k{n}"))
    df = log.df.join(right, on, "left")
    made = {}
    for k, n in enumerate(others):
        name = a["prefix"] + n
        made[name] = F.coalesce(F.col(f"__s{k}"), F.col(f"`{name}`")) if log.has(name) else F.col(f"__s{k}")
    return log.at((df.withColumns(made) if made else df).drop(*[f"__s{k}" for k in range(len(others))], *[f"__k{k}" for k in range(len(keys))]))


def _keys(log: Log) -> list:
    """Expressions and directions of the order that holds."""
    from collections import namedtuple

    key = namedtuple("Key", "column down")
    if log.ranked:
        return [key(c, d) for c, d in log.ranked]
    return [key(F.col(f"`{n}`"), False) for n in (log.order or ((log.time,) if log.time else ())) if log.has(n)]


def union(log: Log, a: dict, later) -> Log:
    """The other query's rows come after the log's own."""
    other = _sub(log, a["query"])
    side = f"{HIDDEN}u"
    taken = sum(n.startswith(f"{HIDDEN}s") for n in log.df.columns)
    keys = [[(c.column, c.down) for c in _keys(x)] for x in (log, other)] if later.positional else [[], []]
    names = [[f"{HIDDEN}s{taken + n}_{k}" for k in range(len(own))] for n, own in enumerate(keys)]
    parts = [x.df.withColumns({side: F.lit(n)} | {name: c for name, (c, _) in zip(names[n], keys[n], strict=True)}) for n, x in enumerate((log, other))]
    df = parts[0].unionByName(parts[1], allowMissingColumns=True)
    if not later.positional:
        return log.at(df.drop(side), ranked=())
    df = df.withColumnRenamed(side, f"{HIDDEN}s{taken}_side")
    ranked = [(F.col(f"{HIDDEN}s{taken}_side"), False)] + [(F.col(name), d) for n in (0, 1) for name, (_, d) in zip(names[n], keys[n], strict=True)]
    return log.at(df, ranked=tuple(ranked))


def stream_context(log: Log, a: dict, later) -> Log:
    """The matches with the rows around them in the order of the whole window."""
    order = list(log.order or (log.time,))
    rows = numbered(log.at(log.whole, ranked=()), "__n")
    # a match is found again by its order key, null or not
    keys = log.df.select(*[F.col(f"`{n}`").alias(f"__m{k}") for k, n in enumerate(order)]).distinct()
    on = reduce(and_, [F.col(f"`{n}`").eqNullSafe(F.col(f"__m{k}")) for k, n in enumerate(order)])
    matched = rows.join(keys, on, "left_semi").select("__n")
    around = matched.select(F.explode(F.sequence(F.col("__n") - a["before"], F.col("__n") + a["after"])).alias("__n")).distinct()
    return log.at(rows.join(around, "__n", "left_semi").drop("__n"))


# introspection


def field_names(log: Log, a: dict, later) -> Log:
    return log.at(introspect.field_names(log), ranked=(), order=())


def field_values(log: Log, a: dict, later) -> Log:
    return log.at(introspect.field_values(log, a["field"], a["limit"]), ranked=(), order=())


def facets(log: Log, a: dict, later) -> Log:
    return log.at(introspect.facets(log, a["n"]), ranked=(), order=())


def blocks_count(log: Log, a: dict, later) -> Log:
    return log.at(introspect.blocks_count(log), ranked=(), order=())


def block_stats(log: Log, a: dict, later) -> Log:
    return log.at(introspect.block_stats(log), ranked=(), order=())


STAGES = {
    "stats": stats_, "len": len_, "hash": hash_,
    **{f.__name__: f for f in (
        fields, delete, rename, copy, drop_empty_fields, filter, format, extract, extract_regexp, unpack_json, unpack_logfmt, unpack_syslog,
        unpack_words, pack_json, pack_logfmt, replace, replace_regexp, collapse_nums, pattern, decolorize, math, json_array_len, unroll, sort,
        limit, offset, tail, sample, rank, top, uniq, join, union, stream_context, field_names, field_values, facets, blocks_count, block_stats,
    )},
    "first": sort, "last": sort,
}
