"""Filter trees as boolean columns: one compiler for filters, mid-pipe filters and conditional aggregates.

At the top of a conjunction a null counts as false, so leaves stay in a form that reaches the Parquet scan; anywhere
else a missing field is read as empty text first, so every leaf is true or false.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import NUMERIC_TYPES, java_regexp, whole_units
from tidelog.log import Log
from tidelog.plans.language import And, Everything, Leaf, Not, Or, ParseError

_IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def condition(log: Log, node, top: bool = False) -> Column:
    if node is None or isinstance(node, Everything):
        return F.lit(True)
    if isinstance(node, And):
        out = condition(log, node.parts[0], top)
        for part in node.parts[1:]:
            out = out & condition(log, part, top)
        return out
    if isinstance(node, Or):
        out = condition(log, node.parts[0])
        for part in node.parts[1:]:
            out = out | condition(log, part)
        return out
    if isinstance(node, Not):
        return ~condition(log, node.part)
    return leaf(log, node) if top else F.coalesce(leaf(log, node, empty=True), F.lit(False))


def _ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    number = sum((F.get(parts, F.lit(k)).try_cast("bigint") * (256 ** (3 - k)) for k in range(1, 4)), F.get(parts, F.lit(0)).try_cast("bigint") * 256**3)
    return F.when(c.rlike(_IPV4), number)


def _time_literal(log: Log, ns: int) -> Column:
    if log.types[log.time] == "bigint":
        return F.lit(ns)
    # the first microsecond that isn't before the bound; bounds beyond the calendar are its ends
    micros = min(max(-(-ns // 1000), -62135596800 * 10**6), 253402300799 * 10**6)
    if log.types[log.time] == "timestamp":
        return F.timestamp_micros(F.lit(micros))
    # without a zone, whatever the session's is
    at = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).isoformat(sep=" ")
    if log.types[log.time] == "date":
        whole = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
        day = whole.date() if whole.time() == dt.time() else whole.date() + dt.timedelta(days=1)
        return F.expr(f"date'{day.isoformat()}'")
    return F.expr(f"timestamp_ntz'{at}'")


def within(log: Log, low: int | None, high: int | None) -> Column:
    """Rows of [low, high) in nanoseconds, in a form that reaches the scan."""
    c, out = F.col(f"`{log.time}`"), F.lit(True)
    out = out & (c >= _time_literal(log, low)) if low is not None else out
    return out & (c < _time_literal(log, high)) if high is not None else out


def _equal(log: Log, node: Leaf, c: Column) -> Column:
    value, kind = node.args[0], log.type_of(node.name)
    if kind in NUMERIC_TYPES and value:
        try:
            number = float(value) if kind in ("float", "double") else int(value)
        except ValueError:
            return F.lit(False)
        return log.raw(node.name) == F.lit(number)
    return c == value


def _sequence(c: Column, phrases: tuple) -> Column:
    return c.rlike("(?s)" + ".*".join(re.escape(p) for p in phrases))


def _compare(log: Log, node: Leaf) -> Column:
    how, other = node.op[:2], node.args[0]
    a, b, x, y = log.text(node.name), log.text(other), log.number(node.name), log.number(other)
    ops = {"eq": lambda p, q: p == q, "ne": lambda p, q: p != q, "lt": lambda p, q: p < q, "le": lambda p, q: p <= q, "gt": lambda p, q: p > q, "ge": lambda p, q: p >= q}
    if how in ("eq", "ne"):
        return ops[how](a, b)
    if log.type_of(node.name) in NUMERIC_TYPES and log.type_of(other) in NUMERIC_TYPES:
        return ops[how](log.raw(node.name), log.raw(other))
    return F.when(x.isNotNull() & y.isNotNull(), ops[how](x, y)).otherwise(ops[how](a, b))


def leaf(log: Log, node: Leaf, empty: bool = False) -> Column:
    op, args = node.op, node.args
    if node.name == "_time" and op in ("time", "day_range", "week_range"):
        if not log.time:
            raise ParseError("the log has no time")
        if op == "time":
            return within(log, *args)
        minutes = whole_units(log.ns(), 60 * 10**9)
        if op == "day_range":
            return F.pmod(minutes, F.lit(1440)).between(*args)
        # 1970-01-01 was a Thursday
        return F.pmod(F.floor(minutes / 1440).cast("bigint") + 4, F.lit(7)).isin(*args)
    if op == "in_query":
        raise ParseError("in(<query>) can only stand in a filter's conjunction, or in NOT there")
    if op == "eq" and node.name in ("_stream", "_stream_id") and not log.has(node.name):
        from tidelog.operators.introspect import stream_id, stream_text

        return (stream_text(log) if node.name == "_stream" else stream_id(log)) == args[0]
    # a leaf that is false for empty text may be left raw: null is false too
    plain = not empty and op in ("eq", "contains", "prefix", "in") and all(args)
    c = log.raw(node.name).cast("string") if plain else log.text(node.name)
    if plain and log.type_of(node.name) == "string":
        c = log.raw(node.name)
    if op == "eq":
        return _equal(log, node, c)
    if op == "contains":
        return c.contains(args[0])
    if op == "prefix":
        return c.startswith(args[0])
    if op == "regexp":
        return c.rlike(java_regexp(args[0])[0])
    if op in ("gt", "ge", "lt", "le", "range"):
        x = log.raw(node.name) if log.type_of(node.name) in NUMERIC_TYPES else log.number(node.name)
        if op == "range":
            low, high, with_low, with_high = (*args, False, False)[:4] if len(args) == 2 else args
            return (x >= low if with_low else x > low) & (x <= high if with_high else x < high)
        return {"gt": x > args[0], "ge": x >= args[0], "lt": x < args[0], "le": x <= args[0]}[op]
    if op == "in":
        if log.type_of(node.name) in NUMERIC_TYPES:
            out = F.lit(False)
            for value in args:
                out = out | _equal(log, Leaf(node.name, "eq", (value,)), c)
            return out
        return c.isin(*args) if args else F.lit(False)
    if op == "len_range":
        return F.octet_length(c).between(*args)
    if op == "string_range":
        return (c >= args[0]) & (c < args[1])
    if op == "icontains":
        return F.lower(c).contains(args[0].lower())
    if op == "seq":
        return _sequence(c, args)
    if op == "ipv4_range":
        x = _ipv4(c)
        return (x >= _ipv4(F.lit(args[0]))) & (x <= _ipv4(F.lit(args[1])))
    if op.endswith("_field"):
        return _compare(log, node)
    raise ParseError(f"unknown filter {op!r}")
