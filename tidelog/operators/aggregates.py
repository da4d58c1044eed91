"""Aggregates of the ``stats`` stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.predicates import condition
from tidelog.functions.text import log_bucket
from tidelog.log import Log
from tidelog.plans.language import Agg

VALUES = 10_000
#: Relative standard deviation of approximate distinct counts, that of 2^14 registers.
DISTINCT_ERROR = 0.0081


def _percentile(column: str, p: float) -> Column:
    # rank floor(p * n) from 0 counted upwards is rank ceil((1 - p) * n) from 1 counted downwards
    return F.expr(f"percentile_disc({1 - min(1.0, max(0.0, p))}D) within group (order by {column} desc)")


def _ranked_build(log: Log, agg: Agg, name: str, when, full: Column) -> tuple[dict[str, Column], Column]:
    """The same where a sort stands before: its keys, each in its direction, decide."""
    c, keys = F.col(name), log.ranked
    score = when(log.number(agg.fields[0])) if agg.fn in ("row_min", "row_max") else None
    out = log.raw(agg.fields[1]) if score is not None else full
    shown = score.isNotNull() if score is not None else when(full).isNotNull()
    first = [F.lit(0.0) if score is None else score if agg.fn == "row_min" else -score]
    row = F.struct(first[0].alias("s"), *[k.alias(f"k{n}") for n, (k, _) in enumerate(keys)], out.alias("v"))

    def order(a: Column, b: Column) -> Column:
        made = F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1)
        for n, (_, down) in enumerate(keys):
            x, y = a[f"k{n}"], b[f"k{n}"]
            made = made.when(x.isNull() & y.isNotNull(), 1).when(x.isNotNull() & y.isNull(), -1).when(x < y, 1 if down else -1).when(x > y, -1 if down else 1)
        return made.otherwise(0)

    held = F.array_sort(F.collect_list(c), order)
    if agg.fn == "values":
        made = F.to_json(F.transform(F.slice(held, 1, VALUES), lambda x: x["v"]))
    else:
        made = F.get(held, F.lit(0))["v"]
        made = F.coalesce(made, F.lit("")) if agg.fn == "row_any" else made
    return {name: F.when(shown, row)}, made


def _build(log: Log, agg: Agg, k: int, seconds: float | None) -> tuple[dict[str, Column], Column]:
    """Columns to compute before grouping, and the aggregate over them."""
    name, fn = f"__v{k}", agg.fn
    cond = condition(log, agg.cond) if agg.cond is not None else None
    when = (lambda c: F.when(cond, c)) if cond is not None else (lambda c: c)
    c = F.col(name)
    field = agg.fields[0] if agg.fields else None
    if fn in ("count", "rate"):
        n = F.count(c)
        if fn == "rate":
            return {name: when(F.lit(1))}, n / F.lit(seconds) if seconds and seconds > 0 else F.lit(0.0)
        return {name: when(F.lit(1))}, n
    if fn in ("sum", "rate_sum", "avg", "min", "max", "quantile", "median"):
        number = log.raw(field) if log.type_of(field) in ("bigint", "int", "double") else log.number(field)
        if fn in ("quantile", "median"):
            return {name: when(log.number(field))}, F.coalesce(_percentile(name, agg.number), F.lit(0.0))
        made = {"sum": F.sum, "rate_sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](c)
        made = F.coalesce(made, F.lit(0))
        if fn == "rate_sum":
            made = made / F.lit(seconds) if seconds and seconds > 0 else F.lit(0.0)
        return {name: when(number)}, made
    if fn in ("uniq", "count_uniq"):
        return {name: when(log.key(field))}, F.count_distinct(c)
    if fn == "count_uniq_hash":
        return {name: when(log.text(field))}, F.approx_count_distinct(c, DISTINCT_ERROR)
    text = log.text(field)
    full = F.nullif(text, F.lit(""))
    if fn == "uniq_values":
        return {name: when(full)}, F.to_json(F.array_sort(F.collect_set(c)))
    if fn == "sum_len":
        return {name: when(F.octet_length(text).cast("bigint"))}, F.coalesce(F.sum(c), F.lit(0))
    if fn == "count_empty":
        return {name: when(F.when(text == "", 1))}, F.count(c)
    order = [F.col(f"`{n}`") for n in (log.order or ((log.time,) if log.time else ())) if log.has(n)]
    rank = F.struct(*order) if order else F.monotonically_increasing_id()
    if log.ranked and fn in ("values", "row_any", "row_min", "row_max"):
        return _ranked_build(log, agg, name, when, full)
    if fn == "values":
        held = F.slice(F.array_sort(F.collect_list(c)), 1, VALUES)
        return {name: F.when(when(full).isNotNull(), F.struct(rank.alias("o"), full.alias("v")))}, F.to_json(F.transform(held, lambda x: x["v"]))
    if fn == "row_any":
        return {name: F.when(when(full).isNotNull(), F.struct(rank.alias("o"), full.alias("v")))}, F.coalesce(F.min(c)["v"], F.lit(""))
    if fn in ("row_min", "row_max"):
        score, out = when(log.number(field)), log.raw(agg.fields[1])
        # the least struct: of equal scores the first row
        scored = F.when(score.isNotNull(), F.struct((score if fn == "row_min" else -score).alias("s"), rank.alias("o"), out.alias("v")))
        return {name: scored}, F.min(c)["v"]
    raise AssertionError(fn)


def _histograms(log: Log, by: tuple, agg: Agg) -> DataFrame:
    """One row for each group: its buckets as JSON, counted per bucket before they are gathered (486 at most)."""
    x = log.number(agg.fields[0])
    rows = log.df.where(condition(log, agg.cond)).where(x > 0) if agg.cond is not None else log.df.where(x > 0)
    keys = [log.key(b).alias(b) for b in by]
    counts = rows.select(*keys, log_bucket(x).alias("__b")).groupBy(*[f"`{b}`" for b in by], "__b").agg(F.count(F.lit(1)).alias("__n"))
    edge = lambda k: F.format_string("%.3e", F.pow(F.lit(10.0), k / 18.0 - 9))
    items = F.transform(F.array_sort(F.collect_list(F.struct("__b", "__n"))), lambda x: F.struct(F.concat(edge(x["__b"]), F.lit("..."), edge(x["__b"] + 1)).alias("vmrange"), x["__n"].alias("hits")))
    return counts.groupBy(*[f"`{b}`" for b in by]).agg(F.to_json(items).alias(agg.alias))


def stats(log: Log, by: tuple, aggs: tuple, seconds: float | None = None, extra_keys: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group; none where no row is left, even without grouping."""
    keys = {b: log.key(b) for b in by} | (extra_keys or {})
    before, after, histograms = {}, [], []
    for k, agg in enumerate(aggs):
        if agg.fn == "histogram":
            histograms.append(agg)
            continue
        columns, made = _build(log, agg, k, seconds)
        before |= columns
        after.append(made.alias(agg.alias))
    rows = log.df.select(*[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in before.items()])
    names = [f"`{n}`" for n in keys]
    out = rows.groupBy(*names).agg(*after, F.count(F.lit(1)).alias("__rows"))
    out = (out if keys else out.where("__rows > 0")).drop("__rows")
    for agg in histograms:
        found = _histograms(log, by, agg)
        if by:
            # keys may be null where the column isn't text
            marks = [(F.col(f"a.`{b}`").eqNullSafe(F.col(f"b.`{b}`"))) for b in by]
            on = marks[0]
            for m in marks[1:]:
                on = on & m
            out = out.alias("a").join(found.alias("b"), on, "left").select("a.*", F.coalesce(F.col(f"b.`{agg.alias}`"), F.lit("[]")).alias(agg.alias))
        else:
            # each side is one row at most
            out = out.join(F.broadcast(found), how="left", on=F.lit(True))
    order = [*keys, *(a.alias for a in aggs)]
    return out.select(*[f"`{n}`" for n in order])
