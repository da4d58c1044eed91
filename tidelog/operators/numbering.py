"""A global row number that needs no single partition."""

from __future__ import annotations

import json
from datetime import timedelta
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import epoch_micros
from tidelog.log import Log

#: Ranges that the rows are parted into, at least and at most, and the rows of one where there are more than the least.
RANGES, MOST_RANGES, RANGE_ROWS = 256, 4096, 250_000
#: Rows drawn to place the bounds of the ranges; the characters of a text that a bound holds.
DRAWN, PREFIX = 20_000, 256


def _comparable(order: list[tuple[Column, bool]], df: DataFrame) -> list[tuple[Column, str, bool]]:
    """Keys of plain types that never fall where the order rises, with their type and direction.

    A long text counts by its first characters; the keys behind it then say nothing, nor do those behind other types.
    """
    made, whole = [], F.lit(True)
    kinds = df.select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(order)]).dtypes
    for (c, down), (_, kind) in zip(order, kinds, strict=True):
        if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            c, kind = c.cast("bigint"), "bigint"
        elif kind in ("float", "double"):
            c, kind = c.cast("double"), "double"
        elif kind in ("timestamp", "date"):
            c, kind = epoch_micros(c, kind), "bigint"
        elif kind == "timestamp_ntz":
            # a difference is one subtraction; no zone takes part
            c, kind = c - F.lit("1970-01-01").cast(kind), "interval day to second"
        elif kind != "string" and not kind.startswith("decimal"):
            break
        longer = F.coalesce(F.length(c) > PREFIX, F.lit(False)) if kind == "string" else None
        made.append((F.when(whole, F.substring(c, 1, PREFIX) if kind == "string" else c), kind, down))
        if longer is not None:
            made.append((F.when(whole, longer.cast("bigint")), "bigint", down))
            whole = whole & ~longer
    return made


def _bounds(rows: DataFrame, keys: list[tuple[Column, str, bool]], nulls_last: bool) -> list[tuple]:
    """Ascending keys, near to equally many rows apart: those of rows drawn at random, which part the ranges and decide nothing else."""
    drawn = rows.select(*[c.alias(f"k{n}") for n, (c, _, _) in enumerate(keys)], F.rand(42).alias("r")).orderBy("r").limit(DRAWN).collect()
    if not drawn:
        return []
    # of so many numbers between 0 and 1, the greatest drawn says how many there are
    count = len(drawn) / max(r["r"] for r in drawn) if len(drawn) == DRAWN else len(drawn)
    ranges = min(MOST_RANGES, max(RANGES, int(count / RANGE_ROWS)))
    held = [tuple(r)[:-1] for r in drawn]
    for n in reversed(range(len(keys))):
        down = keys[n][2]
        # NaN is the greatest number
        held.sort(key=lambda r, n=n, down=down: ((r[n] is None) == (nulls_last != down), (r[n] != r[n], 0 if r[n] is None or r[n] != r[n] else r[n]) if r[n] is not None else ()), reverse=down)
    return list(dict.fromkeys(held[k * len(held) // ranges] for k in range(1, ranges)))


def _text(value) -> str | None:
    """A value as Spark reads it back from text."""
    if isinstance(value, timedelta):
        seconds, micros = divmod(abs(value) // timedelta(microseconds=1), 1_000_000)
        return f"{'-' if value < timedelta() else ''}{seconds // 86400} {seconds // 3600 % 24}:{seconds // 60 % 60}:{seconds % 60}.{micros:06}"
    return None if value is None else str(value)


def _array(values: list, kind: str, text: str = "string") -> Column:
    """A constant array, made from one JSON text: a column for each value takes milliseconds to build."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{text}>").cast(f"array<{kind}>")


def _ranged(rows: DataFrame, bounds: list[tuple], keys: list[tuple[Column, str, bool]], nulls_last: bool) -> DataFrame:
    """The rows with `__range`, how many bounds lie at or before the row, by binary search.

    Each step is a projection of its own, which Spark compiles; a search in a lambda is interpreted and takes microseconds for each comparison.
    Keys of one direction are compared as one struct, nulls first: more code in a step makes a method that the JVM does not compile.
    """
    runs: list[tuple[bool, list]] = []
    for n, (c, kind, down) in enumerate(keys):
        flag = [(c.isNull(), "boolean", [str(b[n] is None).lower() for b in bounds])] if nulls_last != down else []
        parts = [*flag, (c, kind, [_text(b[n]) for b in bounds])]
        if runs and runs[-1][0] == down:
            runs[-1][1].extend(parts)
        else:
            runs.append((down, parts))
    found, held = rows.withColumn("__range", F.lit(0)), []
    for n, (down, parts) in enumerate(runs):
        names = [f"k{k}" for k in range(len(parts))]
        found = found.withColumn(f"__range_k{n}", F.struct(*[c.alias(k) for k, (c, _, _) in zip(names, parts, strict=True)]))
        made = [dict(zip(names, b, strict=True)) for b in zip(*[texts for _, _, texts in parts], strict=True)]
        kinds = ", ".join(f"{k}: {kind}" for k, (_, kind, _) in zip(names, parts, strict=True))
        held.append((_array(made, f"struct<{kinds}>", f"struct<{', '.join(f'{k}: string' for k in names)}>"), F.col(f"__range_k{n}"), down))
    at = F.col("__range")
    for step in [1 << k for k in reversed(range(len(bounds).bit_length()))]:
        reached = F.lit(True)
        for n, (array, y, down) in reversed(list(enumerate(held))):
            # null past the last bound: not reached
            x = F.get(array, at + step - 1)
            if n == len(held) - 1:
                reached = x >= y if down else x <= y
            else:
                reached = F.when(x > y if down else x < y, True).when(x == y, reached)
        found = found.withColumn("__range", F.when(reached, at + step).otherwise(at))
    return found.drop(*[f"__range_k{n}" for n in range(len(runs))])


def numbered(log: Log, name: str) -> DataFrame:
    """The rows with their position from 0 in the log's order.

    Keys of rows drawn at random bound ranges of the whole order, so that many rows of one leading value are parted too; rows are
    numbered inside each range and start from the count of the ranges before.  The bounds and counts are MOST_RANGES values at most.
    """
    order = log.order_columns()
    if not order:
        raise ValueError("the log has no order")
    nulls_last = bool(log.ranked)
    keys = _comparable(log.order_keys(), log.df)
    bounds = _bounds(log.df, keys, nulls_last) if keys else []
    rows = _ranged(log.df, bounds, keys, nulls_last) if bounds else log.df.withColumn("__range", F.lit(0))
    counts = {r[0]: r[1] for r in rows.groupBy("__range").count().collect()}
    begins = list(accumulate((counts.get(k, 0) for k in range(len(bounds))), initial=0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return rows.withColumn(name, F.get(_array(begins, "bigint"), F.col("__range")) + inside).drop("__range")
