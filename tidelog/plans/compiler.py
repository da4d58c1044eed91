"""Syntax tree to a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.log import Log
from tidelog.operators.pipes import HIDDEN, STAGES, keep
from tidelog.plans.language import PROJECTING, Query, fields_of, parse

#: Stages that leave a row for each row, in the same order.
_ROWWISE = {
    "fields", "delete", "rename", "copy", "drop_empty_fields", "format", "extract", "extract_regexp", "unpack_json", "unpack_logfmt", "unpack_syslog", "unpack_words",
    "pack_json", "pack_logfmt", "replace", "replace_regexp", "collapse_nums", "pattern", "decolorize", "math", "len", "hash", "json_array_len",
}
_POSITIONAL = {"limit", "offset", "tail", "sample", "rank", "sort", "first", "last", "stats"}


@dataclass(frozen=True)
class Later:
    """What the stages after one need: fields, whole records, the rows' order, and how many of the first rows where that is known."""

    reads: frozenset
    open: bool
    positional: bool
    most: int | None = None


def _later(pipes: tuple) -> Later:
    reads, opened = set(), True
    for pipe in pipes:
        reads |= fields_of(pipe)
        if pipe.name in PROJECTING:
            opened = False
            break
    cut = next((p for p in pipes if p.name not in _ROWWISE), None)
    return Later(frozenset(reads), opened, any(p.name in _POSITIONAL for p in pipes), cut.args["n"] if cut and cut.name == "limit" else None)


def run(log: Log, query: Query | str, now_ns: int | None = None) -> Log:
    """The log that a query leaves."""
    if isinstance(query, str):
        query = parse(query, now_ns)
    if log.whole is None:
        low, high = log.window
        df = log.df
        if low is not None or high is not None:
            from tidelog.functions.predicates import within

            df = df.where(within(log, low, high))
        log = log.at(df, whole=df)
    log = keep(log, query.filter)
    for k, pipe in enumerate(query.pipes):
        log = STAGES[pipe.name](log, pipe.args, _later(query.pipes[k + 1 :]))
    return log


def query(log: Log, text: str, now_ns: int | None = None) -> DataFrame:
    """The result of a query text."""
    return shown(run(log, text, now_ns))


def shown(log: Log) -> DataFrame:
    """The rows without the columns that carry their order."""
    return log.df.drop(*[n for n in log.df.columns if n.startswith(HIDDEN)])


def recent(log: Log, text: str, n: int, now_ns: int | None = None) -> DataFrame:
    """The n newest rows of a result that still has its time, newest first."""
    out = run(log, text, now_ns)
    return shown(out.at(out.df.orderBy(F.desc(out.time), *out.order_columns(desc=True)).limit(n)))
