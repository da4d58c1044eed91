"""A log: a DataFrame with a time column, an order, a message field and stream fields."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import epoch_micros, number_text, to_number

#: Hidden map of fields that are known only from the data.
EXTRA = "_extra"


@dataclass(frozen=True)
class Log:
    """``time`` names a timestamp column or a BIGINT of nanoseconds; ``order`` the columns of the rows' order."""

    df: DataFrame
    time: str | None = None
    order: tuple[str, ...] = ()
    msg: str = "_msg"
    stream: tuple[str, ...] = ()
    #: The queried window [from, to) in nanoseconds, where it is known; rates divide by it.
    window: tuple[int | None, int | None] = (None, None)
    #: The rows that subqueries read, before any filter.
    whole: DataFrame | None = None
    #: Expressions and directions of the last sort, where one replaced the order.
    ranked: tuple[tuple[Column, bool], ...] = ()

    def at(self, df: DataFrame, **changes) -> Log:
        return replace(self, df=df, **changes)

    @property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def raw(self, name: str | None) -> Column:
        """The field as it is stored; null where it is missing."""
        name = self.msg if name is None else name
        if self.has(name):
            return F.col(f"`{name}`")
        if name == "_time" and self.time and self.has(self.time):
            return F.col(f"`{self.time}`")
        if self.has(EXTRA):
            return F.col(EXTRA)[name]
        return F.lit(None).cast("string")

    def type_of(self, name: str | None) -> str:
        name = self.msg if name is None else name
        if name == "_time" and not self.has(name) and self.time:
            name = self.time
        return self.types.get(name, "string")

    def text(self, name: str | None) -> Column:
        """The field as text; missing is empty."""
        c = self.raw(name)
        return F.coalesce(number_text(c) if self.type_of(name) in ("float", "double") else c.cast("string"), F.lit(""))

    def number(self, name: str | None) -> Column:
        return to_number(self.raw(name), self.type_of(name))

    def key(self, name: str) -> Column:
        """The field as a grouping key: text with missing as empty, other types as they are."""
        return self.text(name) if self.type_of(name) == "string" else self.raw(name)

    def ns(self) -> Column:
        """The time in nanoseconds."""
        c, kind = F.col(f"`{self.time}`"), self.types[self.time]
        return c if kind == "bigint" else epoch_micros(c, kind) * 1000

    def order_keys(self) -> list[tuple[Column, bool]]:
        """Expressions and directions of the order that holds."""
        if self.ranked:
            return list(self.ranked)
        return [(F.col(f"`{n}`"), False) for n in (self.order or ((self.time,) if self.time else ())) if self.has(n)]

    def order_columns(self, desc: bool = False) -> list[Column]:
        if self.ranked:
            return [(c.asc_nulls_first() if desc else c.desc_nulls_last()) if down else (c.desc_nulls_first() if desc else c.asc_nulls_last()) for c, down in self.ranked]
        names = [n for n in (self.order or ((self.time,) if self.time else ())) if self.has(n)]
        return [F.col(f"`{n}`").desc() if desc else F.col(f"`{n}`").asc() for n in names]
