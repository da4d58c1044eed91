"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(df: DataFrame, field: str, query: list[float], k: int = 10, ties: str | None = None) -> DataFrame:
    """The k rows most similar to the query with ``_score``; the vector itself is left out.

    A row of another dimension or of zero length has score 0, as has every row for a zero query.
    """
    norm = math.sqrt(sum(x * x for x in query))
    held = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(f"`{field}`")
    dot = F.aggregate(F.zip_with(v, held, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    score = F.when((F.size(v) == len(query)) & (length > 0) & F.lit(norm > 0), dot / (length * F.lit(norm or 1.0))).otherwise(0.0)
    scored = df.withColumn("_score", score).drop(field)
    return scored.orderBy(F.desc("_score"), *([ties] if ties else [])).limit(k).withColumn("_score", F.round("_score", 4))
