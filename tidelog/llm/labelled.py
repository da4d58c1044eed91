"""A bounded sample of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """text, quality, toxic of at most ``rows`` labelled documents, chosen by a hash of their id.

    Of a text beyond ``max_bytes`` a run of ``max_bytes // 4`` characters is taken, from a place that a hash of the id
    chooses, so long documents are examples too and the sample is at most ``rows * max_bytes`` large.  Rows without an
    id or a quality label are not in it; of several labels of an id the least quality and the most toxicity count.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))
    chosen = chosen.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    piece = max_bytes // 4
    place = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.char_length("text") - piece + 1)) + 1
    cut = F.when(F.octet_length("text") > max_bytes, F.substr("text", place.cast("int"), F.lit(piece))).otherwise(F.col("text"))
    # `chosen` has `rows` rows at most, whatever the tables' sizes
    return texts.join(F.broadcast(chosen), "_id").withColumn("text", cut).orderBy("_id", "text").limit(rows).select("text", "quality", "toxic").toArrow().combine_chunks()
