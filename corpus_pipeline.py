"""From raw documents to packed training sequences, in five stages.

``run(spark, sf_dir)`` applies STAGES to the documents table; each stage's rows are written as Parquet to the
cluster's shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import compact_windows, near_copies, packing, pfair, site_quality
from tidelog.llm.queries import MIX_POWER, table
from tidelog.llm.scratch import Scratch, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the hierarchical quality classifier rejects."""
    return site_quality.judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"), keep_columns=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near copies (five words, 0.8): the smallest doc_id, then the smallest hash of the text.

    Rows with the same doc_id and text are one document: the row with the smallest hash over all columns stays.  A row
    without an id is nobody's copy and stays.
    """
    id_, hash_, go_, row_ = unused(docs.columns, "id", "hash", "go", "row")
    found = near_copies.near_copies(docs).groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.bool_or("first").alias("first"))
    # rows that go, and rows that are there more than once
    marks = found.where("n > 1 or not first").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), (~F.col("first")).alias(go_))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: near_copies.text_hash("text")})
    # the marks grow with the corpus: the same join at every size
    marked = keyed.join(marks.hint("merge"), [id_, hash_], "left").where(f"{go_} is null or not {go_}")
    kept = marked.where(f"{go_} is null").select(docs.columns)
    if marks.where(f"not {go_}").isEmpty():
        return kept
    # of repeated rows the least, combined before they are shuffled
    names = [F.col(f"`{n}`") for n in docs.columns]
    least = marked.where(f"not {go_}").groupBy(id_, hash_).agg(F.min(F.struct(F.xxhash64(*names).alias(row_), *names)).alias(row_))
    return kept.union(least.select(f"{row_}.*").select(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document with a smaller doc_id holds too."""
    cleaned = compact_windows.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


#: The place in the mixture, carried to the packing stage: the order of files isn't one.
POSITION = "_position"


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its place in the interleaving of the sources by target weight."""
    return pfair.mix(docs, power=MIX_POWER, slot_col="_slot", position_col=POSITION).select(*docs.columns, POSITION)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, numbered in the order of the mixture."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), order_col=POSITION)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("substring removal", substring_dedup),
    ("source mixing", mixing),
    ("packing", pack),
]

#: The stages' decisions come from fitted models, fingerprints and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        done = list(scratch.paths)
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for path in done:
            scratch.drop(*[p for p in scratch.paths if p != path])
    return docs
