"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import audio, compact_windows, langid, maxent_lm, packing, pfair, quality_rules, simhash, site_quality, token_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """The remainder that decides whether a document is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged; its source is the host, its language within the source the path."""
    return site_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"), fold(7) == 2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold(5) == 0)


#: Sources are mixed by the square root of their rows, so that a large one doesn't drown the others.
MIX_POWER = 0.5


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, with its place in the mixture."""
    return pfair.mix(table(spark, sf_dir, "documents"), power=MIX_POWER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_site_quality": op1_site_quality,
        "op2_token_index": op2_token_index,
        "op3_quality_rules": op3_quality_rules,
        "op4_maxent_lm": op4_maxent_lm,
        "op5_simhash": op5_simhash,
        "op6_packing": op6_packing,
        "op7_audio_features": op7_audio_features,
        "op8_compact_windows": op8_compact_windows,
        "op9_cross_parsing": op9_cross_parsing,
        "op10_pfair_mix": op10_pfair_mix,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {}
