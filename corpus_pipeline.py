"""Corpus pipeline over `documents`: quality rules, language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. All but the last keep the columns of docs. Extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm import decontaminate, dedup, langid, packing, quality
from noteforge.llm.base import read, staged

#: Documents whose language is uncertain go; so do those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language of at least LEAST_LANGUAGE_SCORE."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # columns may be named like results
    plain = docs.toDF(*own).withColumnsRenamed({own[i]: c for i, c in enumerate(docs.columns) if c in ("doc_id", "text", "lang")})
    out = langid.identify(plain).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return out.select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return dedup.keep_one(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items share; those mostly made of such spans go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets. Workers share an executor with what earlier stages left, so they remember less."""
    return packing.pack(docs, packing.Packing(packing.default_tokenizer(), remember=100_000))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express language ID and packing; tests/llm hold the stages' decisions against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
