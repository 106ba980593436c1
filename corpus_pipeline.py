"""A training-data pipeline: language, exact copies, near copies, benchmarks, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Every stage works on all rows its predecessor kept. All but the last
return the columns of ``documents``; the last returns packed pieces. ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, langid, simhash
from tessera.llm.common import id_crc, table
from tessera.llm.queries import packed
from tessera.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; learned from rows that name theirs, without the
    rows held out for checking."""
    return langid.keep_identified(docs, langid.train(docs.where(id_crc() % 4 != 2)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest row stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component the document with the least key stays."""
    return simhash.representatives(docs, shingle=3, limit=2)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("decontamination", benchmarks),
    ("packing", packing),
]

#: Language ID, SimHash and packing have no SQL form; see tests/llm/test_llm_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
