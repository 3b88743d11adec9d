"""Corpus preparation: language, quality, exact and near duplicates, packing.

Every stage works on all rows that its predecessor kept and, but for the last, returns the
columns of documents. Stages handle nulls, empty tables and repeated rows as their operators
do: texts without letters go in the first stage, short and repetitive ones in the second. Texts of
any length are read whole, in slices where they are long; further columns come through all stages but
the last, also names with dots. Names that differ in case alone pass every stage, but Spark writes such
tables between stages only where spark.sql.caseSensitive is on, and refuses them else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import scratch, table, written
from quillstone.llm.exact_dedup import without_copies
from quillstone.llm.langid import with_language
from quillstone.llm.near_copies import without_near_copies
from quillstone.llm.packing import pack
from quillstone.llm.quality import good

#: A text of 48 distinct n-grams or more whose best cosine is lower is in no learned language; shorter ones need less.
#: Random texts in other scripts score up to 0.11, the lowest held-out document of that length 0.229.
MIN_SCORE = 0.13


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, MIN_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: The language and near-duplicate stages aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as made:  # what the stage wrote on its way goes, and so does its input
            out = written(stage(spark, docs, sf_dir), f"pipeline-{name}", instead_of=docs)
            made.remove(out.written_to)
        docs = out
    return docs
