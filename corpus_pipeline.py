"""A training corpus from the documents table: five stages, each over all that its predecessor kept.

Documents without a word (null, empty or blank texts) go in the first stage.
Null ids, languages and sources are passed on: a row without doc_id is a
document of its own that no other is a copy of and whose lines stay; null
languages and sources form groups of their own. Rows that repeat a doc_id go or
stay together. Columns that have nothing to do with a stage are passed on,
whatever their names. Very long texts are handled whole. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaweave.llm import line_dedup, minhash, mixing, pieces, quality_rules
from deltaweave.llm.frames import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no outliers of their language and source; those without a word go."""
    return quality_rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others have; those of nothing else go. Lines of a null doc_id stay."""
    return line_dedup.strip_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; those with a null one stay."""
    return minhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, once for each epoch that takes them; null languages and sources are empty names."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in the text, a row a document."""
    return pieces.encode(docs)


STAGES = [("quality rules", quality), ("line dedup", repeated_lines), ("near duplicates", near_copies), ("mixing", mixture), ("sentencepiece", encoded)]

#: SQL can't express the robust estimates of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
