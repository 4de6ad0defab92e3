"""A cleaning pipeline over ``documents``: quality, line dedup, near duplicates, decontamination, packing.

Every stage works on all that its predecessor kept, written as Parquet and read again between stages.
A stage that changes texts brings ``n_chars`` up to date and drops documents it left without a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import WORD, settled, table
from duskwatch.llm.decontamination import decontaminate
from duskwatch.llm.jaccard import one_of_each
from duskwatch.llm.lines import dedup_lines
from duskwatch.llm.packing import pack_documents
from duskwatch.llm.quality import keep_quality


def _counted(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(keep_quality(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(dedup_lines(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the alignment and the packing; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": (run, ORACLE_SQL)}
