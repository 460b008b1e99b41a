"""The corpus pipeline: five stages over ``documents``, each the whole job of one operator.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and gives a DataFrame; all but the
last give the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again for the next, so a lost executor costs the tasks of one stage.

Defined results: an empty table passes through as an empty table; rows with a null text are rejected by the quality
rules (they have no words); extra columns ride along up to packing, whose rows are pieces of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbergrid.llm import decontam, lines, packing, quality, scratch, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the default policy go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from every text."""
    return lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return simhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences."""
    return packing.report(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Fingerprints, links across texts and token ids have no DuckDB SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
