"""The corpus pipeline: rules, line dedup, near-dedup, personal data, packing. Part of subpackage llm.

Every stage takes null and repeated doc_ids, null, empty and very long texts, extra columns of any names, and empty tables;
what they give is stated with the operators that they call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.lines import drop_frequent_lines
from tidewater.llm.packing import pack
from tidewater.llm.pii import redact_pii
from tidewater.llm.quality_rules import drop_rejected
from tidewater.llm.shared import free_name, unstored, work_dir
from tidewater.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or stray too far from every language's histograms, go."""
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all; every document stays, and n_chars follows its text."""
    n_lines, n_dropped = free_name(docs, "_n_lines"), free_name(docs, "_n_dropped")
    cut = drop_frequent_lines(docs, counts=(n_lines, n_dropped))
    return cut.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kinds; every document stays."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens at most."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted histograms, a random field and packing can't be written as SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each stage's result is written to the shared folder, read again, and goes after the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != STAGES[0][0]:
            unstored(before)
    return docs
