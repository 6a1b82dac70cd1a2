"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

A stage is a function of (session, documents, input folder) to a DataFrame. All but the last return the
columns of documents; the last adds ``domain``, ``n_tokens`` and ``epoch``, with one row for each epoch in which
a document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from vectrail.llm.common import cut
from vectrail.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: texts without a letter, and those that no language explains, go."""
    ship(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    return language_id.keep_known(docs, model)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share, each kept in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    ship(spark)
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture, as many tokens as there are."""
    return mixing.mix(docs, mixing.Targets(budget=1.0))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", shared_lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("mix", mixture),
]

#: Language ID, sketches and alignments aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
