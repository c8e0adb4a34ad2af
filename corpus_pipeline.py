"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of
documents; the last one adds token ids. `run` writes every stage as Parquet to the shared
folder and reads it back as the next one's input, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm import decontam, linededup, neardup, pieces, quality
from echoframe.llm.frames import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents outside the quality rules."""
    return quality.reject(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts recurring chunks of lines, and recurring pairs of lines, out of the texts; n_chars follows."""
    return linededup.apply(docs, pairs=True).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with a window of eight words of any benchmark item, or with two items or more (of which some may be shorter)."""
    return decontam.reject(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_window=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages' Viterbi and suffix searches have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
