"""Corpus pipeline: five of the library's corpus operators, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.bpe import bpe_stage
from gaugeworks.llm.mixing import mixing_stage
from gaugeworks.llm.quality import quality_stage
from gaugeworks.llm.simhash import simhash_stage
from gaugeworks.llm.substrings import substring_stage
from gaugeworks.session import settle

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: The classifier's training and the fingerprints' hash have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
