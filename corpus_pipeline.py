"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet below the shared folder and reads it again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifetrace.llm import decontam, mixing, quality, simhash, tokenids
from lifetrace.llm.common import read
from lifetrace.session import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks, or are probably bad by the rules, go."""
    return quality.good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are taken, left out or repeated by blocks, to the weights of their sources."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the binary format, and what the files hold of each of its rows."""
    return tokenids.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_weights", mix),
    ("token_ids", token_ids),
]

#: SQL can express neither the rules' posterior, nor XXH64 fingerprints, nor token ids;
#: tests/llm/test_pipeline.py compares the stages with plain readings instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
