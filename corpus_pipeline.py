"""The corpus pipeline: quality, near duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads;
between stages the rows go through Parquet in the shared folder. Columns of any
other name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import kneser_ney, mixing, near_dup, packing, pii
from docloom.llm.common import on_workers, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's threshold; null and empty texts go, repeated rows share a verdict, empty tables stay empty."""
    return kneser_ney.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the least doc_id's; empty texts and null ids are classes of their own."""
    on_workers(spark)
    return near_dup.distinct_texts(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; every row and null text stays."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights want them, in whole documents; null lang or source are leaves."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin; a text without words is a piece without one."""
    on_workers(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Perplexity and best fit are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
