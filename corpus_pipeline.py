"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last adds the mixture's columns. run() writes each stage as Parquet to the shared folder and
reads it again, so a lost executor costs one stage at most.

Defined cases: null and empty texts fail the quality rules; as input of a later stage they are one group of near-duplicates (the smallest id
stays), hold no benchmark text and no personal data, and are sampled by their cell's probability. Rows with a null doc_id are judged by the quality rules, are never
near-duplicates or leaks, are masked, and are never sampled. Repeated rows share their fate but in the near-duplicate stage, which keeps all rows of the id that
stays. Null languages and sources are a category of their own. Texts of any length are read whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroudlake.llm import decontaminate, mixing, pii, quality_rules, simhash
from shroudlake.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trained rule."""
    return quality_rules.keep(docs, quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.mask(docs, pii.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the target weights, with their probabilities."""
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: The trained rules and the tagger have no SQL form; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


