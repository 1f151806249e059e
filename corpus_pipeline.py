"""A corpus pipeline: quality rules, near duplicates, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, jaccard, mixing, quality, secrets
from weft.llm.common import dropped, shared_dir, table, written

#: SQL has no minimum covariance determinant and no BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least doc_id stays."""
    return jaccard.distinct_documents(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; every document stays."""
    return secrets.redacted(docs, f"{shared_dir(spark)}/ledger")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of them and of the decoded text."""
    return bpe.round_trip(docs, release=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{folder}/stage{k}")
            dropped(spark, f"{folder}/stage{k - 1}")  # the stage before is read no more
    return docs
