"""The corpus pipeline: quality rules, one of each group of near copies, secrets cut out, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet
and read again as the next stage's docs. What a stage settles on the way lies in a folder
of its own, which the next stage deletes as it begins: write a stage's frame before that.

Defined cases: an empty table gives an empty result. Null and empty texts have no words, so the quality
rules reject them. Documents with null or repeated ids are told apart by their texts; of
rows that agree in id and text, one stays. Ties, very long texts and further columns are as each stage's module states.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from coterie.functions.frames import forget, forget_step, new_path, step_folder
from coterie.llm import jaccard, mixture, quality, secretscan
from coterie.llm.queries import table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_own_folder(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with step_folder(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


@_in_own_folder
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept_documents(docs)


@_in_own_folder
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return jaccard.one_of_each(docs)


@_in_own_folder
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secretscan.redacted(docs)


@_in_own_folder
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return mixture.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: Near copies, secrets and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_path(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            forget(spark, before)
        before = path
    forget_step(spark)
    return docs
