"""Frequent itemsets and association rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import ranked, settle
from coterie.operators.transactions import MIN_TRANSACTIONS

ITEMSETS = "items array<string>, item_key string, freq bigint, n_baskets bigint"


def frequent_itemsets(baskets: DataFrame, min_support: float, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """`items, item_key, freq, n_baskets`, written once so rules never re-run the mining.

    Fewer baskets than the gate give no itemsets.
    """
    spark = baskets.sparkSession
    kept = baskets.select("items").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = kept.count()
        if n < max(min_transactions, 1):
            return spark.createDataFrame([], ITEMSETS)
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(kept)
        sets = model.freqItemsets.select(
            F.sort_array("items").alias("items"),
            C.key_of(F.col("items")).alias("item_key"),
            "freq",
            F.lit(n).cast("bigint").alias("n_baskets"),
        )
        return settle(sets)
    finally:
        kept.unpersist()


def min_count(min_support: float, n: int) -> int:
    """Smallest basket count that reaches the support."""
    return math.ceil(min_support * n)


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules with one consequent item, by two joins of the settled itemsets.

    Every subset of a frequent itemset is frequent, so both joins always find
    their partner; the join keys are whole itemsets as arrays, so they do not pile up, and
    an item's text may hold anything.
    """
    whole = itemsets.where(F.size("items") > 1).select("items", "freq", "n_baskets", F.explode("items").alias("con"))
    whole = whole.withColumn("antecedent", F.array_remove(F.col("items"), F.col("con"))).withColumn(
        "antecedent_key", F.array_join("antecedent", " & ")
    )
    side = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("freq_ant"))
    single = itemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("con"), F.col("freq").alias("freq_con"))
    rules = (
        whole.join(side, "antecedent")
        .withColumn("confidence", F.col("freq") / F.col("freq_ant"))
        .where(F.col("confidence") >= min_confidence)
        .join(single, "con")
    )
    return rules.select(
        "antecedent",
        F.array("con").alias("consequent"),
        "antecedent_key",
        F.col("con").alias("consequent_key"),
        (F.col("freq") / F.col("n_baskets")).alias("support"),
        "confidence",
        (F.col("confidence") / (F.col("freq_con") / F.col("n_baskets"))).alias("lift"),
        "n_baskets",
    )


def rule_order() -> list:
    """Lift, support and confidence descending, the keys settling ties."""
    return [
        F.round("lift", 12).desc(),
        F.round("support", 12).desc(),
        F.round("confidence", 12).desc(),
        F.col("antecedent_key"),
        F.col("consequent_key"),
    ]


def select_rules(rules: DataFrame, lift_threshold: float, consequents: Sequence[str] = ()) -> DataFrame:
    """Rules above the lift threshold, optionally with a listed consequent item."""
    kept = rules.where(F.col("lift") > lift_threshold)
    if consequents and list(consequents) != ["*"]:
        kept = kept.where(F.arrays_overlap("consequent", C.literal_array(list(consequents))))
    return kept


def top_rules(rules: DataFrame, limit: int | None) -> DataFrame:
    """The first rules in rule order; all of them without a limit.

    The list is cut by rank, so that the rules stay spread over the tasks.
    """
    if limit is None:
        return rules
    return ranked(rules, rule_order(), "__place").where(F.col("__place") <= limit).drop("__place")


def with_antecedent(rules: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Rules with any antecedent item of a listed attribute; an empty list keeps all."""
    if not attributes:
        return rules
    return rules.where(F.exists("antecedent", lambda x: C.item_attr(x).isin(*attributes)))


def one_to_one(rules: DataFrame) -> DataFrame:
    return rules.where(F.size("antecedent") == 1)
