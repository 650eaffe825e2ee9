"""Pruning, numbering, combining and grouping of rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import ranked, settle
from coterie.operators.mining import rule_order

MEASURES = ("support", "confidence", "lift", "real_support", "real_lift")
MIN_RULES_TO_CLUSTER = 9
RULE_CLUSTERS = 8


def prune(rules: DataFrame) -> DataFrame:
    """Drop a rule if a rule with the same consequent and a smaller antecedent lifts no less.

    The best lift found below each antecedent is carried upwards one item at a
    time, so the work follows the number of distinct sub-antecedents (all of
    them frequent itemsets) and no pair of rules is ever compared.
    """
    rules = settle(rules.withColumn("__lift", F.round("lift", 12)))
    longest = rules.agg(F.max(F.size("antecedent"))).head()[0] or 0
    if longest < 2:
        return rules.drop("__lift")
    own = rules.select("consequent_key", "antecedent", "__lift")

    # Sub-antecedents by size, from the longest down.
    levels: dict[int, DataFrame] = {}
    above = None
    for k in range(longest, 0, -1):
        here = own.where(F.size("antecedent") == k)
        if above is not None:
            lower = _one_smaller(above.select("consequent_key", "antecedent")).select("consequent_key", "antecedent")
            here = here.unionByName(lower.withColumn("__lift", F.lit(None).cast("double")))
        here = here.groupBy("consequent_key", "antecedent").agg(F.max("__lift").alias("__lift"))
        levels[k] = above = settle(here) if 1 < k < longest else here

    best = levels[1].select("consequent_key", "antecedent", F.col("__lift").alias("best"))
    dominated = None
    for k in range(2, longest + 1):
        below = (
            _one_smaller(levels[k])
            .join(best.withColumnRenamed("antecedent", "smaller"), ["consequent_key", "smaller"])
            .groupBy("consequent_key", F.col("whole").alias("antecedent"))
            .agg(F.max("best").alias("below"))
        )
        joined = levels[k].join(below, ["consequent_key", "antecedent"], "left")
        lost = joined.where(F.col("below") >= F.col("__lift")).select("consequent_key", "antecedent")
        dominated = lost if dominated is None else dominated.unionByName(lost)
        if k < longest:
            best = settle(joined.select("consequent_key", "antecedent", F.greatest("__lift", "below").alias("best")))
    return rules.join(dominated, ["consequent_key", "antecedent"], "left_anti").drop("__lift")


def _one_smaller(sets: DataFrame) -> DataFrame:
    """Each antecedent with one of its items left out: `antecedent, smaller, whole`."""
    out = sets.select("consequent_key", F.col("antecedent").alias("whole"), F.explode("antecedent").alias("x"))
    smaller = F.array_remove(F.col("whole"), F.col("x"))
    return out.select("consequent_key", "whole", smaller.alias("smaller"), smaller.alias("antecedent"))


def number_rules(rules: DataFrame, run_id: str) -> DataFrame:
    """Adds `run_id`, `rank` and `rule_id` in rule order."""
    out = ranked(rules, rule_order())
    return out.withColumn("run_id", F.lit(run_id)).withColumn(
        "rule_id", F.concat_ws("_", F.lit(run_id), F.col("rank").cast("string"))
    )


def combine(rules: DataFrame) -> DataFrame:
    """One rule per antecedent: all consequents, the smallest of each measure, the first id.

    A combined rule has no cluster; a rule that met no other keeps its own.
    """
    measures = [c for c in MEASURES if c in rules.columns]
    kept = [c for c in ("rule_id", "cluster", "n_baskets", "run_id") if c in rules.columns]
    aggs = [F.min(c).alias(c) for c in measures]
    first = F.min(F.struct("rank", *kept)) if "rank" in rules.columns else F.min(F.struct("consequent_key", *kept))
    out = (
        rules.select("antecedent_key", "antecedent", F.explode("consequent").alias("con"), *measures,
                     *(c for c in ("rank",) if c in rules.columns), *kept, "consequent_key")
        .groupBy("antecedent_key", "antecedent")
        .agg(F.sort_array(F.collect_set("con")).alias("consequent"), F.count_distinct("consequent_key").alias("__n"),
             first.alias("__first"), *aggs)
    )
    out = out.withColumn("consequent_key", C.key_of(F.col("consequent")))
    for c in (*(("rank",) if "rank" in rules.columns else ()), *kept):
        value = F.col(f"__first.{c}")
        out = out.withColumn(c, F.when(F.col("__n") > 1, F.lit("")).otherwise(value) if c == "cluster" else value)
    return out.drop("__first", "__n")


# ---- ordinal states and clusters --------------------------------------------


def _steps(value: Column, low: float, high: float, names: tuple) -> Column:
    return F.when(value < low, names[0]).when(value < high, names[1]).otherwise(names[2])


def _state(measure: str, value: Column, threshold: float, names: tuple) -> Column:
    if measure == "confidence":
        room = 1 - threshold
        return _steps(value, threshold + room / 4, threshold + room * 3 / 4, names)
    return _steps(value, 1.5 * threshold, 2 * threshold, names)


def with_states(rules: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Adds `support_state, confidence_state, lift_state`, each 1 to 3."""
    for m in ("support", "confidence", "lift"):
        rules = rules.withColumn(f"{m}_state", _state(m, F.col(m), thresholds[m], (1, 2, 3)))
    return rules


def cluster_name(thresholds: dict[str, float]) -> Column:
    """Name of a cluster from the mean measures in columns support, confidence, lift."""
    parts = []
    for i, (m, title) in enumerate((("support", "Support"), ("confidence", "Confidence"), ("lift", "Lift"))):
        if i:
            parts.append(F.lit("_"))
        parts += [_state(m, F.col(m), thresholds[m], ("Low", "Med", "High")), F.lit(title)]
    return F.concat(*parts)


def state_clusters(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each of the distinct states, at most 27, by weighted k-means.

    The first centre is the heaviest state, each further one the state with the most weight times squared distance
    from the centres so far; ties go to the earlier state and the earlier centre. Centres and members follow from one
    another until no state moves. With no more states than clusters every state is its own cluster.
    """
    weights = weights.astype(np.int64)
    chosen = [int(np.argmax(weights))]
    while len(chosen) < min(k, len(points)):
        apart = ((points[:, None] - points[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(int(np.argmax(weights * apart)))
    centres, label = points[chosen].astype(float), None
    while True:
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).round(9)
        moved = near.argmin(axis=1)
        if label is not None and (moved == label).all():
            return label
        label = moved
        for c in np.unique(label):
            centres[c] = np.average(points[label == c], axis=0, weights=weights[label == c])


def cluster_rules(
    rules: DataFrame, thresholds: dict[str, float], k: int = RULE_CLUSTERS, min_rules: int = MIN_RULES_TO_CLUSTER
) -> DataFrame:
    """Sets `cluster` to the name of the rule's k-means cluster of measure states.

    Rules are only counted by state, of which there are 27. Fewer than `min_rules` rules stay without cluster, as
    the analysis asks for.
    """
    rules = rules.drop("cluster")
    names = ["support_state", "confidence_state", "lift_state"]
    states = with_states(rules, thresholds).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    if sum(s["n"] for s in states) < max(min_rules, 1):
        return rules.withColumn("cluster", F.lit(""))
    points = np.array([[s[c] for c in names] for s in states])
    label = state_clusters(points, np.array([s["n"] for s in states]), k)
    placed = [(*p, int(c)) for p, c in zip(points.tolist(), label)]
    assigned = rules.sparkSession.createDataFrame(placed, ", ".join(f"{c} int" for c in (*names, "__c")))
    means = [F.sum(m).alias(m) for m in ("support", "confidence", "lift")]
    # Summed by state before the few clusters meet them, so no cluster is one task's work.
    by_state = with_states(rules, thresholds).groupBy(*names).agg(F.count("*").alias("n"), *means)
    titles = (
        by_state.join(assigned, names).groupBy("__c")
        .agg(*[(F.sum(m) / F.sum("n")).alias(m) for m in ("support", "confidence", "lift")])
        .select("__c", cluster_name(thresholds).alias("cluster"))
    )
    by_name = assigned.join(titles, "__c").drop("__c")
    return with_states(rules, thresholds).join(by_name, names).drop(*names)


# ---- derived rows -----------------------------------------------------------


def rule_attributes(rules: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """One row per item of a rule: `rule_id, side, attr, value, entity`."""

    def tagged(side: str) -> Column:
        return F.transform(side, lambda x: F.struct(F.lit(side).alias("side"), x.alias("item")))

    keys = [c for c in ("run_id", "rule_id") if c in rules.columns]
    rows = rules.select(*keys, F.inline(F.concat(tagged("antecedent"), tagged("consequent"))))
    rows = rows.select(*keys, "side", C.item_attr(F.col("item")).alias("attr"), C.recorded_value(F.col("item")).alias("value"))
    if variables is None:
        return rows
    return rows.join(variables, "attr", "left").withColumn("entity", F.coalesce("entity", F.lit("")))


def weighted_rows(rules: DataFrame, codes: dict[str, dict[str, int]] | None = None, repeat: bool = False) -> DataFrame:
    """Rules as numeric training rows: the antecedent coded, weighted by whole percents of support.

    `repeat` gives each row as often as its weight says instead.
    """
    codes = codes or C.ORDINAL_CODES
    status_codes = C.STATUS_CODES

    def coded(x: Column) -> Column:
        attr, value = C.item_attr(x), C.item_value(x)
        code = F.coalesce(C.numeric_code(attr, value, codes), C.first_match(value, status_codes).cast("double"))
        return F.struct(attr.alias("feature"), code.alias("value"))

    rows = rules.select(
        "antecedent_key",
        F.transform("antecedent", coded).alias("features"),
        C.list_text(F.col("consequent"), brackets=False).alias("label"),
        (F.col("support") * 100).cast("int").alias("weight"),
    )
    rows = rows.where(F.col("weight") > 0)
    if repeat:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    return rows
