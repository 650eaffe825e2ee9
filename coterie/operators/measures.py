"""Support and lift corrected for missing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import scalar_of, settle

KEY = ["antecedent_key", "consequent_key"]
RULE = ["antecedent", "consequent"]
#: Distinct profiles of one list of attributes that are met in one part.
PART = 100_000


def held_sets(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`attrs, rule_attrs, wanted`: the attribute sets that each list of attributes holds.

    The sets form a tree of prefixes. Each list walks down from the root, one attribute a
    step in sorted order, by equi-join on (prefix, next attribute); a list only ever meets
    prefixes that it holds, and nothing is compared that does not match.
    """
    size = F.size("rule_attrs")
    steps = wanted.select("rule_attrs", F.explode(F.sequence(F.lit(1), size)).alias("at")).select(
        F.slice("rule_attrs", 1, F.col("at") - 1).alias("prefix"), F.element_at("rule_attrs", F.col("at")).alias("attr")
    )
    steps = settle(steps.distinct())
    deepest = steps.agg(F.max(F.size("prefix"))).first()[0]
    here = shapes.select("attrs", F.array().cast("array<string>").alias("prefix"))
    reached = None
    for _ in range(0 if deepest is None else deepest + 1):
        last = F.element_at("prefix", -1)
        rest = F.when(F.size("prefix") == 0, F.col("attrs")).otherwise(F.filter("attrs", lambda a: a > last))
        met = here.select("attrs", "prefix", F.explode(F.array_distinct(rest)).alias("attr")).join(steps, ["prefix", "attr"])
        here = settle(met.select("attrs", F.concat("prefix", F.array("attr")).alias("prefix")))
        reached = here if reached is None else reached.unionByName(here)
    if reached is None:  # no rules
        return wanted.select(F.col("rule_attrs").alias("attrs"), "rule_attrs", "wanted")
    return reached.withColumnRenamed("prefix", "rule_attrs").join(wanted, "rule_attrs")


def subsets(items: Column, most: int) -> Column:
    """All subsets of an array of at most `most` elements, each in the order of the array."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(
        items,
        none,
        lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda c: F.size(c) < most), lambda c: F.concat(c, F.array(x)))),
    )


def rule_counts(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """Counts per rule among the profiles that have every attribute of the rule.

    `n_complete, n_x, n_y, n_xy`, keyed by the rule's item arrays. Rules that use the same attributes share one
    contingency table over their items. Its cells are summed in each task before
    they are shuffled; then every subset of a cell's items gets the cell's count, so that the sum of a subset
    is the number of transactions that hold it. A rule meets these sums by equi-join on (attributes, items):
    the empty subset, its antecedent, its consequent, and both.
    """
    both = F.array_sort(F.array_distinct(F.concat(*RULE)))
    keyed = settle(
        rules.select(*RULE, both.alias("both")).distinct()
        .withColumn("rule_attrs", F.sort_array(F.array_distinct(F.transform("both", C.item_attr))))
    )
    longest = keyed.agg(F.max(F.size("both"))).first()[0] or 0
    wanted = (
        keyed.select("rule_attrs", F.explode("both").alias("item"))
        .groupBy("rule_attrs")
        .agg(F.sort_array(F.collect_set("item")).alias("wanted"))
    )
    counted = settle(profiles.groupBy("attrs").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    # A list of attributes that most panels have is met in as many parts as its profiles need.
    held = held_sets(counted.select("attrs"), settle(wanted)).join(counted, "attrs")
    held = held.select("attrs", "rule_attrs", "wanted", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hot = counted.where("parts > 1")
    part = F.pmod(F.xxhash64("items"), F.coalesce("parts", F.lit(1))).cast("int")
    cells = (
        profiles.join(hot, "attrs", "left")
        .select("attrs", "items", "n", part.alias("part"))
        .join(held, ["attrs", "part"])
        .groupBy("rule_attrs", F.array_intersect("wanted", "items").alias("cell"))
        .agg(F.sum("n").alias("n"))
    )
    sums = (
        cells.select("rule_attrs", F.explode(subsets(F.col("cell"), longest)).alias("items"), "n")
        .groupBy("rule_attrs", "items")
        .agg(F.sum("n").alias("n"))
    )
    sides = F.array(
        F.struct(F.lit("n_complete").alias("count"), F.array().cast("array<string>").alias("items")),
        F.struct(F.lit("n_x").alias("count"), F.array_sort(F.array_distinct("antecedent")).alias("items")),
        F.struct(F.lit("n_y").alias("count"), F.array_sort(F.array_distinct("consequent")).alias("items")),
        F.struct(F.lit("n_xy").alias("count"), F.col("both").alias("items")),
    )
    asked = keyed.select(*RULE, "rule_attrs", F.inline(sides))
    counts = ("n_complete", "n_x", "n_y", "n_xy")
    return (
        asked.join(sums, ["rule_attrs", "items"])
        .groupBy(*RULE)
        .agg(*[F.coalesce(F.max(F.when(F.col("count") == c, F.col("n"))), F.lit(0)).alias(c) for c in counts])
    )


def complete_count(profiles: DataFrame):
    """Number of complete transactions as a scalar column."""
    return scalar_of(profiles, F.coalesce(F.sum("n"), F.lit(0)))


def item_support(profiles: DataFrame) -> DataFrame:
    """`item, item_support` among complete transactions."""
    return (
        profiles.select(F.explode("items").alias("item"), "n")
        .groupBy("item")
        .agg(F.sum("n").alias("item_n"))
        .withColumn("item_support", F.try_divide(F.col("item_n"), complete_count(profiles)))
    )


def rar(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds the counts, `real_support`, `rar_support_exact` and `real_lift`.

    `real_support` scales the share of baskets by the number of complete
    transactions over those complete for the rule; `rar_support_exact` is the
    share of the latter that hold the whole rule.
    """
    n_all = complete_count(profiles)
    counted = rules.join(rule_counts(rules, profiles), RULE, "left").withColumn("n_all", n_all)
    for c in ("n_complete", "n_x", "n_y", "n_xy"):
        counted = counted.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    divisor = F.col("n_x") * F.col("n_y")
    return (
        counted.withColumn("real_support", F.try_divide(F.col("support") * F.col("n_all"), F.col("n_complete")))
        .withColumn("rar_support_exact", F.try_divide(F.col("n_xy"), F.col("n_complete")))
        .withColumn(
            "real_lift",
            F.when(divisor > 0, F.col("n_xy") * F.col("n_complete") / divisor).otherwise(F.lit(1.0)),
        )
    )


def cross_support(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds `cross_support`: smallest over largest item support of a rule."""
    ratio = (
        rules.select(*KEY, F.explode(F.concat("antecedent", "consequent")).alias("item"))
        .join(item_support(profiles), "item", "left")
        .groupBy(*KEY)
        .agg(
            F.least(F.lit(1.0), F.min(F.coalesce("item_support", F.lit(0.0)))).alias("lo"),
            F.greatest(F.lit(0.0), F.max(F.coalesce("item_support", F.lit(0.0)))).alias("hi"),
        )
        .select(*KEY, F.try_divide(F.col("lo"), F.col("hi")).alias("cross_support"))
    )
    return rules.join(ratio, KEY, "left")


def real_measures(rules: DataFrame, profiles: DataFrame, approach: str = "RAR") -> DataFrame:
    """Adds `real_support` and `real_lift` by RAR, CROSS or, otherwise, the plain measures."""
    if approach == "RAR":
        extra = ("n_complete", "n_x", "n_y", "n_xy", "n_all", "rar_support_exact")
        return rar(rules, profiles).drop(*extra)
    if approach == "CROSS":
        crossed = cross_support(rules, profiles)
        return crossed.withColumnRenamed("cross_support", "real_support").withColumn("real_lift", F.col("lift"))
    return rules.withColumn("real_support", F.col("support")).withColumn("real_lift", F.col("lift"))


def by_real_support(rules: DataFrame, threshold: float) -> DataFrame:
    return rules.where(F.col("real_support") >= threshold)
