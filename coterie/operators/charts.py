"""Tables behind the charts of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C

NO_CLASS = "no_class"


def rules_to_show(rules: DataFrame, antecedent: str | None = None, consequent: str | None = None) -> DataFrame:
    """Rules whose every antecedent / consequent item contains the text."""
    for side, text in (("antecedent", antecedent), ("consequent", consequent)):
        if text is not None:
            rules = rules.where(F.forall(side, lambda x: F.contains(x, F.lit(text))))
    return rules


def edge_items(rules: DataFrame, weight: str = "lift", hidden: Sequence[str] = ()) -> DataFrame:
    """`ant, con, weight` for each pair of an antecedent and a consequent item."""
    rows = rules.select(F.explode("antecedent").alias("ant"), "consequent", F.col(weight).alias("weight"))
    rows = rows.select("ant", F.explode("consequent").alias("con"), "weight")
    if hidden:
        rows = rows.where(~C.item_attr(F.col("ant")).isin(*hidden) & ~C.item_attr(F.col("con")).isin(*hidden))
    return rows


def chart_edges(
    rules: DataFrame, weight: str = "lift", hidden: Sequence[str] = (), changes: Mapping[str, str] | None = None
) -> DataFrame:
    """Summed weight per renamed pair of items."""
    rows = edge_items(rules, weight, hidden)
    changes = changes or {}
    return rows.groupBy(
        C.rename(F.col("ant"), changes).alias("ant"), C.rename(F.col("con"), changes).alias("con")
    ).agg(F.sum("weight").alias("weight"))


def grouping_text(item: Column, conditions: Mapping[str, int]) -> Column:
    """Joined left / right parts of an item; other conditions add nothing."""
    parts = [F.lit("")]
    for kind, size in conditions.items():
        if kind == "left":
            parts.append(F.left(item, F.lit(size)))
        elif kind == "right":
            parts.append(F.right(item, F.lit(size)))
    return F.concat(*parts)


def node_classes(
    rules: DataFrame,
    classes: DataFrame,
    conditions: Mapping[str, int] | None = None,
    hidden: Sequence[str] = (),
    changes: Mapping[str, str] | None = None,
) -> DataFrame:
    """`node, class` by the dimension or by parts of the item text.

    Items that fall together once renamed take the smallest class name.
    """
    items = edge_items(rules, "lift", hidden).select(F.explode(F.array("ant", "con")).alias("item")).distinct()
    if conditions:
        named = items.withColumn("class", grouping_text(F.col("item"), conditions))
    else:
        dim = classes.select(F.col("drug").alias("attr"), "class")
        named = items.withColumn("attr", C.item_attr(F.col("item"))).join(dim, "attr", "left")
        named = named.withColumn("class", F.coalesce("class", F.lit(NO_CLASS)))
    return named.groupBy(C.rename(F.col("item"), changes or {}).alias("node")).agg(F.min("class").alias("class"))


def measures(rules: DataFrame) -> DataFrame:
    """Measure triple with the rule as label."""
    return rules.select(
        "support", "confidence", "lift", C.rule_text(F.col("antecedent"), F.col("consequent"), "->").alias("label")
    )


def _class_and_name(side: str) -> Column:
    return F.concat_ws("_", F.coalesce(F.col(f"{side}_class"), F.lit(NO_CLASS)), F.col(side))


def chord_links(edges: DataFrame, node_class: DataFrame) -> DataFrame:
    """`source, target, value` with the class in front of each name."""
    out = edges
    for side in ("ant", "con"):
        out = out.join(node_class.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class")), side, "left")
    return out.select(_class_and_name("ant").alias("source"), _class_and_name("con").alias("target"), F.col("weight").alias("value"))


def chord_nodes(edges: DataFrame, node_class: DataFrame) -> DataFrame:
    """`index, label` of the nodes, in index order."""
    found = edges.select(F.explode(F.array("ant", "con")).alias("node")).distinct()
    named = found.join(node_class, "node", "left")
    index = F.concat_ws("_", F.coalesce("class", F.lit(NO_CLASS)), F.col("node"))
    return named.select(index.alias("index"), F.col("node").alias("label")).orderBy("index")


def arrow_labels(edges: DataFrame) -> DataFrame:
    return edges.select("ant", "con", F.format_string("%.2f", F.col("weight")).alias("label"))


def listed(edges: DataFrame) -> DataFrame:
    """Edges in order of antecedent and consequent."""
    return edges.orderBy("ant", "con")
