"""Minimal cost-complexity pruning of a fitted tree.

The risk of a tree is the Gini impurity of its leaves, weighted by their share of the rows; each leaf
costs alpha more. As alpha grows, inner nodes are cut to leaves one after the other, weakest link first:
the node whose subtree lowers the risk least per leaf. Work on single nodes is bounded by the
model (2 ** depth leaves, which Spark ML itself holds on the driver); rows are only ever counted by leaf
and label, in Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Risks are compared at so many digits, so that ties do not hang on the order of sums.
DIGITS = 12


@dataclass(frozen=True)
class Node:
    """A node of a fitted tree; a leaf has no children."""

    counts: tuple[float, ...]
    prediction: float
    left: int = -1
    right: int = -1
    feature: int = -1
    threshold: float = 0.0

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass(frozen=True)
class Cut:
    """An inner node turned into a leaf at alpha, with the leaves and the risk that remain."""

    node: int
    alpha: float
    leaves: int
    risk: float


def weight(rows: DataFrame) -> Column:
    """How many rows a row stands for: its `n`, else itself."""
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("long")


def read_nodes(table: DataFrame) -> dict[int, Node]:
    """The nodes of a saved tree model by number; numbers follow the tree from left to right, parents first."""
    rows = table.select("id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect()
    out = {}
    for r in rows:
        threshold = r["split"]["leftCategoriesOrThreshold"]
        out[r["id"]] = Node(
            tuple(r["impurityStats"]), r["prediction"], r["leftChild"], r["rightChild"],
            r["split"]["featureIndex"], threshold[0] if threshold else 0.0,
        )
    return out


def risk_of(node: Node, total: float) -> float:
    """Gini impurity of a node times its share of all rows."""
    n = sum(node.counts)
    return (n - sum(c * c for c in node.counts) / n) / total if n else 0.0


def weakest_links(nodes: Mapping[int, Node], root: int = 0) -> list[Cut]:
    """Inner nodes in the order they are cut, down to the root alone; ties go to the smaller number."""
    total = sum(nodes[root].counts)
    risk = {i: risk_of(n, total) for i, n in nodes.items()}
    parent = {c: i for i, n in nodes.items() if not n.is_leaf for c in (n.left, n.right)}
    below = {i: (risk[i], 1) for i, n in nodes.items() if n.is_leaf}
    for i in sorted(nodes, reverse=True):  # children have larger numbers than their parent
        n = nodes[i]
        if not n.is_leaf:
            below[i] = (below[n.left][0] + below[n.right][0], below[n.left][1] + below[n.right][1])

    def gain(i: int) -> float:
        return round((risk[i] - below[i][0]) / (below[i][1] - 1), DIGITS)

    open_nodes = {i for i, n in nodes.items() if not n.is_leaf}
    heap = [(gain(i), i) for i in open_nodes]
    heapq.heapify(heap)
    cuts: list[Cut] = []
    while heap:
        alpha, weakest = heapq.heappop(heap)
        if weakest not in open_nodes or alpha != gain(weakest):
            continue  # cut with an ancestor, or weighed anew since
        under = [weakest]
        while under:
            i = under.pop()
            if i in open_nodes:
                open_nodes.discard(i)
                under += [nodes[i].left, nodes[i].right]
        lost, fewer = risk[weakest] - below[weakest][0], below[weakest][1] - 1
        below[weakest] = (risk[weakest], 1)
        i = weakest
        while i in parent:
            i = parent[i]
            below[i] = (below[i][0] + lost, below[i][1] - fewer)
            heapq.heappush(heap, (gain(i), i))
        # A later cut never costs less than an earlier one, but for the rounding.
        alpha = max(alpha, cuts[-1].alpha if cuts else 0.0)
        cuts.append(Cut(weakest, alpha, below[root][1], below[root][0]))
    return cuts


def kept_nodes(nodes: Mapping[int, Node], alpha: float, root: int = 0) -> dict[int, Node]:
    """The tree pruned at alpha: nodes cut at alpha or less have become leaves. Alpha 0 leaves the tree whole."""
    cut = {c.node for c in weakest_links(nodes, root) if c.alpha <= alpha} if alpha > 0 else set()
    kept, ahead = {}, [root]
    while ahead:
        i = ahead.pop()
        n = nodes[i]
        kept[i] = Node(n.counts, n.prediction) if i in cut else n
        if not kept[i].is_leaf:
            ahead += [n.left, n.right]
    return kept


def leaf_spans(spark: SparkSession, nodes: Mapping[int, Node], root: int = 0) -> DataFrame:
    """`leaf, step, until, node, prediction`: what a row of a leaf is given after `step` cuts and before `until`.

    Leaves are numbered from left to right, as Spark ML numbers them. `until` is null for the last span.
    """
    at = {c.node: step for step, c in enumerate(weakest_links(nodes, root), 1)}
    rows, leaves, ahead = [], 0, [(root, ())]
    while ahead:
        i, above = ahead.pop()
        n = nodes[i]
        if not n.is_leaf:
            path = (*above, i)
            ahead += [(n.right, path), (n.left, path)]
            continue
        # From the leaf upwards, a node counts if it is cut later than all below it.
        spans = [(0, i)]
        for j in reversed(above):
            if j in at and at[j] > spans[-1][0]:
                spans.append((at[j], j))
        ends = [s for s, _ in spans[1:]] + [None]
        rows += [(leaves, step, until, j, nodes[j].prediction) for (step, j), until in zip(spans, ends)]
        leaves += 1
    return spark.createDataFrame(rows, "leaf int, step int, until int, node int, prediction double")


def path_table(spark: SparkSession, nodes: Mapping[int, Node], root: int = 0) -> DataFrame:
    """`step, node, alpha, leaves, risk`: the cuts in order, after step 0 with the whole tree."""
    total = sum(nodes[root].counts)
    leaves = [n for n in nodes.values() if n.is_leaf]
    rows = [(0, None, 0.0, len(leaves), sum(risk_of(n, total) for n in leaves))]
    rows += [(step, c.node, c.alpha, c.leaves, c.risk) for step, c in enumerate(weakest_links(nodes, root), 1)]
    return spark.createDataFrame(rows, "step int, node int, alpha double, leaves int, risk double")


def path_accuracy(scored: DataFrame, nodes: Mapping[int, Node]) -> DataFrame:
    """The path with `rows, hits, accuracy` of labelled rows (`leaf, target`, maybe `n`) at every step.

    Rows are counted by leaf and label once. A span adds its hits where it begins and takes them back where it
    ends, so that a running sum over the steps, of which there are no more than inner nodes, gives all accuracies.
    """
    spark = scored.sparkSession
    scored = scored.select("leaf", "target", weight(scored).alias("__n"))
    counts = scored.groupBy(F.col("leaf").cast("int").alias("leaf"), "target").agg(F.sum("__n").alias("n"))
    hits = counts.join(leaf_spans(spark, nodes), "leaf").where(F.col("prediction") == F.col("target"))
    change = hits.select(
        F.inline(F.array(F.struct("step", F.col("n").alias("d")), F.struct(F.col("until").alias("step"), (-F.col("n")).alias("d"))))
    ).where("step is not null")
    changes = change.groupBy("step").agg(F.sum("d").alias("d"))
    rows = scored.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).scalar()
    path = path_table(spark, nodes).join(changes, "step", "left").fillna(0, ["d"])
    running = F.sum("d").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return path.withColumn("rows", rows).withColumn("hits", running).drop("d").withColumn(
        "accuracy", F.try_divide(F.col("hits"), F.col("rows"))
    )


def tree_text(nodes: Mapping[int, Node], features: list[str], labels: list[str], root: int = 0) -> str:
    """The tree as lines, a level of `|   ` for each split above."""
    lines, ahead = [], [(root, 0, "")]
    while ahead:
        i, depth, condition = ahead.pop()
        n = nodes[i]
        bars = "|   " * (depth - 1) + "|--- " if depth else ""
        if condition:
            lines.append(bars + condition)
            bars = "|   " + bars
        if n.is_leaf:
            place = int(n.prediction)
            lines.append(f"{bars or '|--- '}class: {labels[place] if place < len(labels) else place}")
            continue
        name = features[n.feature]
        ahead.append((n.right, depth + 1, f"{name} > {n.threshold:.2f}"))
        ahead.append((n.left, depth + 1, f"{name} <= {n.threshold:.2f}"))
    return "\n".join(lines)
