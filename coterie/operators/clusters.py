"""Hierarchical clustering of transactions and the profiles of its clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from coterie.functions import columns as C
from coterie.functions.blocks import CLUSTER, box, merge_within, nearest, nearest_within
from coterie.functions.frames import bounded_names, ranked, scalar_of, settle

CLUSTERS = 10
SIGNIFICANCE = 0.05
TOP_VALUES = 5
NO_RESISTANCE = "All susceptible"
#: Clusters in a block, whose matrix of distances one task holds (134 MB).
BLOCK = 4096
#: Blocks that a block's own merges are checked against one by one; one bound covers all others.
NEAR_BLOCKS = 64
SLACK = 1e-9
NEAREST = "block int, key string, other string, d2 double"
STEP = (
    "key string, node string, size double, leaves long, sums array<double>, height double, level int, "
    "left string, right string, right_key string, alive boolean"
)


# ---- profiles ---------------------------------------------------------------


def target_names(panel: DataFrame) -> list[str]:
    """Sorted names of the tests."""
    return bounded_names(panel.select(F.explode("target.attr").alias("attr")), "attr")


def status_label() -> Column:
    """Sorted list of the tests that are more than susceptible."""
    found = F.transform(F.filter("target", lambda x: C.severity(x["value"]) > 1), lambda x: x["attr"])
    found = F.sort_array(found)
    return C.list_text(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_RESISTANCE))))


def status_profiles(panel: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """`id, label, other` and one severity column per test, 0 where it was not tested."""
    names = list(names) if names is not None else target_names(panel)
    targets = F.map_from_entries("target")
    rows = panel.select("id", status_label().alias("label"), "other", targets.alias("__t"))
    values = [C.severity(F.element_at("__t", n)).alias(n) for n in names]
    return rows.select("id", "label", "other", *values)


def status_vectors(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """`id, label, other, vector`: severities in the order of the names, 0 where a test was not done.

    Names stay values, so any text may be one.
    """
    rows = panel.select("id", status_label().alias("label"), "other", F.map_from_entries("target").alias("t"))
    each = F.transform(F.array(*map(F.lit, names)), lambda n: C.severity(F.element_at("t", n)).cast("double"))
    return rows.select("id", "label", "other", each.alias("vector"))


def indicator_vectors(profiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """`id, label, target, vector`: 0 or 1 per named indicator."""
    each = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_contains("indicators", n).cast("double"))
    return profiles.select("id", "label", "target", each.alias("vector"))


def _is_resistant() -> Column:
    return F.exists("target", lambda x: x["value"].isin(*C.FOCUS))


def attribute_profiles(panel: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """`id, label, indicators, target` of panels with a resistant or intermediate test.

    Indicators are the sorted `attr` + `value` texts of the chosen attributes.
    """
    chosen = F.transform(
        F.filter("other", lambda x: x["attr"].isin(*attributes)), lambda x: F.concat(x["attr"], x["value"])
    )
    return (
        panel.where(_is_resistant())
        .withColumn("indicators", F.sort_array(chosen))
        .select("id", C.list_text(F.col("indicators")).alias("label"), "indicators", "target")
    )


def indicator_columns(profiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """One 0/1 column per named indicator."""
    return profiles.select(
        "id", "label", *[F.array_contains("indicators", n).cast("int").alias(n) for n in names]
    )


# ---- Ward clustering --------------------------------------------------------


def weighted_points(rows: DataFrame) -> DataFrame:
    """Distinct vectors with their number of rows: `node, size, vector`."""
    return (
        rows.groupBy("vector").agg(F.count("*").cast("double").alias("size"))
        .withColumn("node", point_key("vector"))
    )


def point_key(vector: str | Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: v.cast("string")), ",")


def _placed(clusters: DataFrame, count: int, block: int) -> DataFrame:
    """Clusters with a block number; neighbours in the order of keys share a block."""
    blocks = math.ceil(count / block)
    return settle(clusters.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()))


def _block_pairs(placed: DataFrame) -> DataFrame:
    """`block, other, bound, box` of every two blocks: what their clusters are apart at least, and the other's box.

    Pairs of blocks, not of clusters: a row per block is met with a row per block.
    """
    boxes = settle(placed.groupBy("block").applyInPandas(box, "block int, least double, low array<double>, high array<double>"))
    many = max(1, boxes.count())
    numbers = boxes.select("block").agg(F.max("block")).first()[0] if many > 1 else 0
    named = boxes.select("block", F.struct("least", "low", "high").alias("mine"))
    other = named.select(F.col("block").alias("other"), F.col("mine").alias("box"))
    pairs = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(numbers)))).where("other <> block").join(other, "other")
    gaps = F.zip_with(
        F.arrays_zip(F.col("mine.low").alias("a"), F.col("mine.high").alias("b")),
        F.arrays_zip(F.col("box.low").alias("a"), F.col("box.high").alias("b")),
        lambda x, y: F.greatest(F.lit(0.0), x["a"] - y["b"], y["a"] - x["b"]),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    mine, its = F.col("mine.least"), F.col("box.least")
    return pairs.select("block", "other", (apart * mine * its / (mine + its) * (1 - SLACK)).alias("bound"), "box")


def _merged_within(placed: DataFrame) -> DataFrame:
    """Each block's merges that no other block can touch, and its clusters left."""
    order = Window.partitionBy("block").orderBy("bound", "other")
    near = _block_pairs(placed).withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEAR_BLOCKS + 1)
    near = near.groupBy("block").agg(
        F.collect_list(F.when(F.col("place") <= NEAR_BLOCKS, F.col("box"))).alias("boxes"),
        F.coalesce(F.min(F.when(F.col("place") > NEAR_BLOCKS, F.col("bound"))), F.lit(float("inf"))).alias("cap"),
    )
    return settle(placed.groupBy("block").cogroup(near.groupBy("block")).applyInPandas(merge_within, STEP))


def _merged_across(clusters: DataFrame, placed: DataFrame) -> DataFrame:
    """Merges of clusters that are each other's nearest among all."""
    found = settle(placed.groupBy("block").applyInPandas(nearest_within, NEAREST))
    # a block's clusters look into those blocks only that may hold something nearer
    farthest = placed.select("block").distinct().join(found.groupBy("block").agg(F.max("d2").alias("far")), "block", "left")
    farthest = farthest.fillna(float("inf"), ["far"])
    cells = settle(_block_pairs(placed).join(farthest, "block").where(F.col("bound") <= F.col("far")).select("block", "other"))
    row = [*CLUSTER, "block"]
    tasks = min(max(1, cells.count()), 4 * clusters.sparkSession.sparkContext.defaultParallelism)
    left = placed.join(cells, "block").select("other", *row).repartition(tasks, "block", "other")
    right = placed.withColumnRenamed("block", "other").join(cells, "other").select("other", *row).toDF("other", *row)
    right = right.repartition(tasks, "block", "other")
    across = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(nearest, NEAREST)
    best = settle(
        found.unionByName(across).groupBy("key").agg(F.min(F.struct("d2", "other")).alias("m"))
        .select("key", F.col("m.other").alias("other"), F.col("m.d2").alias("d2"))
    )
    back = best.select(F.col("other").alias("key"), F.col("key").alias("other"))
    pairs = best.where("key < other").join(back, ["key", "other"])
    a = clusters.select("key", *[F.col(c).alias(f"{c}_a") for c in CLUSTER[1:]])
    b = clusters.select(F.col("key").alias("other"), *[F.col(c).alias(f"{c}_b") for c in CLUSTER[1:]])
    return settle(
        pairs.join(a, "key").join(b, "other").select(
            "key",
            F.concat(F.lit("m:"), "other").alias("node"),
            (F.col("size_a") + F.col("size_b")).alias("size"),
            (F.col("leaves_a") + F.col("leaves_b")).alias("leaves"),
            F.zip_with("sums_a", "sums_b", lambda x, y: x + y).alias("sums"),
            F.greatest("d2", "height_a", "height_b").alias("height"),
            (F.greatest("level_a", "level_b") + 1).alias("level"),
            F.col("node_a").alias("left"),
            F.col("node_b").alias("right"),
            F.col("other").alias("right_key"),
            F.lit(True).alias("alive"),
        )
    )


def ward_merges(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Merge log of Ward clustering: `left, right, node, d2, size, leaves, level, key, right_key`.

    At every size the same two steps alternate until one cluster is left. Within blocks of at most about
    `block` clusters, pairs of nearest neighbours are joined as far as the bounds of
    the other blocks prove that nothing outside is nearer; then each cluster's nearest neighbour among all is
    found, looking only into blocks that may hold one, and pairs of nearest neighbours are joined.
    Ties go by (distance, smaller leaf key, larger leaf key). Joining such pairs in any order gives the tree
    of joining the nearest pair one at a time, so the tree does not depend on the blocks.
    `size` counts rows, `leaves` distinct vectors; a node is named by the key that its merge takes away.
    """
    whole = F.col("size")
    clusters = points.select(
        F.col("node").alias("key"), "node", whole.alias("size"), F.lit(1).cast("long").alias("leaves"),
        F.transform("vector", lambda v: v * whole).alias("sums"), F.lit(0.0).alias("height"), F.lit(0).alias("level"),
    )
    clusters = settle(clusters)
    log = clusters.sparkSession.createDataFrame([], STEP)
    count = clusters.count()
    while count > 1:
        within = _merged_within(_placed(clusters, count, block))
        log = log.unionByName(within.where(F.col("left").isNotNull()))
        clusters = within.where("alive").select(*CLUSTER)
        count = clusters.count()
        if count > 1:
            across = _merged_across(clusters, _placed(clusters, count, block))
            log = log.unionByName(across)
            gone = across.select(F.explode(F.array("key", "right_key")).alias("key"))
            clusters = settle(clusters.join(gone, "key", "left_anti").unionByName(across.select(*CLUSTER)))
            count = clusters.count()
    return settle(log.select("left", "right", "node", F.col("height").alias("d2"), "size", "leaves", "level", "key", "right_key"))


def _by_height(*, falling: bool = False) -> list[Column]:
    """Order of the merges; a merge never comes before those it rests on."""
    order = ["d2", "level", "key", "right_key"]
    return [F.desc(c) if falling else F.asc(c) for c in order]


def merge_tree(merges: DataFrame) -> DataFrame:
    """`step, left, right, node, distance, size, leaves` in order of distance."""
    return ranked(merges, _by_height(), "step").select(
        "step", "left", "right", "node", F.sqrt(2 * F.col("d2")).alias("distance"), "size", "leaves"
    )


def cut_tree(points: DataFrame, merges: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """`node, cluster` of the points when the last k - 1 merges are undone.

    Pointers to the merged cluster are doubled each round, so their number is
    logarithmic in the depth of the tree.
    """
    undone = merges.orderBy(*_by_height(falling=True)).limit(k - 1)
    kept = settle(merges.join(undone.select("node"), "node", "left_anti"))
    up = kept.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up"))
    up = settle(up)
    while True:
        higher = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = settle(up.join(higher, "up", "left").select("node", F.coalesce("next", "up").alias("up"), "next"))
        done = step.where(F.col("next").isNotNull()).isEmpty()
        up = step.select("node", "up")
        if done:
            break
    top = points.select("node", "size").join(up, "node", "left").select(
        "node", "size", F.coalesce("up", "node").alias("top")
    )
    sizes = top.groupBy("top").agg(F.sum("size").alias("rows"), F.min("node").alias("least"))
    numbers = ranked(sizes, [F.desc("rows"), F.col("least")], "cluster").select(
        "top", (F.col("cluster") - 1).alias("cluster")
    )
    return top.join(numbers, "top").select("node", "cluster")


def ward_clusters(rows: DataFrame, k: int = CLUSTERS, block: int = BLOCK) -> DataFrame:
    """`id, label, cluster` of rows with a `vector`."""
    points = settle(weighted_points(rows))
    assigned = cut_tree(points, ward_merges(points, block), k)
    return rows.select("id", "label", point_key("vector").alias("node")).join(assigned, "node").drop("node")


# ---- descriptions of clusters -----------------------------------------------


def cluster_members(assigned: DataFrame) -> DataFrame:
    """`cluster, label`: distinct labels of each cluster."""
    return assigned.select("cluster", "label").distinct()


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """`cluster, cluster_size, labels` with the distinct labels as a sorted list."""
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"), F.sort_array(F.collect_set("label")).alias("labels")
    )


def label_values(meta: DataFrame) -> DataFrame:
    """`label, attr, value, n`: how often the rows of a label have each value.

    `meta` holds `label` and `data`, an array of (attr, value).
    """
    return meta.select("label", F.inline("data")).groupBy("label", "attr", "value").agg(F.count("*").alias("n"))


def cluster_profiles(assigned: DataFrame, meta: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """`cluster, attr, value, n, pct, profile_rows` of values above the significance share.

    A profile counts all rows that carry one of the cluster's labels.
    """
    members = cluster_members(assigned)
    rows = meta.groupBy("label").agg(F.count("*").alias("rows"))
    totals = members.join(rows, "label").groupBy("cluster").agg(F.sum("rows").alias("profile_rows"))
    return (
        members.join(label_values(meta), "label")
        .groupBy("cluster", "attr", "value").agg(F.sum("n").alias("n"))
        .join(totals, "cluster")
        .where(F.col("n") > F.lit(significance) * F.col("profile_rows"))
        .withColumn("pct", F.round(F.col("n") * 100.0 / F.col("profile_rows"), 2))
    )


def profile_texts(profiles: DataFrame) -> DataFrame:
    """`cluster, analysis`: the profile as text, attributes and values in order, a value's share in percent.

    A value in a profile has more than the significance share, so an attribute of one value a row has
    20 values at most.
    """
    entries = F.sort_array(F.collect_list(F.struct("attr", "value", "pct")))
    named = F.transform(entries, lambda e: F.struct(C.item(e["attr"], e["value"]).alias("name"), e["pct"].cast("string").alias("value")))
    return profiles.groupBy("cluster").agg(C.dict_text(named).alias("analysis"))


def top_values(profiles: DataFrame, attribute: str, k: int = TOP_VALUES) -> DataFrame:
    """The k largest shares of one attribute per cluster; `drug` ranks the focused shares of all tests."""
    if attribute == "drug":
        chosen = profiles.where(F.col("value").isin(*C.FOCUS)).withColumn("entry", F.col("attr"))
        # One entry per test: the status listed last for it gives its share.
        chosen = chosen.groupBy("cluster", "entry").agg(F.max_by("pct", "value").alias("pct"))
    else:
        chosen = profiles.where(F.col("attr") == attribute).select("cluster", F.col("value").alias("entry"), "pct")
    order = Window.partitionBy("cluster").orderBy(F.desc("pct"), "entry")
    return chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hamming_distance(a: Column, b: Column) -> Column:
    """Distance of two arrays of (attr, value) with unique attributes: differing and one-sided attributes."""

    def names(c: Column) -> Column:
        return F.transform(c, lambda x: x["attr"])

    def texts(c: Column) -> Column:
        return F.transform(c, lambda x: C.item(x["attr"], x["value"]))

    common = F.size(F.array_intersect(names(a), names(b)))
    return F.size(a) + F.size(b) - common - F.size(F.array_intersect(texts(a), texts(b)))


def hamming_pairs(panel: DataFrame, pairs: DataFrame, entries: str = "target") -> DataFrame:
    """`id1, id2, distance` for the given pairs of ids."""
    one = panel.select(F.col("id").alias("id1"), F.col(entries).alias("e1"))
    two = panel.select(F.col("id").alias("id2"), F.col(entries).alias("e2"))
    joined = pairs.join(one, "id1").join(two, "id2")
    return joined.select("id1", "id2", hamming_distance(F.col("e1"), F.col("e2")).alias("distance"))


def row_share(assigned: DataFrame) -> DataFrame:
    """Cluster sizes as a share of all rows."""
    total = scalar_of(assigned, F.count("*"))
    return assigned.groupBy("cluster").agg(F.count("*").alias("cluster_size")).withColumn("share", F.col("cluster_size") / total)
