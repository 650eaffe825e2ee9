"""Co-occurrence network of tests and attribute values, and its graph measures.

Graph frames have the size of the vocabulary, never of the data. Rounds fetch a
single row to decide whether to go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import ranked, scalar_of, settle

SUPPORT_THRESHOLD = 0.01
LIFT_THRESHOLD = 1.01
#: So many sources are walked at a time.
SOURCE_BATCH = 4096
EDGE = ["kind", "src", "dst", "support", "lift"]


def _ratio(num: Column, den: Column, default: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def _lift(co: str, total: str, n1: str, n2: str) -> Column:
    return _ratio(F.col(co) * F.col(total), F.col(n1) * F.col(n2), 1.0)


def _flagged(entries: str) -> Column:
    """Entries with a mark on the first value of each attribute."""
    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.col(entries), i - 1)["attr"] == x["attr"], F.lit(False))

    return F.transform(
        entries,
        lambda x, i: F.named_struct(
            F.lit("attr"), x["attr"], F.lit("value"), x["value"], F.lit("first"), ~again(x, i)
        ),
    )


def target_target(profiles: DataFrame, positive: str = C.POSITIVE) -> DataFrame:
    """Pairs of tests: both positive over both tested, and lift.

    Pairs are taken from distinct profiles with their number, and added up in
    each task before the shuffle.
    """
    rows = (
        profiles.select("n", "target", F.explode("target").alias("a"))
        .select("n", "a", F.explode("target").alias("b"))
        .where(F.col("a.attr") > F.col("b.attr"))
    )
    pos_a, pos_b = F.col("a.value") == positive, F.col("b.value") == positive
    return (
        rows.groupBy(F.col("a.attr").alias("src"), F.col("b.attr").alias("dst"))
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(pos_a & pos_b, F.col("n")).otherwise(0)).alias("co"),
            F.sum(F.when(pos_a, F.col("n")).otherwise(0)).alias("n1"),
            F.sum(F.when(pos_b, F.col("n")).otherwise(0)).alias("n2"),
        )
        .select(
            F.lit("target_target").alias("kind"), "src", "dst",
            _ratio(F.col("co"), F.col("total"), 0.0).alias("support"), _lift("co", "total", "n1", "n2").alias("lift"),
        )
    )


def target_attribute(profiles: DataFrame, positive: str = C.POSITIVE) -> DataFrame:
    """Tests against attribute values: positive share among the value, and lift."""
    rows = (
        profiles.select("n", F.explode("target").alias("t"), _flagged("other").alias("o"))
        .select("n", F.col("t.attr").alias("src"), (F.col("t.value") == positive).alias("pos"), F.inline("o"))
        .groupBy("src", "attr", "value")
        .agg(
            F.sum("n").alias("n2"),
            F.sum(F.when(F.col("pos"), F.col("n")).otherwise(0)).alias("co"),
            F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("t_n"),
            F.sum(F.when(F.col("first") & F.col("pos"), F.col("n")).otherwise(0)).alias("t_pos"),
        )
    )
    rows = settle(rows)  # used twice; as wide as the vocabulary
    totals = rows.groupBy("src", "attr").agg(F.sum("t_n").alias("total"), F.sum("t_pos").alias("n1"))
    return rows.join(totals, ["src", "attr"]).select(
        F.lit("target_other").alias("kind"), "src", C.item(F.col("attr"), F.col("value")).alias("dst"),
        _ratio(F.col("co"), F.col("n2"), 0.0).alias("support"), _lift("co", "total", "n1", "n2").alias("lift"),
    )


def attribute_attribute(profiles: DataFrame) -> DataFrame:
    """Pairs of values of different attributes: share having both, and lift."""
    flagged = profiles.groupBy("other").agg(F.sum("n").alias("n")).select("n", _flagged("other").alias("o"))
    rows = (
        flagged.select("n", "o", F.explode("o").alias("a"))
        .select("n", "a", F.explode("o").alias("b"))
        .where(F.col("a.attr") > F.col("b.attr"))
        .groupBy(
            F.col("a.attr").alias("attr1"), F.col("a.value").alias("value1"),
            F.col("b.attr").alias("attr2"), F.col("b.value").alias("value2"),
        )
        .agg(
            F.sum("n").alias("co"),
            F.sum(F.when(F.col("b.first"), F.col("n")).otherwise(0)).alias("c1"),
            F.sum(F.when(F.col("a.first"), F.col("n")).otherwise(0)).alias("c2"),
            F.sum(F.when(F.col("a.first") & F.col("b.first"), F.col("n")).otherwise(0)).alias("c"),
        )
    )
    rows = settle(rows)  # used four times; as wide as the vocabulary
    pair = ["attr1", "attr2"]
    totals = rows.groupBy(*pair).agg(F.sum("c").alias("total"))
    first = rows.groupBy(*pair, "value1").agg(F.sum("c1").alias("n1"))
    second = rows.groupBy(*pair, "value2").agg(F.sum("c2").alias("n2"))
    return (
        rows.join(totals, pair).join(first, [*pair, "value1"]).join(second, [*pair, "value2"])
        .select(
            F.lit("other_other").alias("kind"),
            C.item(F.col("attr1"), F.col("value1")).alias("src"),
            C.item(F.col("attr2"), F.col("value2")).alias("dst"),
            _ratio(F.col("co"), F.col("total"), 0.0).alias("support"), _lift("co", "total", "n1", "n2").alias("lift"),
        )
    )


def co_occurrence(profiles: DataFrame, bipartite: bool = True, positive: str = C.POSITIVE) -> DataFrame:
    """All pair statistics; the bipartite graph keeps tests against attribute values only."""
    out = target_attribute(profiles, positive)
    if not bipartite:
        out = out.unionByName(target_target(profiles, positive)).unionByName(attribute_attribute(profiles))
    return out


def network_edges(pairs: DataFrame, support: float = SUPPORT_THRESHOLD, lift: float = LIFT_THRESHOLD) -> DataFrame:
    return pairs.where((F.col("support") >= support) & (F.col("lift") >= lift))


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), *more)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """`node`: every node that has an edge."""
    return _ends(edges).distinct()


def strength(edges: DataFrame) -> DataFrame:
    """`node, strength`: sum of the lifts at a node."""
    return _ends(edges, "lift").groupBy("node").agg(F.sum("lift").alias("strength"))


def nodes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """`node, class, description, strength` with the class in the description of tests."""
    dim = classes.select(F.col("drug").alias("node"), "class")
    text = F.concat(F.col("node"), F.lit(" ("), F.col("class"), F.lit(")"))
    return strength(edges).join(dim, "node", "left").withColumn("description", F.coalesce(text, F.col("node")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    degrees = _ends(edges).groupBy("node").agg(F.count("*").alias("degree"))
    n = scalar_of(degrees, F.count("*"))
    return degrees.select("node", "degree", (F.col("degree") / (n - 1)).alias("degree_centrality"))


def _both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return settle(there.unionByName(back).distinct())


def _source_batches(adjacent: DataFrame, batch: int) -> list[DataFrame]:
    """The nodes in parts of about `batch` by hash: frames of paths then have `batch` x nodes rows, not nodes squared."""
    sources = settle(adjacent.select(F.col("src").alias("source")).distinct())
    parts = -(-sources.count() // batch)
    return [sources.where(F.pmod(F.xxhash64("source"), F.lit(parts)) == i) for i in range(parts)]


def _shortest_paths(adjacent: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Frames `source, node, sigma` by distance: number of shortest paths from every source."""
    level = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma"))
    levels = [settle(level)]
    while True:
        reached = (
            levels[-1].join(adjacent, F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        )
        # A neighbour lies at most one step nearer, so two levels suffice here.
        for seen in levels[-2:]:
            reached = reached.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        reached = settle(reached)
        if reached.isEmpty():
            return levels
        levels.append(reached)


def _flows(adjacent: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Dependency passed from each node to its predecessors one level nearer the source."""
    return (
        lower.select("source", F.col("node").alias("low"), F.col("sigma").alias("low_sigma"), "delta")
        .join(adjacent, F.col("low") == F.col("dst"))
        .join(upper.withColumnRenamed("node", "src"), ["source", "src"])
        .select("source", F.col("src").alias("node"), "low",
                (F.col("sigma") / F.col("low_sigma") * (1 + F.col("delta"))).alias("share"))
    )


def _gained(flow: DataFrame, upper: DataFrame) -> DataFrame:
    sums = flow.groupBy("source", "node").agg(F.sum("share").alias("delta"))
    return upper.join(sums, ["source", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


def _dependencies(adjacent: DataFrame, batch: int) -> Iterator[DataFrame]:
    """For each part of the sources, `source, node, low, share`: what passes from `low` up to `node`."""
    for sources in _source_batches(adjacent, batch):
        levels = _shortest_paths(adjacent, sources)
        lower = levels[-1].withColumn("delta", F.lit(0.0))
        for upper in reversed(levels[:-1]):
            flow = settle(_flows(adjacent, lower, upper))
            yield flow
            lower = _gained(flow, upper)


def betweenness(edges: DataFrame, batch: int = SOURCE_BATCH) -> DataFrame:
    """`node, betweenness`: unweighted shortest-path betweenness, normalised.

    Sources are walked in parts; of each part only the sums per node are kept.
    """
    adjacent = _both_ways(edges)
    members = settle(adjacent.select(F.col("src").alias("node")).distinct())
    sums = [members.withColumn("delta", F.lit(0.0))]
    for flow in _dependencies(adjacent, batch):
        # what reaches the source itself does not pass through it
        passed = flow.where(F.col("source") != F.col("node"))
        sums.append(settle(passed.groupBy("node").agg(F.sum("share").alias("delta"))))
    n = members.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return reduce(DataFrame.unionByName, sums).groupBy("node").agg((F.sum("delta") * scale).alias("betweenness"))


def edge_shares(edges: DataFrame, batch: int = SOURCE_BATCH) -> DataFrame:
    """`src, dst, share`: over all ordered pairs of nodes, the share of their shortest paths that use the edge."""
    adjacent = _both_ways(edges)
    ends = (F.least("node", "low").alias("src"), F.greatest("node", "low").alias("dst"))
    sums = [settle(flow.groupBy(*ends).agg(F.sum("share").alias("share"))) for flow in _dependencies(adjacent, batch)]
    if not sums:
        return edges.select("src", "dst", F.lit(0.0).alias("share")).limit(0)
    return reduce(DataFrame.unionByName, sums).groupBy("src", "dst").agg(F.sum("share").alias("share"))


def edge_betweenness(edges: DataFrame, batch: int = SOURCE_BATCH) -> DataFrame:
    """`src, dst, betweenness` of the edges, normalised by the number of node pairs."""
    n = scalar_of(_ends(edges).distinct(), F.count("*"))
    return edge_shares(edges, batch).select("src", "dst", (F.col("share") / (n * (n - 1))).alias("betweenness"))


# ---- communities ------------------------------------------------------------


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row `modularity, communities` of a partition `node, community`, weighted by lift."""
    side = communities.select("node", "community")
    placed = (
        edges.select("src", "dst", "lift")
        .join(side.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src")
        .join(side.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    )
    inside = F.when(F.col("c1") == F.col("c2"), F.col("lift")).otherwise(0.0)
    halves = placed.select(
        F.inline(F.array(F.struct(F.col("c1").alias("c"), F.col("lift").alias("k"), inside.alias("l")),
                         F.struct(F.col("c2").alias("c"), F.col("lift").alias("k"), F.lit(0.0).alias("l"))))
    )
    sums = halves.groupBy("c").agg(F.sum("k").alias("k"), F.sum("l").alias("l"))
    m = F.sum("k") / 2
    # sum(l)/m - sum(k^2)/(2m)^2 in one aggregate
    return sums.agg(
        (F.sum("l") / m - F.sum(F.col("k") * F.col("k")) / (4 * m * m)).alias("modularity"),
        F.count("*").alias("communities"),
    )


def greedy_communities(edges: DataFrame) -> DataFrame:
    """`node, community`: join the two communities that gain most modularity until none gains.

    Equal gains go by the names. Communities are numbered by size, largest first, the name settling ties.
    """
    members = settle(_ends(edges).distinct())
    moves = greedy_merges(edges, members)
    return _numbered(_heads(members, moves.select("node", F.col("into").alias("head"))))


def greedy_merges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """`node, into, gain, round`: the merges of the greedy search, each by the name of the community that goes.

    Communities of different components never gain by a merge and share no pair, so each
    round joins the best pair of every component; within one, a merge can change which
    pair is best. The table of pairs carries the weights of both ends and is kept from round to round: the
    pairs of a merged community take its name and its weight, and those that become one are summed.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    links = settle(edges.groupBy(a.alias("c1"), b.alias("c2")).agg(F.sum("lift").alias("w")))
    log = edges.sparkSession.createDataFrame([], "node string, into string, gain double, round int")
    m = links.agg(F.sum("w")).head()[0] or 0.0
    if m <= 0:
        return log
    # a community's weight: all ends of edges in it, both ends of a loop
    ends = links.select(F.inline(F.array(F.struct(F.col("c1").alias("c"), "w"), F.struct(F.col("c2").alias("c"), "w"))))
    weight = settle(ends.groupBy("c").agg(F.sum("w").alias("k")))
    part = components(edges, members).select(F.col("node").alias("c1"), F.col("head").alias("part"))
    pairs = settle(
        links.where("c1 <> c2").join(part, "c1").join(weight.toDF("c1", "k1"), "c1").join(weight.toDF("c2", "k2"), "c2")
        .select("part", "c1", "c2", "k1", "k2", "w")
    )
    gain = F.round(F.col("w") / m - F.col("k1") * F.col("k2") / (2 * m * m), 12)
    number = 0
    while True:
        number += 1
        first = F.min(F.struct((-F.col("gain")).alias("loss"), "c1", "c2", "k1", "k2"))
        best = pairs.withColumn("gain", gain).where("gain > 0").groupBy("part").agg(first.alias("b")).select("b.*")
        best = settle(best)
        if best.isEmpty():
            return settle(log)
        step = best.select(F.col("c2").alias("node"), F.col("c1").alias("into"), (-F.col("loss")).alias("gain"), F.lit(number).alias("round"))
        log = log.unionByName(step)
        if number % 20 == 0:
            log = settle(log)
        joined = F.col("k1") + F.col("k2")
        both = [F.struct(F.col(c).alias("c"), F.col("c1").alias("n"), joined.alias("k")) for c in ("c1", "c2")]
        new = best.select(F.inline(F.array(*both)))
        x = F.struct(F.coalesce("n1", "c1").alias("c"), F.coalesce("m1", "k1").alias("k"))
        y = F.struct(F.coalesce("n2", "c2").alias("c"), F.coalesce("m2", "k2").alias("k"))
        moved = pairs.join(new.toDF("c1", "n1", "m1"), "c1", "left").join(new.toDF("c2", "n2", "m2"), "c2", "left")
        moved = moved.select("part", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "w").where("x.c <> y.c")
        pairs = settle(
            moved.groupBy("part", F.col("x.c").alias("c1"), F.col("y.c").alias("c2"))
            .agg(F.max("x.k").alias("k1"), F.max("y.k").alias("k2"), F.sum("w").alias("w"))
        )


def _heads(members: DataFrame, up: DataFrame) -> DataFrame:
    """`node, head` at the end of each node's chain of moves `node, head`; chains halve every round."""
    up = settle(members.join(up, "node", "left").select("node", F.coalesce("head", "node").alias("head")))
    while True:
        next_up = up.select(F.col("node").alias("head"), F.col("head").alias("next"))
        step = settle(up.join(next_up, "head").select("node", "head", "next"))
        if step.where("head <> next").isEmpty():
            return step.select("node", "head")
        up = step.select("node", F.col("next").alias("head"))


def _numbered(placed: DataFrame) -> DataFrame:
    """Communities numbered 1.. by size descending, then by smallest node."""
    sizes = placed.groupBy("head").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    numbers = ranked(sizes, [F.desc("n"), F.col("least")], "community").select("head", "community")
    return placed.join(numbers, "head").select("node", "community")


def class_communities(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """`node, community`: tests by class, all other nodes together."""
    dim = classes.select(F.col("drug").alias("node"), "class")
    return _ends(edges).distinct().join(dim, "node", "left").select(
        "node", F.coalesce("class", F.lit("no_class")).alias("community")
    )


def components(edges: DataFrame, members: DataFrame) -> DataFrame:
    """`node, head`: smallest node name reachable from each node."""
    adjacent = _both_ways(edges)
    labels = settle(members.select("node", F.col("node").alias("head")))
    while True:
        offered = (
            adjacent.join(labels, F.col("src") == F.col("node"))
            .groupBy(F.col("dst").alias("node")).agg(F.min("head").alias("offer"))
        )
        after = settle(
            labels.join(offered, "node", "left").select(
                "node", F.least("head", F.coalesce("offer", "head")).alias("head"), F.col("head").alias("was")
            )
        )
        if after.where("head <> was").isEmpty():
            return after.select("node", "head")
        labels = after.select("node", "head")


def girvan_newman(edges: DataFrame, max_communities: int = 12) -> DataFrame:
    """`level, node, community`: the splits met while removing the busiest edges, up to the given number.

    Only the component that loses an edge is walked again; shares and components of the others are kept.
    Of equally busy edges the first by name goes.
    """
    members = settle(_ends(edges).distinct())
    left = settle(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    )
    parts = settle(components(left, members))
    shares = settle(edge_shares(left))
    count, level, out = parts.select("head").distinct().count(), 0, None
    while not shares.isEmpty():
        # one row: the busiest edge
        top = shares.orderBy(F.round("share", 9).desc(), "src", "dst").select("src", "dst").first()
        at_top = (F.col("src") == top["src"]) & (F.col("dst") == top["dst"])
        head = scalar_of(parts.where(F.col("node") == top["src"]), F.max("head"))
        inside = settle(parts.where(F.col("head") == head).select("node"))
        of_part = inside.withColumnRenamed("node", "src")
        remaining = settle(shares.join(of_part, "src", "left_semi").where(~at_top).select("src", "dst"))
        shares = settle(shares.join(of_part, "src", "left_anti").unionByName(edge_shares(remaining)))
        anew = components(remaining, inside)
        parts = settle(parts.join(inside, "node", "left_anti").unionByName(anew.select(*parts.columns)))
        now = parts.select("head").distinct().count()
        if now <= count:
            continue
        count = now
        if count > max_communities:
            break
        level += 1
        found = _numbered(parts).select(F.lit(level).alias("level"), "node", "community")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else members.select(F.lit(0).alias("level"), "node", F.lit(1).cast("bigint").alias("community"))


def colours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """`node, colour`: neighbours differ. Nodes that come first among their uncoloured neighbours choose in one round."""
    adjacent = settle(_both_ways(edges).where("src <> dst").select("src", "dst").distinct())
    open_nodes = settle(members.select("node", F.md5("node").alias("turn")))
    done = settle(open_nodes.limit(0).select("node", F.lit(0).alias("colour")))
    while not open_nodes.isEmpty():
        near = adjacent.join(open_nodes.toDF("dst", "their_turn"), "dst").groupBy(F.col("src").alias("node")).agg(
            F.min(F.struct("their_turn", "dst")).alias("first")
        )
        ready = open_nodes.join(near, "node", "left").where(
            F.col("first").isNull() | (F.struct(F.col("turn").alias("their_turn"), F.col("node").alias("dst")) < F.col("first"))
        )
        taken = adjacent.join(done.toDF("dst", "theirs"), "dst").groupBy(F.col("src").alias("node")).agg(
            F.collect_set("theirs").alias("taken")
        )
        none = F.array().cast("array<int>")
        free = F.coalesce("taken", none)
        # the smallest number that no neighbour has
        colour = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(free)), free))
        chosen = settle(ready.join(taken, "node", "left").select("node", colour.alias("colour")))
        done = settle(done.unionByName(chosen))
        open_nodes = settle(open_nodes.join(chosen, "node", "left_anti"))
    return done


def fluid_seeds(edges: DataFrame, members: DataFrame, k: int, seed: int) -> DataFrame:
    """`node, fluid`: one node of every component, then further ones up to k, in the order of a hash."""
    order = F.md5(F.concat_ws(":", F.col("node"), F.lit(str(seed))))
    placed = components(edges, members).withColumn("turn", order)
    first = placed.withColumn("later", F.row_number().over(Window.partitionBy("head").orderBy("turn", "node")) > 1)
    chosen = ranked(first, [F.col("later"), F.col("turn"), F.col("node")], "place")
    return chosen.where((F.col("place") <= k) | ~F.col("later")).select("node", F.col("node").alias("fluid"))


def _pressure(adjacent: DataFrame, labels: DataFrame) -> DataFrame:
    """`node, fluid, d`: how dense each fluid is around a node, the node included; `own` marks its present one."""
    density = labels.where(F.col("fluid").isNotNull()).groupBy("fluid").agg((1.0 / F.count("*")).alias("d"))
    held = labels.join(density, "fluid")
    around = (
        adjacent.join(held.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "fluid", "d")
        .unionByName(held.select("node", "fluid", "d"))
        .groupBy("node", "fluid").agg(F.round(F.sum("d"), 12).alias("d"))
    )
    own = labels.select("node", "fluid", F.lit(1).alias("own"))
    return around.join(own, ["node", "fluid"], "left").fillna(0, ["own"])


def fluid_communities(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """`node, community, converged`: fluids spread from seeded nodes, each of total density 1.

    Every component has a fluid, so every node gets one; there are k communities, or as
    many as components if these are more. Nodes of one colour have no edge between them and
    take the fluid that is densest around them at once; then the densities are summed
    anew and the next colour follows. A node keeps its fluid on a tie. The rounds
    end when none moves. Rounds follow from the labels alone, so should a state ever come
    back the rounds would go on in a circle: they stop there, and `converged` is false.
    """
    members = settle(_ends(edges).distinct())
    adjacent = settle(_both_ways(edges).where("src <> dst").select("src", "dst").distinct())
    coloured = colours(edges, members)
    last = coloured.agg(F.max("colour")).head()[0]
    labels = settle(members.join(fluid_seeds(edges, members, k, seed), "node", "left"))
    seen: set[int] = set()
    converged = last is None
    while not converged:
        before = labels
        for colour in range(last + 1):
            moving = coloured.where(F.col("colour") == colour).select("node")
            best = (
                _pressure(adjacent, labels).join(moving, "node", "left_semi").groupBy("node")
                .agg(F.max(F.struct("d", "own", "fluid")).alias("best")).select("node", F.col("best.fluid").alias("next"))
            )
            labels = settle(labels.join(best, "node", "left").select("node", F.coalesce("next", "fluid").alias("fluid")))
        same = labels.alias("a").join(before.alias("b"), "node").where(~F.col("a.fluid").eqNullSafe(F.col("b.fluid")))
        converged = same.isEmpty() and labels.where("fluid IS NULL").isEmpty()
        state = labels.agg(F.bit_xor(F.xxhash64("node", "fluid"))).head()[0]
        if state in seen:
            break
        seen.add(state)
    numbered = _numbered(labels.select("node", F.col("fluid").alias("head")))
    return numbered.withColumn("converged", F.lit(converged))


def fluid_unsettled(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Nodes that another fluid than their own presses on harder."""
    adjacent = _both_ways(edges).where("src <> dst").select("src", "dst").distinct()
    pressure = _pressure(adjacent, communities.select("node", F.col("community").alias("fluid")))
    best = pressure.groupBy("node").agg(F.max("d").alias("most"), F.max(F.when(F.col("own") == 1, F.col("d"))).alias("mine"))
    return best.where(F.coalesce("mine", F.lit(0.0)) < F.col("most")).select("node")


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """`node, degree, triangles, clustering` of the undirected graph.

    Edges point from the lower to the higher degree, so a hub opens no wedges.
    """
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    degrees = _ends(pairs).groupBy("node").agg(F.count("*").alias("degree"))
    first = degrees.select(F.col("node").alias("src"), F.col("degree").alias("d1"))
    second = degrees.select(F.col("node").alias("dst"), F.col("degree").alias("d2"))
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    directed = pairs.join(first, "src").join(second, "dst").select(
        F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"),
        F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"),
    )
    wedges = directed.select("lo", F.col("hi").alias("x")).join(directed.select("lo", F.col("hi").alias("y")), "lo")
    closed = wedges.join(directed.select(F.col("lo").alias("x"), F.col("hi").alias("y")), ["x", "y"])
    triangles = closed.select(F.explode(F.array("lo", "x", "y")).alias("node")).groupBy("node").agg(
        F.count("*").alias("triangles")
    )
    d = F.col("degree")
    return degrees.join(triangles, "node", "left").select(
        "node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"),
        _ratio(2 * F.coalesce("triangles", F.lit(0)), d * (d - 1), 0.0).alias("clustering"),
    )


def average_clustering(edges: DataFrame) -> DataFrame:
    return clustering_coefficients(edges).agg(F.avg("clustering").alias("average_clustering"))
