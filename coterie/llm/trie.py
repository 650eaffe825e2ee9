"""Prefix trie of conversations, as a table of nodes with subtree sums.

A node is a distinct sequence of first turns. Every conversation's turns are numbered, each
turn is hashed with its number, and the exclusive or of a conversation's first d hashes is the
digest of its depth-d prefix; digests of all prefixes are thus running values, also where
a conversation is cut over many tasks. Grouping by digest enumerates the nodes. Two 64-bit
lanes make a digest; collisions are still looked for: a group's rows must have one last
turn by SHA-256, and as its parent's digest follows from these, equal digests then
mean equal sequences by induction. A collision has all digests made anew with another seed.

A node of one conversation has a subtree without branches, so its sums are plain. Nodes
that conversations share are dealt to shards, whole subtrees to one shard. A shard lays its nodes
out by a minimal perfect hash of their digests: levels of bit maps, in which the keys that
fall on a place alone keep it and the rest go on to the next level; a key's slot is the rank of
its place. Stored digests verify every lookup. Counts are scattered into flat arrays
by slot, and added to the slots of the parents from the deepest level upwards.

A subtree too large for a shard is cut: nodes whose members' turns below them number more than the bound form
the upper tree, whose own sums wait for those of the subtrees below. The bound is the larger of
`shard_nodes` and the square root of the sum of these numbers over shared nodes, so that neither a subtree below the cut
nor the upper tree has more nodes than the bound; it grows as the square root of the input.

The ids that end at a node are sorted by range over all tasks; a node whose ids lie in several
tasks or are many travels on as joined texts of up to 1 MB, and is hashed as a stream.

Defined cases: null roles and texts are empty; rows with a null id are left out; turns of one conversation
with equal numbers follow the SHA-256 of their content, repeated rows are turns of their own; an empty
table gives an empty result; further columns are ignored. `c - c % 5` of a negative id rounds towards zero.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm.memory import lean
from coterie.llm.words import mixed

SHARD_NODES = 50_000
PIECE_BYTES = 1 << 20
_SHIFT = 33
_NODE = ["d", "a", "b"]
_SUMS = "d int, a long, b long, pa long, pb long, n_children long, n_leaves long, saved_tokens long, top boolean"
_NOTHING_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, ra, rb, n_bytes`: what the trie needs of each turn; its texts go no further."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)

    def lane(first: int) -> Column:
        return F.conv(F.substring(sha, first, 16), 16, -10).cast("long")

    rows = conversations.filter(conversations["conv_id"].isNotNull())
    return rows.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        lane(1).alias("ra"),
        lane(17).alias("rb"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with their place `d` in their conversation from 1, the conversation's `total`, and `run`, `pos`.

    Rows are sorted by range, so a long conversation is dealt over many tasks. Only a
    conversation that begins a task can be cut, so what must be carried over has a row or two per task.
    """
    ordered = rows.repartitionByRange(F.col("conv_id"), *order).sortWithinPartitions(F.col("conv_id"), *order)
    ordered = settle(ordered.withColumn("mid", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("run", F.shiftright("mid", _SHIFT)).withColumn("pos", F.col("mid").bitwiseAND((1 << _SHIFT) - 1))
    cut = ordered.filter("pos = 0").select("conv_id").distinct()
    counts = ordered.join(cut, "conv_id", "left_semi").groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    by_run = Window.partitionBy("conv_id").orderBy("run")
    carried = settle(
        counts.select(
            "conv_id",
            "run",
            (F.sum("n").over(by_run) - F.col("n")).alias("before"),
            F.sum("n").over(Window.partitionBy("conv_id")).alias("whole"),
        )
    )
    here = Window.partitionBy("conv_id", "run")
    place = F.row_number().over(here.orderBy("pos")) + F.coalesce("before", F.lit(0))
    joined = ordered.join(carried, ["conv_id", "run"], "left")
    joined = joined.withColumn("d", place.cast("int")).withColumn("total", F.coalesce("whole", F.count("*").over(here)))
    return joined.drop("mid", "before", "whole")


def kept_turns(conv: Column) -> Column:
    """How many turns of its group's first conversation a rebuilt conversation begins with."""
    return F.crc32(conv.cast("string")) % 9


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations: `conv_id, part, d` (their order), and the turns' columns."""
    own = turns.filter(F.col("d") > kept_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "d", "ra", "rb", "n_bytes")
    base = F.col("conv_id")
    offsets = F.sequence(F.when(base > 0, 0).otherwise(-4), F.when(base < 0, 0).otherwise(4))
    lent = turns.filter((base % 5 == 0) & (F.col("d") <= 8)).select(  # an id beyond the largest long is null
        F.explode(F.transform(offsets, lambda o: F.try_add(base, o.cast("long")))).alias("conv_id"),
        F.lit(0).alias("part"), "d", "ra", "rb", "n_bytes",
    )
    lent = lent.filter(F.col("d") <= kept_turns(F.col("conv_id"))).join(convs, "conv_id", "left_semi")
    return own.unionByName(lent)


def _terms(seed: int) -> tuple[Column, Column]:
    """What a turn at its place adds to both lanes of a digest."""
    return (
        F.xxhash64(F.lit(2 * seed), F.col("d"), F.col("ra"), F.col("rb")),
        F.xxhash64(F.lit(2 * seed + 1), F.col("d"), F.col("rb"), F.col("ra")),
    )


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """`conv_id, d, total, a, b, ra, rb, n_bytes`: each turn with the digest of the prefix it ends."""
    x, y = _terms(seed)
    upto = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = settle(rows.withColumn("a", F.bit_xor(x).over(upto)).withColumn("b", F.bit_xor(y).over(upto)))
    # digests of the earlier parts of conversations that are cut over tasks
    last = inside.groupBy("conv_id", "run").agg(F.max_by(F.struct("a", "b", "d", "total"), "pos").alias("z"), F.min("d").alias("first"))
    cut = last.filter((F.col("first") > 1) | (F.col("z.d") < F.col("z.total")))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(
        cut.select("conv_id", "run", F.bit_xor("z.a").over(before).alias("ca"), F.bit_xor("z.b").over(before).alias("cb"))
    )
    joined = inside.join(carried, ["conv_id", "run"], "left")

    def with_carried(c: str) -> Column:
        return F.col(c).bitwiseXOR(F.coalesce(F.col(f"c{c}"), F.lit(0).cast("long"))).alias(c)

    return joined.select("conv_id", "d", "total", with_carried("a"), with_carried("b"), "ra", "rb", "n_bytes")


def enumerated(members: DataFrame, convs: DataFrame, seed: int) -> DataFrame:
    """The distinct nodes with their parents' digests; `alike` tells that a digest has one last turn only."""
    x, y = _terms(seed)
    nodes = members.groupBy(*_NODE).agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("ra").alias("ra"),
        F.max("rb").alias("rb"),
        ((F.min("ra") == F.max("ra")) & (F.min("rb") == F.max("rb"))).alias("alike"),
        F.sum(F.col("total") - F.col("d") + 1).alias("below"),
    )
    nodes = nodes.withColumn("pa", F.col("a").bitwiseXOR(x)).withColumn("pb", F.col("b").bitwiseXOR(y)).drop("ra", "rb")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    in_all = members.agg(F.count("*").alias("rows"))
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).filter("n > 0").join(in_all)
    return nodes.unionByName(
        root.select(
            F.lit(0).alias("d"), zero.alias("a"), zero.alias("b"), "n", "conv_id", zero.alias("n_bytes"), F.lit(True).alias("alike"),
            (F.col("rows") + F.col("n")).alias("below"), none.alias("pa"), none.alias("pb"),
        )
    )


class SlotTable:
    """A minimal perfect hash of distinct pairs of 64-bit numbers, which it keeps by slot to verify lookups."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        left = np.arange(len(a))
        self._maps: list[np.ndarray] = []
        while len(left):
            if len(self._maps) > 64:
                raise ValueError("keys are repeated")
            size = max(8, int(1.6 * len(left)))
            place = self._place(a[left], b[left], len(self._maps), size)
            alone = np.bincount(place, minlength=size) == 1
            self._maps.append(alone)
            left = left[~alone[place]]
        self._ranks = [np.cumsum(m) - 1 for m in self._maps]
        self._first = np.cumsum([0, *(int(m.sum()) for m in self._maps)])
        self.size = len(a)
        self._a, self._b = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.slots = self._of(a, b)
        self._a[self.slots], self._b[self.slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mixed(mixed(a ^ salt) + b) % np.uint64(size)).astype(np.int64)

    def _of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, ranks) in enumerate(zip(self._maps, self._ranks, strict=True)):
            place = self._place(a[left], b[left], level, len(alone))
            here = alone[place]
            out[left[here]] = self._first[level] + ranks[place[here]]
            left = left[~here]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of pairs; -1 for those that are not in the table."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        if not self.size:
            return np.full(len(a), -1, np.int64)
        slot = self._of(a, b)
        return np.where((slot >= 0) & (self._a[slot] == a) & (self._b[slot] == b), slot, -1)


def _accumulated(shard: pa.Table) -> pa.Table:
    """Subtree sums of one shard's nodes; `top` marks those whose parent lies elsewhere."""
    column = {name: shard.column(name).to_numpy() for name in ("d", "a", "b", "n", "n_bytes", "children", "leaves", "saved")}
    pa_, pb = (shard.column(c).fill_null(0).to_numpy() for c in ("pa", "pb"))
    table = SlotTable(column["a"], column["b"])
    slots = table.slots
    parent = np.empty(table.size, np.int64)
    parent[slots] = np.where(column["d"] > 0, table.find(pa_, pb), -1)
    depth, children, leaves, saved = (np.empty(table.size, np.int64) for _ in range(4))
    depth[slots], children[slots], leaves[slots] = column["d"], column["children"], column["leaves"]
    saved[slots] = column["saved"] + (column["n"] - 1) * column["n_bytes"]
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        leaves[level[children[level] == 0]] = 1
        level = level[parent[level] >= 0]
        np.add.at(children, parent[level], 1)
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    sums = [pa.array(x[slots]) for x in (children, leaves, saved)]
    kept = [shard.column(c) for c in ("d", "a", "b", "pa", "pb")]
    names = ["d", "a", "b", "pa", "pb", "n_children", "n_leaves", "saved_tokens", "top"]
    return pa.table([*kept, *sums, pa.array(parent[slots] < 0)], names)


def _shard_sums(shards: DataFrame) -> DataFrame:
    kept = ["shard", "d", "a", "b", "pa", "pb", "n", "n_bytes", "children", "leaves", "saved"]
    return shards.select(*kept).groupBy("shard").applyInArrow(_accumulated, _SUMS)


def subtree_sums(nodes: DataFrame, members: DataFrame, shard_nodes: int) -> DataFrame:
    """`d, a, b, n_children, n_leaves, saved_tokens` of the nodes that conversations share."""
    shared = nodes.filter("n > 1")
    total = shared.agg(F.sum(F.col("below").cast("double"))).first()[0] or 0.0
    bound = max(shard_nodes, math.ceil(math.sqrt(total)))
    alone = nodes.filter("n = 1 AND d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    held = settle(shared.join(alone.agg(F.count("*").alias("children")), _NODE, "left").fillna(0, ["children"]))
    zero = F.lit(0).cast("long")
    low = held.filter(F.col("below") <= bound).withColumn("leaves", F.col("children")).withColumn("saved", zero)
    big = settle(held.filter(F.col("below") > bound))
    out = _NODE + ["n_children", "n_leaves", "saved_tokens"]
    if big.isEmpty():  # the root is the largest: one shard holds all
        return _shard_sums(low.withColumn("shard", zero)).select(*out)
    # the subtree below the cut that each node lies in, by way of the node's smallest member
    deepest = members.select("conv_id", *_NODE).join(big.select(*_NODE), _NODE).groupBy("conv_id").agg(F.max("d").alias("last"))
    owners = low.select("conv_id").distinct().join(deepest, "conv_id", "left")
    owners = owners.select("conv_id", (F.coalesce("last", F.lit(0)) + 1).alias("d"))
    cut = members.join(owners, ["conv_id", "d"]).select("conv_id", F.xxhash64("a", "b").alias("top"))
    shards = max(1, math.ceil(2 * low.count() / bound))
    dealt = low.join(cut, "conv_id").withColumn("shard", F.pmod("top", F.lit(shards)))
    below = settle(_shard_sums(dealt))
    parent = [(F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    handed = below.filter("top").groupBy(*parent).agg(
        F.count("*").alias("more"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    upper = big.join(handed, _NODE, "left").fillna(0, ["more", "leaves", "saved"])
    upper = upper.withColumn("leaves", F.col("leaves") + F.col("children")).withColumn("children", F.col("children") + F.col("more"))
    return below.select(*out).unionByName(_shard_sums(upper.withColumn("shard", zero)).select(*out))


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """`d, a, b, ends_sha256` from the ids that end at each node."""
    schema = "d int, a long, b long, first long, sha string, ids string"
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["d", "a", "b", "first", "sha", "ids"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        pieced = True  # the first node may have begun in an earlier task, the last may go on in a later one
        out: list[tuple] = []
        waiting = 0
        for batch in batches:
            d, a, b, c = (batch.column(k).to_numpy() for k in ("d", "a", "b", "conv_id"))
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(c)], strict=True):
                if low == high:
                    continue
                key = (int(d[low]), int(a[low]), int(b[low]))
                if key != node:
                    if node is not None:
                        text = ",".join(held)
                        if pieced:
                            out.append((*node, first, None, text))
                        else:
                            out.append((*node, None, hashlib.sha256(text.encode()).hexdigest(), None))
                        pieced = False
                    node, first, held, size = key, int(c[low]), [], 0
                for at in range(low, high, 4096):
                    if size >= PIECE_BYTES:
                        out.append((*node, first, None, ",".join(held)))
                        waiting += size
                        first, held, size, pieced = int(c[at]), [], 0, True
                    held.append(",".join(map(str, c[at : min(high, at + 4096)].tolist())))
                    size += len(held[-1]) + 1
                if len(out) >= 4096 or waiting >= 4 * PIECE_BYTES:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, waiting = [], 0
        if node is not None:
            out.append((*node, first, None, ",".join(held)))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, hashlib.sha256(), []
        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in _NODE)
                if key != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(batch.column("ids")[k].as_py().encode())
        if node is not None:
            out.append((*node, sha.hexdigest()))
            arrays = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), [*kinds[:3], pa.string()], strict=True)]
            yield pa.record_batch(arrays, [*_NODE, "ends_sha256"])

    order = [*_NODE, "conv_id"]
    pieces = settle(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(joined), schema))
    rest = pieces.filter(F.col("ids").isNotNull()).repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    rest = rest.select(*_NODE, "ids").mapInArrow(lean(streamed), "d int, a long, b long, ends_sha256 string")
    return pieces.filter(F.col("sha").isNotNull()).select(*_NODE, F.col("sha").alias("ends_sha256")).unionByName(rest)


def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Every node of the rebuilt conversations' trie with its members, subtree sums and ends; see the module's text."""
    turns = numbered(turns_of(conversations), [F.asc_nulls_first("turn"), F.col("ra"), F.col("rb")])
    turns = settle(turns.select("conv_id", "d", "ra", "rb", "n_bytes"))
    convs = settle(turns.select("conv_id").distinct())
    rows = settle(
        numbered(rebuilt(turns, convs).withColumnRenamed("d", "at"), [F.col("part"), F.col("at")]).select(
            "conv_id", "run", "pos", "d", "total", "ra", "rb", "n_bytes"
        )
    )
    seed = 0
    while True:
        members = settle(prefixes(rows, seed))
        nodes = settle(enumerated(members, convs, seed))
        if nodes.filter(~F.col("alike")).isEmpty():
            break
        seed += 1
    sums = subtree_sums(nodes, members, shard_nodes)
    last = members.filter(F.col("d") == F.col("total")).select("conv_id", *_NODE)
    zero = F.lit(0).cast("long")
    turnless = convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).alias("d"), zero.alias("a"), zero.alias("b"))
    ends = _hashed_ends(last.unionByName(turnless))
    owner = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, _NODE, "left").join(ends, _NODE, "left").join(owner, ["d", "pa", "pb"], "left")
    alone = F.when(F.col("below") > 1, 1).otherwise(0).cast("long")
    return whole.select(
        "conv_id",
        F.col("d").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", alone).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING_SHA)).alias("ends_sha256"),
    )
