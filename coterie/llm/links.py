"""All links of the n-gram Jaccard join, by dual traversal of signature trees over tiles of blocks.

`jaccard.near_duplicates` gives components and needs no more links than hold them together. Here every
link between different sets is found, inside components as well: pairs of sets, the documents of each set, and
the number of links of each document.

Sets that share a rare token form a block (see `jaccard.blocks`). A block of up to `tile` sets is one tile. A larger
one is cut into bands of sizes, wide enough that sets of one link only with sets of the same or the next band,
and each band into tiles by a hash of the set. Every pair of tiles that may hold a link is one group of at most
about two tiles of rows, so no task holds a block. In a group the trees of both tiles are traversed against one another; pairs
that pass are made distinct over all blocks and verified on the whole texts.

Work after the trees follows the number of links: n near copies with different texts have up to n * n / 2 of them.

Defined cases: null text and text without words is the empty set and has no links; equal sets are one set, their
documents link with one another without a row in `links`; rows with equal `doc_id` are documents of their own; an
empty table gives empty results; further columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm import jaccard
from coterie.llm.memory import lean

TILE = 2048
#: Wider than the largest ratio of sizes that may link (1.25), so that rounding cannot part a pair by two bands.
BAND = 1.3


@dataclass(frozen=True)
class Links:
    """`links`: `a, b`, set ids with a < b; `members`: `doc_id, n_shingles, set_id`, one row per row, null for the empty set."""

    links: DataFrame
    members: DataFrame

    def counted(self) -> DataFrame:
        """`doc_id, n_shingles, set_id, n_links`: with how many other documents each one links, copies among them."""
        size = settle(self.members.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("docs")))
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        beyond = both.join(size.withColumnRenamed("set_id", "b"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("docs").alias("beyond"))
        per_set = size.join(beyond, "set_id", "left").select("set_id", (F.col("docs") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
        return self.members.join(per_set, "set_id", "left").select(
            "doc_id", "n_shingles", "set_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        )


def members_of(block: DataFrame) -> DataFrame:
    """`block, of, set_id`: the sets of each block, `of` how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.repeat(batch.column("block").to_numpy(), sizes)
            sets = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(sets)], ["block", "of", "set_id"])

    return block.select("block", "members").mapInArrow(lean(run), "block long, of long, set_id long")


def tiled(member: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows `block, band, tile, set_id` and the pairs of tiles `block, band, tile, band2, tile2` that may hold links."""
    band = F.when(F.col("of") <= tile, 0).otherwise(F.floor(F.log("n") / F.lit(math.log(BAND))))
    placed = member.withColumn("band", band.cast("int"))
    counts = placed.filter(F.col("of") > tile).groupBy("block", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    counts = settle(counts)
    placed = placed.join(counts, ["block", "band"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = settle(placed.select("block", "of", "band", F.pmod(F.xxhash64("set_id"), "tiles").cast("int").alias("tile"), "set_id"))
    small = placed.filter(F.col("of") <= tile).select("block", "band", "tile").distinct()
    large = counts.select("block", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    other = large.toDF("block", "band2", "tile2")
    same = large.join(other, (large["block"] == other["block"]) & (F.col("band") == F.col("band2")) & (F.col("tile") <= F.col("tile2")))
    following = large.join(other, (large["block"] == other["block"]) & (F.col("band") + 1 == F.col("band2")))
    names = [large["block"], "band", "tile", "band2", "tile2"]
    pairs = same.select(*names).unionByName(following.select(*names))
    pairs = pairs.unionByName(small.select("block", "band", "tile", F.col("band").alias("band2"), F.col("tile").alias("tile2")))
    return placed.drop("of"), settle(pairs)


def tile_candidates(table: pa.Table) -> pa.Table:
    """`a, b`: sets of one pair of tiles that may link; `side` 0 and 1 are two tiles, 2 is a tile against itself."""
    ids, n, side = (table.column(c).to_numpy() for c in ("set_id", "n", "side"))
    order = np.lexsort((ids, n, side))  # like sets side by side, so that nodes are tight
    maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(ids), -1)[order]
    ids, side = ids[order], side[order]
    # sets of one part are not compared: of two tiles only pairs between them are wanted
    part = np.arange(len(ids)) if len(ids) and side[0] == 2 else side.astype(np.int64)
    found = [np.zeros((2, 0), np.int64)]
    for a, b in jaccard.linked_candidates(maps, n[order], part):
        x, y = ids[a[a != b]], ids[b[a != b]]  # a tile of one set is a tree of one node
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    a, b = np.concatenate(found, axis=1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidates(member: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """`a, b`: distinct pairs of sets that the trees leave."""
    placed, pairs = tiled(member.join(sets.select("set_id", "n"), "set_id"), tile)
    itself = (F.col("band") == F.col("band2")) & (F.col("tile") == F.col("tile2"))
    sides = F.array(
        F.struct(F.col("band").alias("at_band"), F.col("tile").alias("at_tile"), F.when(itself, 2).otherwise(0).alias("side")),
        F.struct(F.col("band2").alias("at_band"), F.col("tile2").alias("at_tile"), F.when(itself, None).otherwise(1).alias("side")),
    )
    wanted = pairs.select("block", F.xxhash64("block", "band", "tile", "band2", "tile2").alias("pair"), F.inline(sides)).filter("side IS NOT NULL")
    here = placed.withColumnsRenamed({"band": "at_band", "tile": "at_tile"})
    rows = here.join(wanted, ["block", "at_band", "at_tile"]).join(sets.select("set_id", "n", "bitmap"), "set_id")
    rows = rows.select("block", "pair", "set_id", F.col("n").cast("long").alias("n"), F.col("side").cast("long").alias("side"), "bitmap")
    return rows.groupBy("block", "pair").applyInArrow(tile_candidates, "a long, b long").distinct()


def all_links(docs: DataFrame, tile: int = TILE) -> Links:
    """Every link between different sets, and the sets of all documents."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    found = settle(jaccard.described(docs))
    total = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    sets = settle(
        found.filter("set_id IS NOT NULL").groupBy("set_id").agg(
            F.min(jaccard.row()).alias("doc"), F.first("n_shingles").alias("n"),
            F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide"),
        )
    )
    block = jaccard.blocks(docs, jaccard.frequent_tokens(docs, total, parts), parts)
    pairs = settle(candidates(members_of(settle(block)), sets, tile))
    return Links(settle(jaccard.verified(pairs, sets, docs)), found.select("doc_id", "n_shingles", "set_id"))
