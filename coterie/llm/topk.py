"""Exact top-k search by inner product, with columnar branch and bound.

Vectors are quantized to integers and written in blocks of columns (one row of the
block per dimension, in the narrowest integers that hold it). Blocks of candidates are
dealt to groups and blocks of queries to shares; every pair of group and share is one
part, which gets its candidates first and keeps them, then meets its queries block by
block. There are about as many parts as the session's cores ask for, so neither side is
copied more often as the input grows, but for groups that would pass `HELD` bytes.
Nothing but one block of candidates passes through the driver.

Scores grow one block of dimensions after another; after each, a candidate stays only if
its partial score plus the largest score its remaining dimensions can add (product of the
remaining lengths of both vectors) reaches the query's bound. The bound starts as the k-th
best score among a bounded sample of candidates, which is exact as a lower bound, and
rises with the best scores seen from block to block of a part. Candidates equal to the
bound stay, so ties are settled by id over all of them.

Defined cases: null vectors and vectors with null or non-finite components take no
part; vectors of different lengths are compared over the dimensions both have; equal
scores go to the smaller id; a candidate with the query's own id is left out, and
repeated rows of an id whose vectors quantize alike count once; fewer candidates than k give
fewer rows; an empty table gives an empty result; further columns are ignored.
Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.frames import settle

SCALE = 64
BLOCK = 4096  # vectors of a block of candidates
QUERY_BLOCK = 512
DIMS = 16  # dimensions added at a time
SAMPLE = 4096  # candidates that give the first bounds, at most
ROUNDS = 4  # parts for each core
HELD = 64 << 20  # bytes of a group's components, more or less
WIDTHS = ("<i1", "<i2", "<i4", "<i8")  # of components
FEW = 32  # one pair of so many alive: go on with these alone
BLOCK_SCHEMA = "block long, n int, dim int, ids binary, components binary"
PART_SCHEMA = f"{BLOCK_SCHEMA}, bounds binary"


def quantized(vectors: DataFrame) -> DataFrame:
    """`vec_id, quantized`: usable vectors as integers, each pair once."""
    finite = F.forall(vectors["embedding"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(vectors["vec_id"].isNotNull() & vectors["embedding"].isNotNull() & finite)
    whole = F.transform(usable["embedding"], lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = usable.select(usable["vec_id"].alias("vec_id"), whole.alias("quantized"))
    return rows.distinct() if _repeats(rows) else rows


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of `quantized` in blocks, by id, components laid out by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            dim = max(map(len, rows))
            out = np.zeros((dim, len(rows)), "<i8")
            order = np.argsort(ids, kind="stable")
            for k, n in enumerate(order):
                out[: len(rows[n]), k] = rows[n]
            low, high = out.min(initial=0), out.max(initial=0)
            out = out.astype(next(t for t in WIDTHS if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
            values = [[number], [len(ids)], [dim], [np.array(ids, "<i8")[order].tobytes()], [out.tobytes()]]
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("quantized"), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if len(rows) == size:
                    yield block()
                    ids, rows = [], []
        if rows:
            yield block()

    names = ["block", "n", "dim", "ids", "components"]
    return vectors.mapInArrow(run, BLOCK_SCHEMA)


class _Side:
    """A block in memory, with the remaining lengths after each block of dimensions."""

    def __init__(self, ids: bytes, dim: int, components: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        width = len(components) // (dim * len(self.ids) or 1) or 1
        self.x = np.frombuffer(components, f"<i{width}").reshape(dim, len(self.ids))
        self.largest = max(int(self.x.max(initial=0)), -int(self.x.min(initial=0)))
        parts = [np.square(self.x[d : d + DIMS].astype(np.float64)).sum(axis=0) for d in range(0, dim, DIMS)]
        squares = np.cumsum([np.zeros(len(self.ids)), *parts[::-1]], axis=0)[::-1]
        self.rest = np.sqrt(squares)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(queries: _Side, candidates: _Side, k: int, bound: np.ndarray) -> Found:
    """Places of queries, ids and scores of the candidates that may be among a query's k best."""
    dim = min(len(queries.x), len(candidates.x))
    most = dim * queries.largest * candidates.largest
    kind = np.float32 if most < 1 << 22 else np.float64 if most < 1 << 52 else np.int64  # exact each way
    real = np.float64 if kind is np.int64 else kind
    q, c = queries.x[:dim].astype(kind), candidates.x[:dim].astype(kind)
    # lengths and bounds give way by more than their products and sums are rounded
    q_rest, c_rest = (queries.rest * (1 + 1e-6)).astype(real), candidates.rest.astype(real)
    low, least = (bound - 2 - most * 2.0**-50).astype(real), bound.astype(real)
    other = queries.ids[:, None] != candidates.ids
    score = q[:DIMS].T @ c[:DIMS]
    reach = np.empty(score.shape, real)
    place = at = None
    for d in range(DIMS, dim, DIMS):
        n = d // DIMS
        if place is None:
            np.multiply(q_rest[n][:, None], c_rest[n], out=reach)
            reach += score
            alive = (reach >= low[:, None]) & other
            if np.count_nonzero(alive) * FEW > alive.size:
                score += q[d : d + DIMS].T @ c[d : d + DIMS]
                continue
            place, at = np.nonzero(alive)
            score = score[place, at]
        else:
            stay = score + q_rest[n][place] * c_rest[n][at] >= low[place]
            place, at, score = place[stay], at[stay], score[stay]
        score = score + np.einsum("ij,ij->j", q[d : d + DIMS, place], c[d : d + DIMS, at])
    if place is None:
        alive = (score >= least[:, None]) & other
        if score.shape[1] > k:
            seen = np.where(other, score, np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
            kth = np.partition(seen, -k, axis=1)[:, -k][:, None]
            over, tied = alive & (score > kth), alive & (score == kth)
            tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)  # smaller ids come first
            alive = over | tied
        place, at = np.nonzero(alive)
        score = score[place, at]
    else:
        stay = score >= least[place]
        place, at, score = place[stay], at[stay], score[stay]
    return place, candidates.ids[at], score.astype("<i8")


def nearest(queries: _Side, held: list[_Side], k: int, bound: np.ndarray) -> Found:
    """Each query's k best among all blocks that reach its bound, by falling score; the bounds rise on the way."""
    found = (np.zeros(0, "<i8"),) * 3
    for candidates in held:
        place, ids, score = (np.concatenate(x) for x in zip(found, best(queries, candidates, k, bound), strict=True))
        order = np.lexsort((ids, ~score, place))  # ties: smaller ids
        place, ids, score = place[order], ids[order], score[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        stay, last = rank < k, rank == k - 1
        bound[place[last]] = np.maximum(bound[place[last]], score[last])
        found = place[stay], ids[stay], score[stay]
    return found


def _size(laid: DataFrame) -> tuple[int, int, int]:
    """Blocks, vectors and bytes of components."""
    total = laid.agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("components"))).first()
    return total[0], total[1] or 0, total[2] or 0


def _dealt(n: int) -> Column:
    """A block's number below n; the blocks that one task wrote lie in turn, and each task begins one further."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(n)).cast("int")


def search(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k best candidates."""
    spark = candidates.sparkSession
    held = settle(blocks(quantized(candidates), block))
    asked = settle(blocks(quantized(queries), QUERY_BLOCK))
    sample = [(r["ids"], r["dim"], r["components"]) for r in held.filter(F.col("n") <= SAMPLE).limit(1).collect()]
    shared = spark.sparkContext.broadcast(sample)  # one block at most

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Side(*s) for s in shared.value]
        for batch in batches:
            for r in batch.to_pylist():
                bound = np.full(r["n"], -np.inf)
                nearest(_Side(r["ids"], r["dim"], r["components"]), known, k, bound)
                row = r | {"bounds": bound.astype("<f8").tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([*batch.schema, pa.field("bounds", pa.binary())]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                if r["part"] != part:
                    part, group = r["part"], []
                side = _Side(r["ids"], r["dim"], r["components"])
                if r["bounds"] is None:
                    group.append(side)
                    continue
                place, ids, score = nearest(side, group, k, np.frombuffer(r["bounds"], "<f8").copy())
                if len(place):
                    columns = [pa.array(c, pa.int64()) for c in (side.ids[place], ids, score)]
                    yield pa.record_batch(columns, ["query_id", "vec_id", "score"])

    (n_held, _, held_bytes), (n_asked, n_queries, asked_bytes) = _size(held), _size(asked)
    parts = ROUNDS * spark.sparkContext.defaultParallelism
    # Least is moved where copies of candidates weigh as much as those of queries with what each finds.
    even = math.sqrt(parts * held_bytes / max(1, asked_bytes + 24 * k * n_queries))
    groups = max(1, min(n_held, max(round(even), -(-held_bytes // HELD))))
    shares = max(1, min(n_asked, -(-parts // groups)))
    row = ["block", "ids", "dim", "components", "bounds"]
    first = _dealt(groups) * shares
    copies = F.sequence(first, first + F.lit(shares - 1))
    kept = held.withColumn("bounds", F.lit(None).cast("binary")).select(F.explode(copies).alias("part"), *row)
    first = _dealt(shares)
    copies = F.sequence(first, first + F.lit((groups - 1) * shares), F.lit(shares))
    sought = asked.mapInArrow(bounded, PART_SCHEMA).select(F.explode(copies).alias("part"), *row)
    order = [F.col("part"), F.col("bounds").isNotNull(), F.col("block")]
    met_in = kept.unionByName(sought).repartitionById(groups * shares, F.col("part")).sortWithinPartitions(*order)
    found = met_in.mapInArrow(met, "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(ranks))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _repeats(vectors: DataFrame) -> bool:
    """True if an id stands in more than one row."""
    return not vectors.groupBy("vec_id").count().filter("count > 1").isEmpty()
