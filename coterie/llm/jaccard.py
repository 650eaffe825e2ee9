"""N-gram Jaccard join with signature trees.

Documents are sets of five-word shingles (64-bit hashes). Two link if their Jaccard
similarity reaches 0.8. The result is one row per document with its component.

1. Equal sets are one node from the start, so groups of copies cost one node.
2. Linked sets must share a token among the first fifth of each set, in any one order
   of the tokens. The order takes rare tokens before frequent ones, so a passage that
   many documents share brings no documents together that have other text as well.
   Frequent tokens are counted over all documents; their list has a proven bound
   (`FREQUENT` entries). Sets that share such a token form a block; equal blocks count
   once.
3. In each block every set is compared with the block's first one and with the one
   after it; verified links give first components. That takes a number of comparisons
   in proportion to the block, and settles nearly all links of near copies.
4. What is left are pairs across components within a block. Each block gets a tree:
   a leaf is a set's bitmap of tokens and its size, a node the OR of its children's
   bitmaps, the range of their sizes and their fewest bits. The tree is traversed
   against itself. A pair of nodes is dropped if both lie in one component, if the
   sizes cannot fit, or if the bits they share leave too small an overlap.
5. Pairs that pass are verified on the whole texts; all links give the components.

Tokens travel as packed arrays, one row per task and bucket of tokens. No step emits
all pairs of a block, and no link between different sets is lost.

Defined cases: null text and text without words is the empty set and links with
nothing; a text of fewer than five words is one shingle; rows with equal `doc_id` are
one document each and share a component if linked; a component is named by its smallest
id that is not null, and by null if it has none; an empty table gives an empty result;
further columns are ignored. Texts are taken whole. Hashes of 64 bits stand for
shingles, for whole sets and, beside `doc_id`, for the text of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm.memory import lean
from coterie.llm.words import NOT_SPACE, grams, hashed_words, mixed

WORDS = 5
SHARE = (80, 100)  # intersection over union
BITS = 2048
FREQUENT = 1 << 20
OFTEN = 64  # a token in more documents than this may count as frequent
FANOUT = 16
FILTER_BITS = 1 << 27
FILTER_PART = 1 << 17
COUNTED = np.uint64(1 << 62)  # tokens below it are counted


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, bounds, hashes in hashed_words(texts, NOT_SPACE):
        found = grams(hashes, WORDS)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(found[a : b - WORDS + 1])
            else:
                yield grams(hashes[a:b], b - a) if b > a else hashes[:0]


def _sizes_fit(a, b):
    low, high = np.minimum(a, b), np.maximum(a, b)
    return SHARE[1] * low >= SHARE[0] * high


def _needed(total):
    """Least overlap of two sets whose sizes add up to `total`."""
    return -(-SHARE[0] * total // (SHARE[0] + SHARE[1]))


def prefix_size(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def _set_id(tokens: np.ndarray) -> int:
    return int(mixed(np.array([mixed(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))])).astype(np.int64)[0])


def _bitmap(tokens: np.ndarray, width: int = BITS) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _wide(tokens: np.ndarray) -> bytes:
    """A bitmap of at least four bits a token; the width is a power of two, so that it can be folded."""
    return _bitmap(tokens, max(BITS, 1 << (4 * len(tokens) - 1).bit_length()))


def most_common(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of two sets' overlap from their wide bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    common = int(np.bitwise_count(x & y).sum(dtype=np.int64))
    bits_a, bits_b = (int(np.bitwise_count(z).sum(dtype=np.int64)) for z in (x, y))
    return min(n_a - (bits_a - common), n_b - (bits_b - common))


def described(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, n_shingles, set_id, bitmap, wide`; no set id for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(s), *((_set_id(s), _bitmap(s), _wide(s)) if len(s) else (None, None, None))) for s in shingle_sets(batch.column("text"))]
            n, ids, maps, wide = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_id", "bitmap", "wide"],
            )

    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, set_id long, bitmap binary, wide binary")


def _by_bucket(tokens: np.ndarray, parts: int, *beside: np.ndarray) -> Iterator[tuple]:
    bucket = (tokens % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)):
        at = order[ends[k] : ends[k + 1]]
        yield int(k), tokens[at].tobytes(), *[x[at].tobytes() for x in beside]


def _keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of a sorted set's tokens in the lowest quarter of the hash range."""
    return (tokens[: np.searchsorted(tokens, COUNTED)] >> np.uint64(30)).astype(np.uint32)


def frequent_tokens(docs: DataFrame, total: int, parts: int) -> np.ndarray:
    """Sorted keys of tokens that stand in many documents, `FREQUENT` at most.

    Only tokens below a quarter of the hash range are counted: the order takes rare
    tokens by their hash, so others are hardly ever among the first fifth of a set.
    A key is the upper 32 bits of such a token. Tokens that share one share their
    place in the order, which any two sets see alike.
    """
    often = max(OFTEN, -(-total // FREQUENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_keys(s) for s in shingle_sets(batch.column("text"))]
            rows = list(_by_bucket(np.concatenate(sets), parts)) if sets else []
            if rows:
                bucket, blob = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32)
        found, n = np.unique(tokens, return_counts=True)
        return pa.table({"token": pa.array(found[n > often].astype(np.int64))})

    counted = docs.mapInArrow(lean(run), "bucket int, tokens binary").groupBy("bucket").applyInArrow(count, "token long")
    found = counted.toArrow().column("token").to_numpy()  # at most total / often
    return np.sort(found.astype(np.uint32))


def blocks(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """`block, members`: sets (64-bit ids, packed) that share a token of their prefixes; equal lists once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            tokens, ids = [], []
            for s in shingle_sets(batch.column("text")):
                if not len(s):
                    continue
                size = prefix_size(len(s))
                if len(often):
                    keys = _keys(s)
                    heavy = np.zeros(len(s), bool)
                    heavy[: len(keys)] = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
                    first = np.concatenate([s[~heavy][:size], s[heavy][: max(0, size - np.count_nonzero(~heavy))]])
                else:
                    first = s[:size]
                tokens.append(first)
                ids.append(np.full(len(first), _set_id(s), np.int64))
            if tokens:
                rows = _by_bucket(np.concatenate(tokens), parts, np.concatenate(ids))
                bucket, blob, sets = zip(*((k, (np.frombuffer(t, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes(), i) for k, t, i in rows), strict=True)
                yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), pa.array(sets, pa.binary())], ["bucket", "tokens", "sets"])

    def group(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32)
        sets = np.frombuffer(b"".join(table.column("sets").to_pylist()), np.int64)
        order = np.lexsort((sets, tokens))
        tokens, sets = tokens[order], sets[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])])
        tokens, sets = tokens[new], sets[new]  # copies of a set meet here
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        ends = np.append(starts[1:], len(tokens))
        digest = mixed(np.add.reduceat(mixed(sets.astype(np.uint64)), starts)).astype(np.int64)
        several = np.flatnonzero(ends - starts > 1)
        _, once = np.unique(digest[several], return_index=True)
        keep = several[once]
        return pa.table({
            "block": pa.array(digest[keep], pa.int64()),
            "members": pa.array([sets[starts[k] : ends[k]].tobytes() for k in keep], pa.binary()),
        })

    packed = docs.mapInArrow(lean(run), "bucket int, tokens binary, sets binary")
    return packed.groupBy("bucket").applyInArrow(group, "block long, members binary").dropDuplicates(["block"])


class Level:
    """Nodes of one level of a signature tree."""

    def __init__(self, bitmaps: np.ndarray, low: np.ndarray, high: np.ndarray, bits: np.ndarray, part: np.ndarray):
        #: OR of the bitmaps; sizes from `low` to `high`; fewest bits; the one component below, else -1
        self.bitmaps, self.low, self.high, self.bits, self.part = bitmaps, low, high, bits, part

    @classmethod
    def leaves(cls, bitmaps: np.ndarray, n: np.ndarray, part: np.ndarray) -> Level:
        return cls(bitmaps, n, n, np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64), part)

    def parents(self) -> Level:
        at = np.arange(0, len(self.low), FANOUT)
        low, high = np.minimum.reduceat(self.part, at), np.maximum.reduceat(self.part, at)
        return Level(
            np.bitwise_or.reduceat(self.bitmaps, at, axis=0),
            np.minimum.reduceat(self.low, at),
            np.maximum.reduceat(self.high, at),
            np.minimum.reduceat(self.bits, at),
            np.where(low == high, low, -1),
        )

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of nodes: can any two sets below them, of different components, link?

        A set with `bits` bits, of which at most `common` are in the other's bitmap, has
        at least `bits - common` tokens that the other lacks.
        """
        fit = SHARE[1] * self.high[a] >= SHARE[0] * self.low[b]
        fit &= SHARE[1] * self.high[b] >= SHARE[0] * self.low[a]
        fit &= (self.part[a] != self.part[b]) | (self.part[a] < 0)
        at = np.flatnonzero(fit)
        common = np.bitwise_count(self.bitmaps[a[at]] & self.bitmaps[b[at]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(
            self.high[a[at]] - np.maximum(0, self.bits[a[at]] - common), self.high[b[at]] - np.maximum(0, self.bits[b[at]] - common)
        )
        fit[at] = most >= _needed(self.low[a[at]] + self.low[b[at]])
        return fit


def linked_candidates(bitmaps: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block's leaves that may link, by dual traversal of the block's signature tree."""
    levels = [Level.leaves(bitmaps, n, part)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].parents())
    # pairs still to open, as a stack of bounded pieces
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        if depth == 0:
            yield a, b
            continue
        below = len(levels[depth - 1].low)
        step = np.arange(FANOUT)
        a2 = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
        b2 = np.tile(b[:, None] * FANOUT + step, (1, FANOUT)).ravel()
        real = (a2 < below) & (b2 < below) & ((a2 < b2) if depth == 1 else (a2 <= b2))
        a2, b2 = a2[real], b2[real]
        fit = levels[depth - 1].may_link(a2, b2)
        a2, b2 = a2[fit], b2[fit]
        for k in range(0, len(a2), 256):
            stack.append((depth - 1, a2[k : k + 256], b2[k : k + 256]))


def earlier_blocks(block: int, lists: pa.ListArray) -> np.ndarray:
    """A bit per block before this one that two of its sets are in as well; a row per set."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.asarray(pa.compute.list_value_length(lists))
    of, found = np.repeat(np.arange(len(lists)), counts), lists.flatten().to_numpy()
    of, found = of[found < block], found[found < block]
    _, column, shared = np.unique(found, return_inverse=True, return_counts=True)
    several = shared > 1
    of, column = of[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    bits = np.zeros((len(lists), np.count_nonzero(several) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (of, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return bits


def across_components(rows: DataFrame) -> DataFrame:
    """`a, b`: pairs of sets that may link, from `block, set_id, part, n, bitmap, blocks` rows sorted by block in each task.

    `blocks` lists the set's blocks before this one. A pair comes from the first block that both are in.
    """

    def pairs(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(block)
        ids, part, n = (t.column(c).to_numpy() for c in ("set_id", "part", "n"))
        order = np.lexsort((ids, n, part))  # like sets side by side, so that nodes are tight
        maps = np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(len(ids), -1)[order]
        seen = earlier_blocks(t.column("block")[0].as_py(), t.column("blocks"))[order]
        ids, part = ids[order], np.unique(part[order], return_inverse=True)[1]
        for a, b in linked_candidates(maps, n[order], part):
            new = ~(seen[a] & seen[b]).any(axis=1)
            x, y = ids[a[new]], ids[b[new]]
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and held[-1].column("block")[0].as_py() != int(block[s]):
                    yield from pairs(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from pairs(held)

    return rows.mapInArrow(lean(run), "a long, b long")


class KeyFilter:
    """A Bloom filter of 64-bit keys, of 16 bits a key and `FILTER_BITS` at most.

    Rows whose key is not among them are dropped where they are read, but for a share that grows
    once the keys are more than the bits allow; no row is ever dropped wrongly.
    """

    def __init__(self, keys: DataFrame):
        spark = keys.sparkSession
        bits = min(FILTER_BITS, max(FILTER_PART, 1 << (16 * keys.count()).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.unique(np.concatenate(_places(batch.column("key").to_numpy(), bits)))
                part = found // FILTER_PART
                cuts = np.flatnonzero(np.diff(part)) + 1
                rows = [x.astype(np.uint32).tobytes() for x in np.split(found, cuts)] if len(found) else []
                numbers = part[np.concatenate([[0], cuts])] if len(found) else part
                yield pa.record_batch([pa.array(numbers.astype(np.int32)), pa.array(rows, pa.binary())], ["part", "places"])

        def joined(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            found = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32) - np.uint32(part * FILTER_PART)
            held = np.zeros(FILTER_PART, bool)
            held[found] = True
            return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

        filled = keys.mapInArrow(lean(places), "part int, places binary").groupBy("part").applyInArrow(joined, "part int, bits binary")
        held = np.zeros(bits // 8, np.uint8)  # 16 MB at most, however many keys there are
        for r in filled.collect():
            at = r["part"] * FILTER_PART // 8
            held[at : at + FILTER_PART // 8] = np.frombuffer(r["bits"], np.uint8)
        self._bits, self._held = bits, spark.sparkContext.broadcast(held)

    def passed(self, rows: DataFrame) -> DataFrame:
        """The rows whose `key` may be among the keys."""
        bits, shared = self._bits, self._held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at in _places(batch.column("key").to_numpy(), bits):
                    keep &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.take(pa.array(np.flatnonzero(keep)))

        return rows.mapInArrow(lean(run), rows.schema)


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each key."""
    keys = keys.astype(np.uint64)
    return [(mixed(keys + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64) for k in range(1, 5)]


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs `a, b` whose whole texts' sets reach the similarity.

    Wide bitmaps drop nearly all others before any text moves, and a filter of fixed size
    keeps back the texts of rows that are in no pair.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b")), strict=True)
            keep = pa.array([k for k, r in enumerate(rows) if most_common(*r) >= _needed(r[2] + r[3])], pa.int64())
            yield pa.record_batch([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    for end in ("a", "b"):
        beside = sets.select(F.col("set_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}"))
        pairs = pairs.join(beside, end)
    pairs = settle(pairs.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(lean(possible), "a long, b long"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = settle(wanted.join(sets.select("set_id", "doc.*"), "set_id").withColumnRenamed("doc_id", "doc"))
    # the row that the set is of: an id alone may be null or stand for several texts
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    asked = KeyFilter(wanted.select(F.xxhash64("doc", "text_hash").alias("key"))).passed(keyed)
    same = wanted["doc"].eqNullSafe(asked["doc_id"]) & (wanted["text_hash"] == F.xxhash64(asked["text"]))
    texts = settle(wanted.join(asked, same).select("set_id", "text").dropDuplicates(["set_id"]))
    both = pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for k, other in enumerate(shingle_sets(batch.column("text_b"))):
                a = batch.column("a")[k].as_py()
                if a != last:
                    last, held = a, next(shingle_sets(batch.column("text_a").slice(k, 1)))
                common = len(np.intersect1d(held, other, assume_unique=True))
                if SHARE[1] * common >= SHARE[0] * (len(held) + len(other) - common):
                    keep.append(k)
            yield pa.record_batch([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """`node, part`: the smallest node that links reach, for every node in a link.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger ones, then to its smaller ones. Rounds grow with the
    logarithm of a component's length; a star is done at once.
    """
    links = settle(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u"))
        large = settle(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u"))
        links = settle(small.filter("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    parts = links.groupBy("u").agg(F.min("v").alias("part")).select(F.col("u").alias("node"), "part")
    return parts.unionByName(parts.select(F.col("part").alias("node"), "part").distinct())


def row() -> Column:
    """Orders rows by id, those without one last, then by their texts."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id`, one row per row."""
    rows = labelled(docs)
    lowest = rows.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "part", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def labelled(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, n_shingles, part`, one row per row; rows of a component share `part`, null for the empty set."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    found = settle(described(docs))
    total = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    sets = found.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min(row()).alias("doc"), F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide")
    )
    sets = settle(sets)
    block = settle(blocks(docs, frequent_tokens(docs, total, parts), parts))

    def star_and_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
            a = np.concatenate([c for x in lists for c in (np.full(len(x) - 1, x[0]), x[1:-1])]) if lists else np.zeros(0, np.int64)
            b = np.concatenate([c for x in lists for c in (x[1:], x[2:])]) if lists else a
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
            ids = np.repeat(batch.column("block").to_numpy(), [len(x) for x in lists])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate(lists) if lists else ids)], ["block", "set_id"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("map_a", "map_b")]
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            leaves = Level.leaves(np.concatenate(maps), n, np.arange(len(n)))
            at = np.arange(batch.num_rows)
            keep = pa.array(np.flatnonzero(leaves.may_link(at, at + batch.num_rows)))
            yield pa.record_batch([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    # links of each block's first set, and of neighbours in it
    star = block.mapInArrow(lean(star_and_chain), "a long, b long").distinct()
    star = star.join(sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("map_a")), "a")
    star = star.join(sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("map_b")), "b")
    star = settle(star.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(lean(possible), "a long, b long"))
    links = settle(verified(star, sets, docs))
    first = components(links)

    # links across components
    member = block.select("block", "members").mapInArrow(lean(members), "block long, set_id long")
    member = member.join(first, member["set_id"] == first["node"], "left").select(
        "block", "set_id", F.coalesce("part", "set_id").alias("part")
    )
    member = settle(member)
    mixed_blocks = member.groupBy("block").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    rows = member.join(mixed_blocks.select("block"), "block", "left_semi")
    rows = rows.groupBy("set_id").agg(F.first("part").alias("part"), F.collect_list("block").alias("blocks"))
    rows = rows.join(sets.select("set_id", "n", "bitmap"), "set_id")
    rows = rows.withColumn("blocks", F.array_sort("blocks")).select(
        F.posexplode("blocks").alias("before", "block"), "set_id", "part", "n", "bitmap", "blocks"
    )
    rows = rows.withColumn("blocks", F.slice("blocks", 1, F.col("before"))).drop("before")
    rest = settle(across_components(rows.repartition(parts, "block").sortWithinPartitions("block")))
    links = links.unionByName(verified(rest, sets, docs))

    last = components(links)
    rows = found.join(last, found["set_id"] == last["node"], "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("part", "set_id").alias("part")
    )
    return settle(rows)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns, and all documents without words.

    The first by id, then by text; of rows that agree in both the one with the smallest hash.
    """
    rows = labelled(docs)
    counted = rows.groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = counted.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min(F.struct(row().alias("row"), "rows")).alias("r"))
    first = first.select("r.row.doc_id", "r.row.text_hash", (F.col("r.rows") > 1).alias("several"))
    empty = counted.filter(F.col("part").isNull()).select("doc_id", "text_hash", F.lit(False).alias("several"))
    tail = len("".join(docs.columns))
    names = [f"{n}_{tail}" for n in ("kept_doc", "kept_hash", "kept_several")]
    kept = settle(first.unionByName(empty)).toDF(*names)

    def taken(several: bool) -> DataFrame:
        some = kept.filter(F.col(names[2]) == several)
        return docs.join(some, docs["doc_id"].eqNullSafe(some[names[0]]) & (F.xxhash64(docs["text"]) == some[names[1]]), "left_semi")

    if kept.filter(names[2]).isEmpty():
        return taken(False)
    repeated = taken(True)
    whole = F.struct(*[repeated[c] for c in docs.columns])
    least = repeated.groupBy(repeated["doc_id"], F.xxhash64(repeated["text"])).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return taken(False).unionByName(least.select("row.*"))
