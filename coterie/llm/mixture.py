"""Mixture-controlled packing by deficit round-robin over source queues.

The documents of a source form its queue, in the order they were read. Window
after window is filled from the queues in proportion to their weights; what a
queue is owed after rounding (its deficit) counts in the next window. As a
document may be cut anywhere, the state after any number of tokens can be stated
in closed form: in a phase in which the same queues hold tokens, each has given
`floor(tokens so far * share)`. So every task knows which windows its documents
reach from two numbers, the queue's length and the tokens ahead of a document in
it; deficits pass across windows and partitions without any task waiting. A queue
that runs dry ends a phase, and the others share on.

Without weights each source gets its share of the corpus, so every window mirrors
the corpus and all queues end together: of the first P of T tokens a queue that
lies between `lo` and `hi` of all tokens in line gives `hi * P // T - lo * P // T`. A window's
shares follow one another without gaps whatever the number of queues, and a task needs
`lo` and `hi` only. A source that is owed fewer than `least` tokens a window has no queue of its
own, as its documents would be cut to crumbs: such sources share one queue, in the order
of partitions. So at most `sequences * length / least` queues have places of their own.
Windows are whole sequences; only the last sequence may be short.

With weights, the sources with a positive weight are packed first (the phases above, rounding leaves at most
two tokens per queue of padding in a window), and all others follow by their shares of what is left.

The token table is written once to the shared folder. Then only counts per
(partition, source) are shuffled; ids move only if that table of counts is too
large for Spark to broadcast by its measured size. Any number of sources goes through; the
totals of those that `weights` names are held by every task, in as many states as names.

Defined cases: null text is empty and yields the end id alone; null source counts
as ''; repeated rows are documents of their own; an empty table gives an empty
result; further columns are ignored; long texts are cut like any other.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm.bpe import LibraryCoder, Vocabulary, texts
from coterie.llm.memory import lean

LENGTH = 4096
END_ID = 2
SEQUENCES = 256  # of a window, at least
LEAST = 1024  # tokens that a queue of its own is owed a window


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every document's ids with its place in its partition's part of the source's queue.

    `part, queue, ahead, doc_id, n, ids`; `ahead` counts the tokens before it there.
    Written to the shared folder, so that places stay as they are.
    """
    vocabulary = Vocabulary(docs.sparkSession, path, LibraryCoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        kind, end = f"<u{coder.width}", np.array([end_id], f"<u{coder.width}").tobytes()
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            queues = [q or "" for q in batch.column("queue").to_pylist()]
            ids, ahead, counts = [], [], []
            for found, queue in zip(coder.encode_all(texts(batch)), queues, strict=True):
                ids.append(found.astype(kind).tobytes() + end)
                counts.append(len(ids[-1]) // coder.width)
                ahead.append(seen[queue])
                seen[queue] += counts[-1]
            yield pa.record_batch(
                [pa.array([part] * len(ids), pa.int64()), pa.array(queues, pa.string()), pa.array(ahead, pa.int64()),
                 batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "queue", "ahead", "doc_id", "n", "ids"],
            )

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("queue"))
    schema = "part long, queue string, ahead long, doc_id long, n long, ids binary"
    return settle(rows.mapInArrow(lean(run), schema))


class Schedule:
    """What each weighted queue has given when any number of tokens is packed; sent to the tasks."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, float], length: int, sequences: int):
        self.queues = {q: k for k, q in enumerate(sorted(totals))}
        size = np.array([totals[q] for q in sorted(totals)], dtype=object)
        share = np.array([weights[q] for q in sorted(totals)], dtype=object)
        self.total, self.length = int(sum(size)), length
        given = [0 * size]
        while any(given[-1] < size):
            left = size - given[-1]
            open_ = [k for k in range(len(size)) if left[k]]
            rounds = min(left[k] / share[k] for k in open_)
            step = 0 * size
            for k in open_:
                dry = left[k] / share[k] <= rounds
                step[k] = left[k] if dry else min(left[k], int(share[k] * rounds))
            given.append(given[-1] + step)
        self._given = given
        self._at = [int(sum(g)) for g in given]
        self.sequences = max(sequences, -(-16 * len(totals) // length))
        self._window = self.sequences * length - len(totals)
        self.windows = -(-self.total // self._window)
        self._starts: dict[int, np.ndarray] = {}
        last = int(sum(self.given(self.windows) - self.given(self.windows - 1))) if self.windows else 0
        #: Sequences in all.
        self.end = max(0, self.windows - 1) * self.sequences + -(-last // length)

    def given(self, window: int, k: int | None = None):
        """Tokens a queue (or each) has given before a window."""
        packed = min(self.total, window * self._window)
        phase = max(0, min(bisect.bisect_right(self._at, packed) - 1, len(self._at) - 2))
        low, high = self._given[phase], self._given[phase + 1]
        if k is not None:
            low, high = low[k], high[k]
        return low + (high - low) * (packed - self._at[phase]) // (self._at[phase + 1] - self._at[phase])

    def start(self, window: int, k: int) -> int:
        """Where a queue's share begins in a window."""
        if window not in self._starts:
            if len(self._starts) >= 256:
                self._starts.clear()
            share = self.given(window + 1) - self.given(window)
            self._starts[window] = np.cumsum(share) - share
        return int(self._starts[window][k])

    def pieces(self, queue: str, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Cut `n` tokens that follow `at` tokens of a queue: (start, length, sequence, offset)."""
        k, start = self.queues[queue], 0
        window = bisect.bisect_right(range(self.windows + 1), at, key=lambda w: self.given(w, k)) - 1
        while start < n:
            first, end = self.given(window, k), self.given(window + 1, k)
            stop = min(n, end - at)
            while start < stop:
                place = self.start(window, k) + at + start - first
                size = min(stop - start, self.length - place % self.length)
                yield start, size, window * self.sequences + place // self.length, place % self.length
                start += size
            window += 1


class Shares:
    """Queues in proportion to their tokens, in closed form: a queue is what lies between two points of the line."""

    def __init__(self, total: int, length: int, sequences: int, first: int = 0):
        self.total, self.length, self.first = total, length, first
        self._sequences = -(-total // length)
        self.windows = max(1, -(-self._sequences // sequences))
        shortest = total - self.until(self.windows - 1)
        #: Tokens of the shortest window.
        self.window = min(shortest, length * (self._sequences // self.windows)) if self.windows > 1 else shortest

    def until(self, window: int) -> int:
        """Tokens packed before a window."""
        return min(self.total, self.length * (window * self._sequences // self.windows))

    def owed(self, tokens: int) -> int:
        """The least size of a queue that gives so many tokens in every window."""
        return -(-tokens * self.total // max(self.window, 1))

    def given(self, lo: int, hi: int, window: int) -> int:
        """Tokens that the queue between two points has given before a window; rising if each window owes it one."""
        packed = self.until(window)
        return hi * packed // self.total - lo * packed // self.total

    def pieces(self, lo: int, hi: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Cut `n` tokens that follow `at` tokens of a queue: (start, length, sequence, offset)."""
        start = 0
        window = bisect.bisect_right(range(self.windows + 1), at, key=lambda w: self.given(lo, hi, w)) - 1
        while start < n:
            packed, then = self.until(window), self.until(window + 1)
            ahead = lo * then // self.total - lo * packed // self.total - self.given(lo, hi, window)
            stop = min(n, self.given(lo, hi, window + 1) - at)
            while start < stop:
                place = packed + ahead + at + start
                size = min(stop - start, self.length - place % self.length)
                yield start, size, self.first + place // self.length, place % self.length
                start += size
            window += 1


def _sum_of(counts: DataFrame) -> int:
    return counts.agg(F.sum("n")).head()[0] or 0


def _queues(
    counts: DataFrame, weights: Mapping[str, float] | None, length: int, sequences: int, least: int
) -> tuple[DataFrame, Schedule | None, Shares, dict[str, tuple[int, int]], int]:
    """Where each (part, queue) begins in its queue, and the plans: weighted, by shares, the latter's own queues, the rest's end."""
    weights = {q: w for q, w in (weights or {}).items() if w > 0}
    sizes = counts.groupBy("queue").agg(F.sum("n").alias("n"))
    weighted = F.col("queue").isin(list(weights)) if weights else F.lit(False)
    named = {r["queue"]: r["n"] for r in sizes.where(weighted).collect()}
    plan = Schedule(named, weights, length, sequences) if named else None
    others = settle(sizes.where(~weighted))
    shares = Shares(_sum_of(others), length, sequences, plan.end if plan else 0)
    large = {r["queue"]: r["n"] for r in others.where(F.col("n") >= shares.owed(least)).collect()}
    slow = shares.total - sum(large.values())
    if 0 < slow < shares.owed(1) and large:  # too little for every window: one queue with the smallest of the others
        slow += large.pop(min(large, key=lambda q: (large[q], q)))
    spots, at = {}, slow
    for q in sorted(large):
        spots[q] = (at, at + large[q])
        at += large[q]

    def before(*keys: str) -> Column:
        *by, order = keys
        window = (Window.partitionBy(*by) if by else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    own = F.col("queue").isin(list(spots) + list(named))
    rest = counts.where(~own)
    parts = rest.groupBy("part").agg(F.sum("n").alias("n")).select("part", before("part").alias("base"))
    rest = rest.withColumn("inside", before("part", "queue")).join(parts, "part")
    rest = rest.select("part", "queue", (F.col("base") + F.col("inside")).alias("base"))
    begins = counts.where(own).withColumn("base", before("queue", "part")).select("part", "queue", "base").unionByName(rest)
    return settle(begins), plan, shares, spots, slow


def pack(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    length: int = LENGTH,
    path: str | None = None,
    end_id: int = END_ID,
    sequences: int = SEQUENCES,
    with_ids: bool = False,
    least: int = LEAST,
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`.

    `weights` gives each source's share of the tokens; a source that it leaves out
    comes after those it names. With `with_ids` the piece's ids come along.
    """
    table = token_table(docs, path, end_id)
    counts = settle(table.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    begins, plan, shares, spots, slow = _queues(counts, weights, length, sequences, least)

    def pieces(queue: str, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        if plan and queue in plan.queues:
            return plan.pieces(queue, at, n)
        return shares.pieces(*spots.get(queue, (0, slow)), at, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "queue", "at", "n")]
            for doc, queue, at, n, ids in zip(*columns, batch.column("ids"), strict=True):
                raw = ids.as_py()
                tokens = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for start, size, sequence, offset in pieces(queue, at, n):
                    piece = tokens[start : start + size].tobytes()
                    out.append((doc, start, size, zlib.crc32(piece), n, sequence, offset, queue, piece if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {c: pa.int64() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    kinds |= {"source": pa.string(), "ids": pa.binary()}
    placed = table.join(begins, ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("ahead")).alias("at"), "n", "ids")
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'string' if c == 'source' else 'long'}" for c in kinds)
    packed = placed.mapInArrow(lean(run), schema)
    return packed if with_ids else packed.drop("ids")
