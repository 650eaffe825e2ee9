"""Token-id matrices: best-fit-decreasing packing into rows of fixed length.

Each task packs the documents it reads, a bounded buffer of tokens at a time, so
nothing is shuffled and a hot source costs what its tokens cost. A document longer
than a row is split without loss: its full rows stand alone, the rest is packed.
Pieces are placed from long to short, each into the fullest row that still holds
it. A segment tree over the free capacities finds that row. Rows that stay far
from full go into the next buffer, up to a quarter of it.

A packed row holds its ids padded to the full length, the cumulative lengths of
its segments (from 0), the position of each id in its segment (padding: 0), and
which documents the segments come from and where they start in them.

Defined cases: null text is empty and yields the end id alone; repeated rows are
documents of their own; an empty table gives an empty result; further columns are
ignored; equal lengths are placed in reading order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from coterie.llm.bpe import LibraryCoder, Vocabulary, texts
from coterie.llm.memory import lean

LENGTH = 4096
END_ID = 2
BUFFER = 4 << 20
SCHEMA = (
    "sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>"
)

Piece = tuple[int, int, np.ndarray]  # document, start, ids


class Capacities:
    """Rows by free capacity; a segment tree counts them to find the smallest that suffices."""

    def __init__(self, length: int):
        self._leaves = 1 << length.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self._rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the smallest capacity of at least `need`, and that capacity."""
        node = need + self._leaves
        if not self._count[node]:
            while node > 1 and (node & 1 or not self._count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node + (not self._count[2 * node])
        capacity = node - self._leaves
        self._add(capacity, -1)
        return capacity, self._rows[capacity].pop()


def best_fit(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Pieces in rows, longest first, each into the fullest row that holds it."""
    free, rows = Capacities(length), []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        found = free.take(len(piece[2]))
        capacity, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(piece)
        free.put(capacity - len(piece[2]), row)
    return rows


def pack_documents(
    docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, buffer: int = BUFFER
) -> DataFrame:
    """Packed rows, see the module's text; ids take as many bytes as the vocabulary needs."""
    vocabulary = Vocabulary(docs.sparkSession, path, LibraryCoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        kind = f"<u{coder.width}"
        at = "<u2" if length <= 1 << 16 else "<u4"
        first = TaskContext.get().partitionId() << 32
        written = 0

        def record(rows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal written
            out = []
            for row in rows:
                size = [len(ids) for _, _, ids in row]
                ids, places = np.zeros(length, kind), np.zeros(length, at)
                ids[: sum(size)] = np.concatenate([ids for _, _, ids in row])
                places[: sum(size)] = np.concatenate([np.arange(n) for n in size])
                ends = np.cumsum([0, *size]).tolist()
                out.append((first + written, ends[-1], ids.tobytes(), ends, places.tobytes(), [d for d, _, _ in row], [s for _, s, _ in row]))
                written += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def settled(pieces: list[Piece], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
            """Rows to write, and the pieces of the emptiest rows for the next buffer."""
            rows = sorted(best_fit(pieces, length), key=lambda r: -sum(len(p[2]) for p in r))
            spare, kept = 0 if last else buffer // 4, []
            while rows and (n := sum(len(p[2]) for p in rows[-1])) < length * 0.99 and n <= spare:
                spare -= n
                kept += rows.pop()
            return rows, kept

        held: list[Piece] = []
        tokens = 0
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), coder.encode_all(texts(batch)), strict=True):
                ids = np.append(found, end_id).astype(kind)
                held += [(doc, s, ids[s : s + length]) for s in range(0, len(ids), length)]
                tokens += len(ids)
                if tokens >= buffer:
                    rows, held = settled(held, False)
                    tokens = sum(len(p[2]) for p in held)
                    for k in range(0, len(rows), 512):
                        yield record(rows[k : k + 512])
        rows, _ = settled(held, True)
        for k in range(0, len(rows), 512):
            yield record(rows[k : k + 512])

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(lean(run), SCHEMA)


def write_packed(docs: DataFrame, out: str, **settings) -> DataFrame:
    """Write the packed rows as Parquet files below `out` and return them as read from there."""
    packed = pack_documents(docs, **settings)
    packed.write.parquet(out)
    return docs.sparkSession.read.schema(packed.schema).parquet(out)
