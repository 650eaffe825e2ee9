"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are turned into integers, floor(64 * component) + 1,000,000, and written once as
blocks of rows in as few bytes as their numbers need. With X the centred rows, each
step makes one pass over the blocks for both products: w = X v - beta u, then X'w. Every
u is a combination X g of the rows, so tasks rebuild the earlier u of their rows from the small
matrix of the g instead of keeping n numbers a step; they return sums only: u'w for the
full reorthogonalisation, w'w and X'w. From these the next column of the bidiagonal matrix,
its u and, reorthogonalised against all before, its next v follow. A second pass is made only where
the first took away most of w. Where a step ends in nothing (equal or
zero deviations) the next v is drawn anew, across from all before. The process ends once the wanted
components stand to double precision, at the latest after as many steps as there are dimensions. The
singular vectors of the small bidiagonal matrix yield the components, its singular values the deviations.

Memory: a block of rows at a time per task; the driver and each task hold matrices of
dimensions x steps. The sums of a pass are added up by Spark, one row per dimension
comes back. Lost executors cost their tasks: blocks lie in the shared folder.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^46
or more, take no part; nor do rows whose number of dimensions is not the most frequent one (of equally frequent
ones, the largest). Repeated rows and ids, null ids too, each count as rows. Directions in which the rows do not differ (an
eigenvalue below 1e-13 of the largest) have no component; if there is none left, or no
row, the result is empty. The deviation is exact; where it does not fit a long it is null. Rows times the
largest entry must stay below 2^62, else the run stops with an error. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm.memory import lean

SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 1 << 20
TOLERANCE = 1e-14
_NOTHING = 1e-13
_BLOCK = "n int, width int, most long, ids binary, known binary, rows binary"


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id, embedding` of the rows that take part."""
    small = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 46)))  # false for NaN
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"])
    return rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(small, F.lit(False)))


def dimensions(rows: DataFrame) -> int:
    """The most frequent number of dimensions; 0 without rows."""
    sizes = rows.groupBy(F.size("embedding").alias("d")).count()
    best = sizes.agg(F.max(F.struct("count", "d")).alias("best")).first()["best"]
    return best["d"] if best else 0


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """The quantized rows less SHIFT, some thousands a row."""
    size = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.floor(64.0 * part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8")).astype("<i8")
                most = int(np.abs(x).max())
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                ids = part.column("vec_id")
                known = np.array(ids.is_valid()).astype(np.uint8).tobytes()
                filled = ids.fill_null(0).to_numpy().astype("<i8").tobytes()
                values = [[part.num_rows], [width], [most], [filled], [known], [x.astype(f"<i{width}").tobytes()]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                arrays = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
                yield pa.record_batch(arrays, ["n", "width", "most", "ids", "known", "rows"])

    return rows.filter(F.size("embedding") == dim).mapInArrow(lean(run), _BLOCK)


def _integers(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each block of a batch: its place there and its rows, less SHIFT."""
    for k in range(batch.num_rows):
        width = batch.column("width")[k].as_py()
        yield k, np.frombuffer(batch.column("rows")[k].as_buffer(), f"<i{width}").reshape(-1, dim).astype("<i8")


def _summed(held: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sums over all rows of what a function gives for a block, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _integers(batch, dim):
                part = of_block(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype="<i4")), pa.array(total)], ["place", "v"])

    kind = "long" if of_block is _sum_of_rows else "double"
    sums = held.select("width", "rows").mapInArrow(lean(run), f"place int, v {kind}").groupBy("place").agg(F.sum("v").alias("v"))
    found = sums.collect()  # one row per place, however many rows there are
    out = np.zeros(len(found), "<i8" if kind == "long" else "<f8")
    for r in found:
        out[r["place"]] = r["v"]
    return out


def _sum_of_rows(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0)


class Centre:
    """The rows' centre as the exact sums per dimension."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums

    def of(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean: exact up to one rounding where n * x fits a long."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
            return (self.n * x - self.sums) / self.n
        return x - self.sums / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n * x - S)^2, exactly."""
        most = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return np.square(self.n * x - self.sums).sum(axis=1).tolist()
        exact = np.square(self.n * x.astype(object) - self.sums.astype(object)).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


class Bidiagonal:
    """The factorisation X V = U B as it grows; U = X G is never stored."""

    def __init__(self, dim: int, seed: int = 7):
        self.dim = dim
        self.v = np.zeros((dim, 0))
        self.g = np.zeros((dim, 0))
        self.xu = np.zeros((dim, 0))  # X'u of each u
        self.alpha: list[float] = []
        self.beta: list[float] = []  # beta[j] joins u j with v j + 1
        self._random = np.random.default_rng(seed)

    def across(self, v: np.ndarray) -> np.ndarray:
        """What is left of a vector beside all v so far; twice, for full precision."""
        for _ in range(2):
            v = v - self.v @ (self.v.T @ v)
        return v

    def fresh(self) -> np.ndarray:
        v = self.across(self._random.standard_normal(self.dim))
        v = v / np.linalg.norm(v)
        v = self.across(v)
        return v / np.linalg.norm(v)

    def matrix(self) -> np.ndarray:
        k = len(self.alpha)
        out = np.diag(self.alpha)
        out[np.arange(k - 1), np.arange(1, k)] = self.beta[: k - 1]
        return out


def components(held: DataFrame, centre: Centre, dim: int, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns, and eigenvalues of the covariance, by falling eigenvalue."""
    spark, state = held.sparkSession, Bidiagonal(dim)
    v, beta, scale = state.fresh(), 0.0, 0.0
    while True:
        # w = X (v - beta g) as one combination of the rows
        direction = v - (beta * state.g[:, -1] if beta else 0.0)
        for attempt in range(3):
            shared = spark.sparkContext.broadcast((centre, state.g, direction))

            def products(x: np.ndarray, shared=shared) -> np.ndarray:
                centre, g, direction = shared.value
                y = centre.of(x)
                w = y @ direction
                return np.concatenate([[w @ w], (y @ g).T @ w, y.T @ w])

            sums = _summed(held, products, dim)
            shared.unpersist()
            ww, c, xw = sums[0], sums[1 : 1 + state.g.shape[1]], sums[1 + state.g.shape[1] :]
            direction, xw = direction - state.g @ c, xw - state.xu @ c
            left = ww - c @ c
            if left > 0.5 * ww or ww <= (_NOTHING * scale) ** 2 or attempt == 2:
                break  # else most of w lay along earlier u: once more from what is left
        alpha = float(np.sqrt(max(left, 0.0)))
        scale = max(scale, alpha)
        nothing = alpha <= np.sqrt(_NOTHING) * 1e-3 * scale or alpha == 0.0
        u_direction, xu = (np.zeros(dim), np.zeros(dim)) if nothing else (direction / alpha, xw / alpha)
        state.alpha.append(0.0 if nothing else alpha)
        state.v = np.column_stack([state.v, v])
        state.g = np.column_stack([state.g, u_direction])
        state.xu = np.column_stack([state.xu, xu])
        z = state.across(xu)
        beta = float(np.linalg.norm(z))
        k = len(state.alpha)
        left_vectors, deviations, right = np.linalg.svd(state.matrix())
        if k == dim or k >= wanted and np.all(beta * np.abs(left_vectors[-1, :wanted]) <= TOLERANCE * deviations[0]) and deviations[0] > 0:
            break
        if beta <= TOLERANCE * scale:
            v, beta = state.fresh(), 0.0
        else:
            v = state.across(z / beta)
            v = v / np.linalg.norm(v)
        state.beta.append(beta)
    values = deviations**2 / centre.n
    keep = [k for k in range(min(wanted, len(values))) if values[k] > _NOTHING * values[0]]
    return np.linalg.qr(state.v @ right.T[:, keep])[0] if keep else np.zeros((dim, 0)), values[keep]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`; see the module's text."""
    spark: SparkSession = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    dim = dimensions(rows)
    if not dim:
        return spark.createDataFrame([], schema)
    held = settle(blocks(rows, dim))
    size = held.agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    if size["n"] * size["most"] >= 1 << 62:
        raise ArithmeticError("the sums of a dimension do not fit 64 bits")
    centre = Centre(size["n"], _summed(held, _sum_of_rows, dim))
    axes, values = components(held, centre, dim, wanted)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    shared = spark.sparkContext.broadcast((centre, axes / np.sqrt(values)))

    def spread(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.square(shared.value[0].of(x)).sum()], (shared.value[0].of(x) @ shared.value[1]).sum(axis=0)])

    sums = _summed(held, spread, dim)
    trace, means = sums[0] / centre.n, sums[1:] / centre.n

    def outer(x: np.ndarray) -> np.ndarray:
        w = shared.value[0].of(x) @ shared.value[1] - means
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(held, outer, dim).reshape(k, k) / centre.n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, axes = shared.value
        for batch in batches:
            for row, x in _integers(batch, dim):
                n = len(x)
                ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<i8")
                unknown = np.frombuffer(batch.column("known")[row].as_buffer(), np.uint8) == 0
                repeated = pa.array(np.repeat(np.arange(n), k))
                yield pa.record_batch(
                    [
                        pa.array(ids, mask=unknown).take(repeated),
                        pa.array(np.tile(np.arange(1, k + 1, dtype="<i4"), n)),
                        pa.array(np.full(n * k, centre.n, "<i8")),
                        pa.array(centre.deviations(x), pa.int64()).take(repeated),
                        pa.array((centre.of(x) @ axes).ravel()),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.select("ids", "known", "width", "rows").mapInArrow(lean(run), schema)
