"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become whole numbers, so sums and centred products are exact whatever the order of
tasks.  Passes over the vectors add up small matrices of the dimensions alone; the eigenvectors
come from spectrum slicing of one such matrix (``inertia``).  Nothing is shuffled but these sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.inertia import EPS, leading_eigenpairs

COMPONENTS = 8
# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
# Doubles hold whole numbers up to this one.
_WHOLE = 1 << 53
_ROWS = 4096


def _whole_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a batch that have a usable vector: their places, their whole numbers, and the dimensions (0: none)."""
    col = batch.column(1)
    null = np.asarray(col.is_null())
    ends = np.asarray(col.offsets)
    flat = np.asarray(col.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null entries become NaN
    sizes = np.diff(ends)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    use = np.flatnonzero(~null & (bad[ends[1:]] == bad[ends[:-1]]))
    if not len(use):
        return use, np.empty((0, 0), np.int64), 0
    dims = int(sizes[use[0]])
    if (sizes[use] != dims).any():
        raise ValueError("vectors differ in length")
    places = ends[use][:, None] + np.arange(dims)[None, :]
    x = np.floor(flat[places] * SCALE)
    if len(x) and dims and np.abs(x).max() >= _WHOLE:
        raise ValueError(f"entries of {_WHOLE // SCALE} and more cannot be held as whole numbers")
    return use, x.astype(np.int64) + OFFSET, dims


def _vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def _task_sums(vectors: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[list[int], int]]:
    """Exact totals of ``sums(rows)``, whole numbers, over all vectors, by dimensions: {dims: (totals, n)}.

    A task adds up what it reads and sends one number per place; Spark adds up those of one place.
    """
    kind = pa.schema([("dims", pa.int32()), ("at", pa.int64()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            use, x, dims = _whole_rows(batch)
            for a in range(0, len(use), _ROWS):
                part = sums(x[a : a + _ROWS])
                old = held.get(dims)
                held[dims] = [part if old is None else old[0] + part, len(x[a : a + _ROWS]) + (0 if old is None else old[1])]
        for dims, (total, n) in held.items():
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * (size + 1), pa.int32()), pa.array([*range(size), -1]), pa.array([*map(int, total), 0], pa.decimal128(38, 0)), pa.array([0] * size + [n])],
                schema=kind,
            )

    rows = vectors.mapInArrow(run, "dims int, at long, total decimal(38,0), n long").groupBy("dims", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    # At most one row for each pair of dimensions.
    out: dict[int, tuple[list[int], int]] = {}
    for row in rows.orderBy("dims", "at").collect():
        total, n = out.setdefault(row["dims"], ([], 0))
        if row["at"] < 0:
            out[row["dims"]] = (total, row["n"])
        else:
            total.append(int(row["total"]))
    return out


def _plain_sums(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0, dtype=object) if len(x) else np.zeros(x.shape[1], object)


def _products(d: np.ndarray) -> np.ndarray:
    """Exact upper triangle of ``d^T d``: in doubles while every sum is a whole number they hold, else by large integers."""
    top = int(np.abs(d).max(initial=0))
    up = np.triu_indices(d.shape[1])
    if top * top * len(d) < _WHOLE:
        f = d.astype(float)
        return (f.T @ f)[up].astype(np.int64).astype(object)
    o = d.astype(object)
    return (o.T @ o)[up]


class Whitening:
    """Fitted whitening: exact sums, eigenvectors as columns, eigenvalues, and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace

    @property
    def middle(self) -> np.ndarray:
        """Whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def beyond(self) -> list[int]:
        """``n`` times what the means exceed ``middle`` by."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle).astype(float) - np.array([b / self.n for b in self.beyond])
        return centred @ self.vectors / np.sqrt(self.values)


def fit(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Fit on all usable vectors; None where there are none.

    Components whose eigenvalue is not above rounding have no direction and are left out.
    The driver holds one matrix of the dimensions; vectors of different lengths are an error.
    """
    vectors = _vectors(embeddings, id_col, vector_col)
    first = _task_sums(vectors, _plain_sums)
    if not first:
        return None
    if len(first) > 1:
        raise ValueError(f"vectors differ in length: {sorted(first)}")
    ((dims, (sums, n)),) = first.items()
    probe = Whitening(n, sums, np.empty((dims, 0)), np.empty(0), 0.0)
    middle, beyond = probe.middle, probe.beyond
    ((total, _),) = _task_sums(vectors, lambda x: _products(x - middle)).values() if dims else [([], 0)]
    exact = np.zeros((dims, dims))
    for (i, j), s in zip(zip(*np.triu_indices(dims)), total, strict=True):
        # n^2 times a covariance, exactly; true division of whole numbers rounds once.
        exact[i, j] = exact[j, i] = (n * s - beyond[i] * beyond[j]) / (n * n)
    trace = float(np.trace(exact))
    values, found = leading_eigenpairs(exact, components)
    some = values > dims * EPS * max(trace, 0.0)
    return Whitening(n, sums, found[:, some], values[some], trace)


def identity_error(embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            use, x, _ = _whole_rows(batch)
            if len(use):
                w = model.project(x)
                one += w.sum(axis=0)
                two += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([one, two.ravel()]))], names=["at", "total"])

    got = _vectors(embeddings, id_col, vector_col).mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    flat = np.array([r["total"] for r in got]) / model.n
    # The projections are centred, so what is taken off here is rounding alone.
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", model: Whitening | None = None
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    ``deviation`` (decimal) is the sum of ``(n x - S)^2`` over the dimensions, exact.  Rows whose vector is
    null or holds null or non-finite entries are left out; null ids stay, repeated rows count
    each for itself, an empty table or one without any variance gives no row, other columns play no part.
    """
    model = model or fit(embeddings, components, id_col, vector_col)
    kind = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    )
    names = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], names)
    error = identity_error(embeddings, model, id_col, vector_col)
    n, middle, k = model.n, model.middle, len(model.values)
    beyond = np.array(model.beyond, object)
    share = model.values / model.trace if model.trace > 0 else model.values
    most = max([abs(b) for b in model.beyond], default=0)

    def deviations(d: np.ndarray) -> list[int]:
        top = int(np.abs(d).max(initial=0))
        wide = d.shape[1] * max(top, most) * max(top, 1) >= 1 << 62
        e = d.astype(object) if wide else d
        squares = (e * e).sum(axis=1).tolist()
        mixed = (e * (beyond if wide else beyond.astype(np.int64))).sum(axis=1).tolist()
        fixed = int((beyond * beyond).sum()) if len(beyond) else 0
        return [n * n * s - 2 * n * m + fixed for s, m in zip(squares, mixed, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, x, _ = _whole_rows(batch)
            if not len(use) or not k:
                continue
            w = model.project(x)
            ids = batch.column(0).take(pa.array(np.repeat(use, k)))
            dev = pa.array(deviations(x - middle), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(use)), k)))
            rows = len(use) * k
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(use))), pa.array(np.full(rows, n)), dev,
                    pa.array(w.ravel()), pa.array(np.tile(share, len(use))), pa.array(np.full(rows, error)),
                ],
                schema=kind,
            )

    return _vectors(embeddings, id_col, vector_col).mapInArrow(run, names)
