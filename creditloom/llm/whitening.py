"""Embedding whitening (operator 13): mixed-precision refinement of the eigenvectors of a distributed covariance.

Vectors are whole numbers. One pass sums them exactly, a second one sums the products of the centred vectors, partition by
partition; what reaches the driver is a matrix of the vectors' width squared, whatever the number of rows. Its eigenvectors are computed in
float32 and corrected by Ogita-Aishima iterations, matrix products only, in extended precision where numpy has it: with
R = I - X'X and S = X'VX, the eigenvalues are s_i / (1 - r_i) and X becomes X + XE with
e_ij = (s_ij + l_j r_ij) / (l_j - l_i). Where eigenvalues are too close for that division, the pair gets r_ij / 2, which makes it
orthogonal only, and the directions inside a cluster come from a sub-solve: the small matrix X_J' (V - m I) X_J of the
cluster J is solved by itself, where the differences of its eigenvalues are no longer small. Iterations go on until corrections stop
shrinking.

Defined results: vectors that are null or hold a null or non-finite entry take no part. A shorter vector
counts as padded with the number that a zero becomes. Rows that repeat an id or a vector count each. Without
rows there is no result. A component without variance (up to rounding) has whitened 0 and explained 0, and is left out of the
identity error; fewer components than asked for come out if vectors are narrower. Equal eigenvalues leave a choice of
directions; any orthonormal one is right, and reruns over the same partitions agree up to rounding. ``deviation`` is exact, and null
where it exceeds 64 bits. Sums of numbers must fit into 64 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import settled, table

SCALE, OFFSET, COMPONENTS = 1024, 100000, 8
ROWS_AT_ONCE = 4096
MAX_ITERATIONS, CLUSTER_ROUNDS = 12, 4


@dataclass(frozen=True)
class Fit:
    """Exact sums of n vectors and the leading eigenpairs of their covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > 1e-13 * self.trace * len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.live, self.values / (self.trace or 1.0), 0.0)


def whole_vectors(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and vec (array<long>): floor(scale * entry) + offset, for vectors that take part."""
    def good(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))

    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long") + offset)
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", good)).select("vec_id", vec.alias("vec"))


def _flat(batch: pa.RecordBatch, width: int, offset: int) -> np.ndarray:
    """The vectors of a batch as rows of one matrix, shorter ones padded."""
    column = batch.column("vec")
    counts = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), offset, dtype=np.int64)
    out[np.arange(width)[None, :] < counts[:, None]] = column.flatten().to_numpy()
    return out


def _matrices(batches: Iterator[pa.RecordBatch], width: int, offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, _flat(part, width, offset)


def sums_of(vectors: DataFrame, offset: int = OFFSET) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums per dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                width = int(np.diff(part.column("vec").offsets.to_numpy()).max())
                if width > len(total):
                    total = np.concatenate([total, np.full(width - len(total), n * offset)])
                total[:width] += _flat(part, width, offset).sum(0)
                total[width:] += part.num_rows * offset
                n += part.num_rows
        if n:
            at = np.arange(-1, len(total))
            # What a dimension exceeds the offset by, so that partitions with narrower vectors add nothing to it.
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[n], total - n * offset]))], ["at", "total"])

    found = vectors.select("vec").mapInArrow(work, "at long, total long").groupBy("at").agg(F.sum("total").alias("total"))
    rows = {r["at"]: r["total"] for r in found.collect()}  # one row per dimension
    n = rows.pop(-1, 0)
    return n, np.array([rows[d] + n * offset for d in range(len(rows))], dtype=np.int64)


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum over tasks of (at, values) rows; the values of a place are added in order of size, so the order of tasks is none."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.sort(np.stack(group["values"].to_numpy()), axis=0)
        return pd.DataFrame({"at": group["at"].iloc[:1], "values": [stack.sum(0)]})

    out = np.zeros((width, width))
    for r in parts.groupBy("at").applyInPandas(add, "at long, values array<double>").collect():  # width rows of width
        out[r["at"]] = r["values"]
    return out


def covariance(vectors: DataFrame, n: int, sums: np.ndarray, offset: int = OFFSET) -> np.ndarray:
    """Covariance with divisor n, centred exactly before multiplying."""
    width = len(sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for _, x in _matrices(batches, width, offset):
            centred = (n * x - sums).astype(float) / n
            total, some = total + centred.T @ centred, True
        if some:
            rows = pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * width), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), rows], ["at", "values"])

    total = _summed(vectors.select("vec").mapInArrow(work, "at long, values array<double>"), width)
    return (total + total.T) / 2 / n


def refined(matrix: np.ndarray, vectors: np.ndarray, rounds: int = MAX_ITERATIONS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Eigenvalues (falling), vectors and clusters of indices, by Ogita-Aishima iterations from approximate ``vectors``."""
    a, x = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    size, last = len(a), np.inf
    scale = np.abs(a).sum(1).max() or np.longdouble(1)
    eps = np.finfo(np.longdouble).eps
    for _ in range(rounds):
        r = np.eye(size) - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(values)
        # The bound of their paper on what differences can still be told apart.
        apart = 2 * (np.sqrt((rest ** 2).sum()) + scale * np.sqrt((r ** 2).sum()))
        apart = max(apart, 8 * size * eps * scale)
        gap = values[None, :] - values[:, None]
        split = np.abs(gap) > apart
        # e_ij as r_ij / 2, which makes orthogonal, and a turn, the rest: rounding over a small gap then only turns.
        middle = (values[None, :] + values[:, None]) / 2
        e = r / 2 + np.where(split, (s + middle * r) / np.where(split, gap, 1), 0)
        x = x + x @ e
        change = np.abs(e).max()
        if change <= 4 * eps or change >= last / 2 and change < 1e-12:
            break
        last = change
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    cut = np.flatnonzero(-np.diff(values) > apart) + 1
    return values, x, np.split(np.arange(size), cut)


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, to double precision."""
    scale = np.abs(matrix).max(initial=0.0) or 1.0
    start = np.linalg.eigh((matrix / scale).astype(np.float32))[1]
    a = (matrix / scale).astype(np.longdouble)
    values, x, clusters = refined(a, start)
    for _ in range(CLUSTER_ROUNDS):
        several = [c for c in clusters if len(c) > 1]
        if not several:
            break
        before = x
        for c in several:
            basis = x[:, c]
            middle = values[c].mean()
            small = basis.T @ (a @ basis) - middle * (basis.T @ basis)
            size = np.abs(small).max()
            if size > np.finfo(np.longdouble).eps * len(a):  # else the values are equal, and any basis will do
                turn = np.linalg.eigh(((small + small.T) / 2 / size).astype(float))[1]
                x = np.concatenate([x[:, :c[0]], basis @ turn[:, ::-1], x[:, c[-1] + 1:]], axis=1)
        values, x, clusters = refined(a, x)
        if np.abs(np.abs((before * x).sum(0)) - 1).max() < 1e-16:
            break
    x = (x / np.sqrt((x ** 2).sum(0))).astype(float)
    return (values * scale).astype(float), x


def fit(vectors: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> Fit:
    """The leading components of the vectors' covariance."""
    n, sums = sums_of(vectors, offset)
    if not n or not len(sums):
        return Fit(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    matrix = covariance(vectors, n, sums, offset)
    values, x = eigenpairs(matrix)
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(len(sums))] < 0, -1.0, 1.0)  # the greatest entry is positive
    return Fit(n, sums, values[:components], x[:, :components], float(np.trace(matrix)))


def _directions(model: Fit) -> np.ndarray:
    """What centred vectors are multiplied by; a component without variance gives 0."""
    return model.vectors * np.where(model.live, 1 / np.sqrt(np.where(model.live, model.values, 1.0)), 0.0)


def whitened(vectors: DataFrame, model: Fit, offset: int = OFFSET) -> DataFrame:
    """vec_id, deviation and whitened (array, one number per component) of every vector."""
    directions, n, sums = _directions(model), model.n, model.sums
    width, many = directions.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width, offset):
            exact = n * x - sums
            if width and float(np.abs(exact).max()) ** 2 * width < 2.0 ** 62:
                deviation = pa.array((exact ** 2).sum(1), pa.int64())
            else:
                each = [sum(int(v) ** 2 for v in row) for row in exact]
                deviation = pa.array([v if v < 1 << 63 else None for v in each], pa.int64())
            out = (exact.astype(float) / n) @ directions
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * many)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), deviation, pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float64()))],
                ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vec").mapInArrow(work, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened numbers, of components with variance, minus the identity."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return 0.0
    many = len(live)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((many + 1, many + 1)), False
        for batch in batches:
            if batch.num_rows:
                w = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, -1)[:, live]
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)  # the last row of the products holds the sums
                total, some = total + w.T @ w, True
        if some:
            rows = pa.ListArray.from_arrays(pa.array(np.arange(many + 2, dtype=np.int32) * (many + 1)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(many + 1)), rows], ["at", "values"])

    total = _summed(white.select("whitened").mapInArrow(work, "at long, values array<double>"), many + 1) / model.n
    mean = total[-1, :many]  # 0 but for rounding, as the vectors were centred exactly
    return float(np.abs(total[:many, :many] - np.outer(mean, mean) - np.eye(many)).max())


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = settled(whole_vectors(table(spark, folder, "embeddings")))
    model = fit(vectors)
    white = whitened(vectors, model)
    error = identity_error(white, model)
    shares = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.values) else F.array().cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
