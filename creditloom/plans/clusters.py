"""K-means of which all starts advance together, in one pass over the rows for each step.

A pass multiplies a block of rows with the centres of every start at once; a start that has settled takes no further part.
Seeding draws candidates in proportion to their squared distance from the ones drawn so far, in a fixed number of rounds, by
a hash of the row, so reruns agree; candidates, weighted by the rows nearest to them, are reduced to the centres on the driver.
What reaches the driver is bounded by starts, clusters and dimensions, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS, OVERSAMPLING, MAX_ITERATIONS, TOLERANCE, BLOCK = 2, 2, 20, 1e-4, 4096
# Bytes of sums of all tasks that the driver takes and adds up itself; more are added up by centre in tasks first.
DIRECT_BYTES = 8 << 20
# Rows for which a pass has a task: with fewer, tasks take longer to start than to work.
TASK_ROWS = 1 << 14


@dataclass(frozen=True)
class Clusters:
    """The centres of the best start, its cost, and the cost of every start."""

    vector: str
    centres: np.ndarray
    costs: tuple[float, ...]

    @property
    def trainingCost(self) -> float:  # noqa: N802 - as MLlib's models name it
        return min(self.costs)

    @property
    def summary(self) -> Clusters:
        return self

    def assign(self, df: DataFrame, key: str) -> DataFrame:
        """(key, cluster): the nearest centre, the first of equally near ones."""
        centres = self.centres

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    nearest = squared_distances(_rows(part), centres).argmin(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(nearest)], ["key", "cluster"])

        rows = df.select(F.col(key).alias("key"), vector_to_array(self.vector).alias("x"))
        schema = T.StructType([rows.schema["key"], T.StructField("cluster", T.IntegerType())])
        return rows.mapInArrow(work, schema).select(F.col("key").alias(key), "cluster")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[row, centre]; measured from the centres' middle, where products cancel least."""
    middle = centres.mean(0)
    x, c = x - middle, centres - middle
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1)[None, :], 0)


def _draws(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each hash, by the finaliser of MurmurHash3."""
    # Multipliers of the finaliser, and an odd one for the salt.
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) ^ (np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x = x ^ (x >> np.uint64(33))
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53


def _added(sums: list) -> np.ndarray:
    """Sum of what tasks have found, in an order that doesn't depend on the order of tasks."""
    return np.sort(np.stack(sums), axis=0).sum(0)


def _partial_sums(points: DataFrame, centres: dict[int, np.ndarray], tasks: int) -> dict[int, np.ndarray]:
    """Per start [centre, (sum of rows, number, squared distances)] over the rows nearest to each centre: one pass of ``tasks`` tasks."""
    stacked, bounds = np.concatenate(list(centres.values())), np.cumsum([0, *[len(c) for c in centres.values()]])
    numbers, width = list(centres), stacked.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(stacked), width + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, times = _rows(part), part.column("n").to_numpy().astype(float)[:, None]
                far = squared_distances(x, stacked)
                for a, b in zip(bounds, bounds[1:]):
                    nearest = far[:, a:b].argmin(1)
                    order = np.argsort(nearest, kind="stable")
                    found, first = np.unique(nearest[order], return_index=True)
                    least = far[np.arange(len(x)), a + nearest]
                    values = (np.concatenate([x, np.ones((len(x), 1)), least[:, None]], axis=1) * times)[order]
                    total[a + found] += np.add.reduceat(values, first, axis=0)
        some = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["centre", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:  # one row per task that has rows near the centre
        return pd.DataFrame({"centre": group["centre"].iloc[:1], "sums": [_added(group["sums"].to_list())]})

    schema = "centre long, sums array<double>"
    found = points.mapInArrow(work, schema)
    if tasks * stacked.shape[0] * (width + 2) * 8 > DIRECT_BYTES:
        found = found.groupBy("centre").applyInPandas(add, schema)
    parts: dict[int, list] = {}
    for r in found.collect():
        parts.setdefault(r["centre"], []).append(r["sums"])
    out = np.zeros((len(stacked), width + 2))
    for centre, sums in parts.items():
        out[centre] = _added(sums)
    return {number: out[a:b] for number, a, b in zip(numbers, bounds, bounds[1:])}


def _candidates(points: DataFrame, drawn: list[np.ndarray], costs: list[float], wanted: int, seeds: list[int]) -> list[np.ndarray]:
    """Per start about ``wanted`` rows, each with a chance in proportion to its squared distance from the candidates: one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, h, times = _rows(part), part.column("h").to_numpy(), part.column("n").to_numpy()
                for start, (have, cost, seed) in enumerate(zip(drawn, costs, seeds)):
                    chance = wanted * times * squared_distances(x, have).min(1) / cost if cost else np.zeros(len(x))
                    chosen = np.flatnonzero(_draws(h, seed) < chance)
                    if len(chosen):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(chosen), start)), part.column("x").take(pa.array(chosen))], ["start", "x"])

    found = points.mapInArrow(work, "start long, x array<double>").distinct().collect()  # about ``wanted`` for each start
    out = []
    for start, have in enumerate(drawn):
        more = sorted(tuple(r["x"]) for r in found if r["start"] == start)
        out.append(np.concatenate([have, np.array(more).reshape(-1, have.shape[1])]))
    return out


def _reduced(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres for weighted candidates: drawn by distance, then moved to the means of what is near."""
    rng = np.random.default_rng(seed)
    candidates, weight = candidates[weight > 0], weight[weight > 0]
    chosen = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    while len(chosen) < k:
        far = squared_distances(candidates, candidates[chosen]).min(1) * weight
        far[chosen] = 0
        if far.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=far / far.sum())))
    centres = candidates[chosen]
    for _ in range(10):
        nearest = squared_distances(candidates, centres).argmin(1)
        total = np.bincount(nearest, weight, len(centres))
        sums = np.stack([np.bincount(nearest, weight * column, len(centres)) for column in candidates.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    return centres


def fit_starts(df: DataFrame, vector: str, clusters: int, starts: int, seed: int, max_iterations: int = MAX_ITERATIONS,
               tolerance: float = TOLERANCE) -> Clusters:
    """At most ``clusters`` centres (fewer if there are fewer distinct rows): the best of ``starts`` starts."""
    # Copies are one row with a number: they share a draw.
    points = df.groupBy(vector_to_array(vector).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    points = points.withColumn("h", F.xxhash64("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        firsts = points.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), *[
            F.min_by("x", F.xxhash64("h", F.lit(seed + i))).alias(f"x{i}") for i in range(starts)]).first()
        if not firsts["n"]:
            raise ValueError("no rows to cluster")
        k, tasks = max(2, min(clusters, firsts["n"] - 1)), -(-firsts["rows"] // TASK_ROWS)
        passed = points.coalesce(tasks)  # as many as there are, if these are fewer
        drawn = [np.array([firsts[f"x{i}"]], dtype=float) for i in range(starts)]
        costs = [float(t[:, -1].sum()) for t in _partial_sums(passed, dict(enumerate(drawn)), tasks).values()]
        for turn in range(ROUNDS):
            drawn = _candidates(passed, drawn, costs, OVERSAMPLING * k, [(seed + i) * 100 + turn for i in range(starts)])
            sums = _partial_sums(passed, dict(enumerate(drawn)), tasks)
            costs = [float(t[:, -1].sum()) for t in sums.values()]
        centres = {i: _reduced(drawn[i], sums[i][:, -2], k, seed + i) for i in range(starts)}
        moving = set(centres)
        for _ in range(max_iterations):
            for i, total in _partial_sums(passed, {i: centres[i] for i in sorted(moving)}, tasks).items():
                held = total[:, -2:-1] > 0
                moved = np.where(held, total[:, :-2] / np.maximum(total[:, -2:-1], 1), centres[i])
                if ((moved - centres[i]) ** 2).sum(1).max() <= tolerance ** 2:
                    moving.discard(i)
                centres[i] = moved
            if not moving:
                break
        costs = [float(t[:, -1].sum()) for t in _partial_sums(passed, centres, tasks).values()]
    finally:
        points.unpersist()
    return Clusters(vector, centres[int(np.argmin(costs))], tuple(costs))
