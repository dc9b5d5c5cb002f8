"""Exact work on pairs of vectors: similarity joins and nearest neighbours.

No pair below the asked-for threshold, or beyond the asked-for number of neighbours, ever becomes a
row. Vectors are cut into blocks of bounded size; a task receives two blocks and multiplies them as
matrices. Copies of one vector are represented by a single row, because all their pairs follow from it.

The similarity join also places vectors into cells around pivots. Cells that hold too many vectors are split
around pivots of their own, and so on, so cells don't grow with the table. Every vector is at home in one cell and is
stored once; cells are cut into runs, and runs, in an order that follows near pivots, into bundles. For an angle limit ``a``, a
vector can only have partners in a run whose centre lies within ``r + a`` of it, ``r`` being the largest angle
between the centre and the run's vectors (triangle inequality on the sphere). So a vector is sent to the bundles that hold such
a run, and there multiplied with such runs, and no pair is lost. How often a vector is sent follows the number of
bundles, not that of the cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.functions import vectors as V
from creditloom.operators.joins import lookup_join, sized_join
from creditloom.operators.ordered import running_totals, top_per_group
from creditloom.session import checkpointed

# The small array helpers below travel with the task, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1024
MAX_PIVOTS = 256
# A cell of more blocks than this is split, on at most so many levels; rows that one task places.
FULL_BLOCKS, MAX_LEVELS, PLACE_ROWS = 16, 6, 8192
# Vectors that a run has at most and are multiplied at once, and about the number of runs beyond which runs get longer; vectors
# that a bundle has at least and at most, and the number of bundles from which on they grow; Spark partitions for pairs of bundles.
RUN_ROWS, MAX_RUNS = 1024, 4096
LEAST_BUNDLE, BUNDLE_ROWS, BUNDLES, MAX_PARTS = 4096, 32768, 8, 2000
# Share of a product's pairs up to which single precision picks the ones that are computed in double precision.
FEW_HITS = 1 / 32
# Slack on angles, well above the rounding of a dot product in double precision.
ANGLE_SLACK = 1e-6


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, copies): one row per distinct vector, under the smallest of its keys."""
    return df.groupBy(vector).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(
        key, vector, "copies"
    )


def copy_members(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, representative) of every row, to follow results on distinct vectors back to rows.

    Rows meet their representative on the vector itself, so a vector with very many copies must not
    be one shuffle group: the representatives are joined with hot vectors spread over salts.
    """
    representatives = df.groupBy(vector).agg(F.min(key).alias("representative"))
    return lookup_join(df.select(key, vector), representatives, vector).select(key, "representative")


def _unit(block: np.ndarray) -> np.ndarray:
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _pivots(nodes: DataFrame, key: str, vector: str, count: int) -> np.ndarray:
    chosen = nodes.orderBy(C.key_hash(key, "pivot"), F.col(key)).limit(count).select(vector).collect()
    pivots = _unit(np.array([row[0] for row in chosen], dtype=np.float64))
    return pivots[_chain(pivots)]


def _chain(x: np.ndarray) -> list[int]:
    """An order of unit vectors in which each is followed by the nearest one that is left."""
    order, left = [0], np.ones(len(x), dtype=bool)
    while len(order) < len(x):
        left[order[-1]] = False
        near = np.where(left, x @ x[order[-1]], -np.inf)
        order.append(int(near.argmax()) if np.isfinite(near).any() else int(left.argmax()))
    return order


def _placements(nodes: DataFrame, pivots: np.ndarray, limit: float | None = None) -> DataFrame:
    """Cells of every vector: its home and, under an angle limit, lower-numbered cells that may hold partners."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            angles = np.arccos(np.clip(_unit(_stack(batch["vector"])) @ pivots.T, -1.0, 1.0))
            home = angles.argmin(axis=1)
            nearest = angles[np.arange(len(home)), home]
            reachable = angles <= (nearest + 2.0 * limit + ANGLE_SLACK)[:, None] if limit is not None else False
            reachable &= np.arange(len(pivots))[None, :] <= home[:, None]
            reachable[np.arange(len(home)), home] = True
            rows, cells = np.nonzero(reachable)
            placed = batch.iloc[rows].reset_index(drop=True)
            placed["cell"] = cells.astype(np.int32)
            placed["at_home"] = cells == home[rows]
            yield placed

    return nodes.mapInPandas(place, f"key bigint, vector {dict(nodes.dtypes)['vector']}, cell int, at_home boolean")


def _split_cells(placed: DataFrame, full: DataFrame, limit: float | None, block_rows: int, pivots: int) -> DataFrame:
    """The rows of over-full cells, placed among pivots of their own cell; ``full`` has cell and h, its home rows.

    Pivots are the cell's first home vectors by hash, one for ``block_rows`` of them. A task places at most
    about PLACE_ROWS rows of one cell, and gets that cell's pivots alone.
    """
    inside = sized_join(placed, full.select("cell", "h", "rows"), "cell")
    order = [C.key_hash("key", "pivot"), F.col("key")]
    drawn = top_per_group(inside.where("at_home"), ["cell"], order, pivots).where(
        F.col("rank") <= F.ceil(F.col("h") / F.lit(block_rows))
    )
    parts = F.ceil(F.col("rows") / F.lit(PLACE_ROWS)).cast("int")
    spread = inside.withColumn("part", F.pmod(C.key_hash("key", "place"), parts).cast("int"))
    sent = drawn.select(F.col("cell").alias("of"), F.col("rank").alias("at"), F.col("vector").alias("pivot"),
                        F.explode(F.sequence(F.lit(0), parts - 1)).alias("to"))

    def place(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows[["key", "vector", "cell", "at_home"]]
        centres = _unit(_stack(own.sort_values("at")["pivot"]))
        centres = centres[_chain(centres)]
        angles = np.arccos(np.clip(_unit(_stack(rows["vector"])) @ centres.T, -1.0, 1.0))
        home, resident = angles.argmin(axis=1), rows["at_home"].to_numpy().astype(bool)
        nearest = angles[np.arange(len(home)), home]
        reachable = angles <= (nearest + 2.0 * limit + ANGLE_SLACK)[:, None] if limit is not None else False
        # A guest of the cell is compared with home rows only, wherever they are; home rows meet in the lower cell.
        reachable &= (np.arange(len(centres))[None, :] <= home[:, None]) | ~resident[:, None]
        reachable[np.arange(len(home)), home] |= resident
        at, cells = np.nonzero(reachable)
        out = rows[["key", "vector"]].iloc[at].reset_index(drop=True)
        out["cell"] = rows["cell"].iat[0] + "." + pd.Series(cells.astype(str)).str.zfill(6)
        out["at_home"] = resident[at] & (cells == home[at])
        return out

    kind = dict(placed.dtypes)["vector"]
    return spread.select("key", "vector", "cell", "at_home", "part").groupBy("cell", "part").cogroup(
        sent.groupBy("of", "to")
    ).applyInPandas(place, f"key bigint, vector {kind}, cell string, at_home boolean")


def split_placements(
    placed: DataFrame, limit: float | None, block_rows: int, cell_rows: int, pivots: int, levels: int = MAX_LEVELS
) -> DataFrame:
    """``placed`` with every cell of more than ``cell_rows`` home vectors split, and its parts again.

    Under an angle limit guests are placed too: the reach of a cell's own pivots follows from the same inequality, so no
    pair is lost on any level. Without one, every vector has one row on all levels. Cells that stay over-full after
    ``levels`` (vectors all alike) are compared by blocks as they are.
    """
    done: list[DataFrame] = []
    for _ in range(levels):
        sizes = checkpointed(placed.groupBy("cell").agg(F.count_if("at_home").alias("h"), F.count(F.lit(1)).alias("rows")))
        full = sizes.where(F.col("h") > cell_rows)
        if full.isEmpty():
            break
        marked = sized_join(placed, full.select("cell", F.lit(True).alias("full__")), "cell", "left")
        done.append(marked.where(F.col("full__").isNull()).drop("full__").select("key", "vector", "cell", "at_home"))
        placed = checkpointed(_split_cells(placed, full, limit, block_rows, pivots))
    for part in done:
        placed = placed.unionByName(part)
    return placed


def _tasks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Each placed vector once per block pair it takes part in.

    Block numbers per cell: home blocks first, then guest blocks. Pairs are (home, home) with
    left <= right, and (home, guest).
    """
    sizes = checkpointed(
        placed.groupBy("cell").agg(
            F.ceil(F.count_if("at_home") / F.lit(block_rows)).cast("int").alias("h"),
            F.ceil(F.count_if(~F.col("at_home")) / F.lit(block_rows)).cast("int").alias("g"),
        ).where("h > 0")
    )
    numbered = sized_join(placed, sizes, "cell")
    spread = C.key_hash("key", "block")
    home_block = F.pmod(spread, F.col("h")).cast("int")
    guest_block = (F.col("h") + F.pmod(spread, F.greatest(F.col("g"), F.lit(1)))).cast("int")
    numbered = numbered.withColumn("block", F.when(F.col("at_home"), home_block).otherwise(guest_block))
    last = (F.col("h") + F.col("g") - 1).cast("int")

    def pair(left: Column, right: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"))

    as_left = F.transform(F.sequence(F.col("block"), last), lambda other: pair(F.col("block"), other))
    earlier = F.when(F.col("block") > 0, F.sequence(F.lit(0), F.least(F.col("block"), F.col("h")) - 1))
    as_right = F.transform(F.coalesce(earlier, F.array().cast("array<int>")), lambda other: pair(other, F.col("block")))
    pairs = F.when(F.col("at_home"), F.concat(as_left, as_right)).otherwise(as_right)
    return numbered.select("key", "vector", "cell", "block", F.explode(pairs).alias("task")).select(
        "key", "vector", "cell", "block", "task.left", "task.right"
    )


def _bundled(placed: DataFrame, count: int, bundle_rows: int, run_rows: int) -> DataFrame:
    """(key, vector, run, bundle) of the home rows: cells cut into runs, and runs in the order of cells into bundles.

    Cells are ordered by path, so that parts of one cell are next to each other; if there are very many, some next to each
    other share their runs. Rows of a cell are dealt by hash, which also spreads one that stayed over-full. ``count`` is that of
    all rows.
    """
    sizes = checkpointed(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("h"), F.lit(1).alias("one")))
    together = math.ceil(sizes.count() / (MAX_RUNS // 2))
    group = F.floor(F.col("one_before") / F.lit(together)).cast("bigint")
    cells = checkpointed(running_totals(sizes, ["cell"], ["h", "one"]).withColumn("group", group))
    per_run = F.lit(max(run_rows, math.ceil(count / (MAX_RUNS // 2))))
    groups = cells.groupBy("group").agg(
        F.sum("h").alias("rows"), F.min("h_before").alias("start"), F.ceil(F.sum("h") / per_run).alias("runs"))
    numbered = sized_join(placed, cells.join(groups, "group").select("cell", "h", "h_before", "group", "rows", "start", "runs"), "cell")
    at = F.col("h_before") - F.col("start") + F.pmod(C.key_hash("key", "run"), F.col("h"))
    part = F.floor(at * F.col("runs") / F.col("rows"))
    per_bundle = min(bundle_rows, max(LEAST_BUNDLE, math.ceil(count / BUNDLES)))
    first = F.col("start") + F.floor(part * F.col("rows") / F.col("runs"))
    return numbered.select(
        "key", "vector", (F.col("group") * F.lit(1 << 32) + part).cast("bigint").alias("run"),
        F.floor(first / F.lit(per_bundle)).cast("int").alias("bundle"),
    )


def _finite(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and which rows these are: others (NaN, infinite) have no pairs."""
    with np.errstate(invalid="ignore", over="ignore"):
        unit = _unit(vectors)
    known = np.isfinite(unit).all(axis=1)
    return unit[known], known


def _cap(x: np.ndarray, limit: float) -> tuple[np.ndarray, float]:
    """Centre of unit vectors, and the least cosine with it of a vector that may lie within the limit of one of them."""
    centre = x.sum(axis=0)
    length = np.linalg.norm(centre)
    if length < 1e-6:
        return x[0], -2.0
    centre /= length
    reach = math.acos(max(-1.0, min(1.0, float((x @ centre).min())))) + limit + ANGLE_SLACK
    return centre, math.cos(reach) if reach < math.pi else -2.0


def _caps(rows: DataFrame, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and least cosines of all runs (about MAX_RUNS at most), in the order of bundles, and their bundles."""

    def summarise(table: pa.Table) -> pa.Table:
        x, _ = _finite(_matrix(table.column("vector").combine_chunks()))
        found = [_cap(x, limit)] if len(x) else []
        return pa.table({
            "bundle": pa.array(table.column("bundle").to_pylist()[:len(found)], pa.int32()),
            "centre": pa.array([c.tolist() for c, _ in found], pa.list_(pa.float64())),
            "least": pa.array([least for _, least in found], pa.float64()),
        })

    caps = rows.select("run", "bundle", "vector").groupBy("run").applyInArrow(
        summarise, "bundle int, centre array<double>, least double").collect()
    caps.sort(key=lambda r: r["bundle"])
    return np.array([r["centre"] for r in caps]), np.array([r["least"] for r in caps]), np.array([r["bundle"] for r in caps])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of a list column; all lists have one length."""
    if not len(vectors):
        return np.zeros((0, 0))
    lengths = vectors.value_lengths().to_numpy()
    if lengths.min() != lengths.max():
        raise ValueError("vectors have different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _sent(rows: DataFrame, limit: float) -> DataFrame:
    """(pair, key, vector, run, bundle, other): each row once for each bundle, its own included, that may hold partners.

    A pair of bundles has a number from 0 on. Both bundles send to it what may have partners in the other.
    """
    centres, least, of = _caps(rows, limit)
    if len(of) and of[0] != of[-1]:
        bundles, starts = np.unique(of, return_index=True)

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, RUN_ROWS):
                    batch = whole.slice(at, RUN_ROWS)
                    x, known = _finite(_matrix(batch.column("vector")))
                    near = np.logical_or.reduceat(x @ centres.T >= least, starts, axis=1)
                    # By its own run's centre a row reaches its own bundle.
                    ends = np.cumsum(near.sum(axis=1))
                    others = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(bundles[np.nonzero(near)[1]], pa.int32()))
                    kept = batch.filter(pa.array(known))
                    yield pa.RecordBatch.from_arrays([*kept.columns, others], [*kept.schema.names, "others"])

        kind = dict(rows.dtypes)["vector"]
        rows = rows.select("key", "vector", "run", "bundle").mapInArrow(
            reach, f"key bigint, vector {kind}, run bigint, bundle int, others array<int>"
        ).select("key", "vector", "run", "bundle", F.explode("others").alias("other"))
    else:
        rows = rows.withColumn("other", F.col("bundle"))
    high, low = (f("bundle", "other").cast("bigint") for f in (F.greatest, F.least))
    return rows.withColumn("pair", F.floor(high * (high + 1) / 2).cast("bigint") + low)


def _hits(a: np.ndarray, b: np.ndarray, single: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (unit vectors) with cosine at least ``threshold``, and the cosine; ``single`` is ``a`` in single precision."""
    # Rounding of a product of unit vectors in single precision is below this.
    slack = (a.shape[1] + 8) * 2.0 ** -23
    found = np.flatnonzero(single @ b.T.astype(np.float32) >= np.float32(threshold - slack))
    if len(found) > FEW_HITS * len(a) * len(b):
        scores = (a @ b.T).ravel()
        found = np.flatnonzero(scores >= threshold)
        return *np.divmod(found, len(b)), scores[found]
    i, j = np.divmod(found, len(b))
    scores = np.einsum("ij,ij->i", a[i], b[j])
    kept = scores >= threshold
    return i[kept], j[kept], scores[kept]


def _tiles(run: np.ndarray) -> list[tuple[int, int]]:
    """Rows in the order of their runs, cut where a run ends, but not into much less or more than RUN_ROWS."""
    cuts = [0]
    for end in [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]:
        while end - cuts[-1] > RUN_ROWS:
            cuts.append(cuts[-1] + RUN_ROWS)
        if end - cuts[-1] >= RUN_ROWS // 4 or end == len(run) > cuts[-1]:
            cuts.append(end)
    return list(zip(cuts, cuts[1:]))


def _compare(held: list[pa.RecordBatch], threshold: float, limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs (src, dst, weight) of one pair of bundles; rows come in the order of bundle and run."""
    table = pa.Table.from_batches(held).combine_chunks()
    x, known = _finite(_matrix(table.column("vector").combine_chunks()))
    keys, run, bundle, other = (table.column(c).to_numpy()[known] for c in ("key", "run", "bundle", "other"))
    if not len(keys):
        return
    # The rows of the bundle that comes first, then those of the other one.
    first = int(np.searchsorted(bundle, bundle[0], side="right"))
    alone = bundle[0] == other[0]
    if first == len(keys) and not alone:
        return
    single = x.astype(np.float32)
    for start, end in _tiles(run[:first]):
        tile = x[start:end]
        centre, least = _cap(tile, limit)
        # Inside a bundle a pair is found at its earlier row.
        rows = (start if alone else first) + np.flatnonzero(x[start if alone else first:] @ centre >= least)
        for at in range(0, len(rows), RUN_ROWS):
            part = rows[at:at + RUN_ROWS]
            i, j, weight = _hits(x[part], tile, single[part], threshold)
            if alone:
                later = part[i] > start + j
                i, j, weight = i[later], j[later], weight[later]
            left, right = keys[part[i]], keys[start + j]
            if len(weight):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(weight)], ["src", "dst", "weight"])


def similarity_pairs(
    df: DataFrame, key: str, vector: str, threshold: float, block_rows: int = BLOCK_ROWS,
    cell_rows: int | None = None, pivots: int = MAX_PIVOTS, bundle_rows: int = BUNDLE_ROWS, run_rows: int = RUN_ROWS,
) -> DataFrame:
    """All pairs of rows with cosine at least ``threshold``, as (src < dst, weight).

    Zero vectors have no cosine and no pairs, nor have rows without a key. The rows should be distinct vectors
    (:func:`distinct_vectors`) wherever copies can be many. The comparison is exact. Cells have a pivot for ``block_rows``
    vectors, ``pivots`` at most. A cell of more than ``cell_rows`` home vectors (by default FULL_BLOCKS blocks) is split
    around ``pivots`` of its own at most.

    A task holds two bundles of at most ``bundle_rows`` vectors, so what is sent is the table as many times as it has bundles,
    at most, and multiplies blocks of RUN_ROWS of them.
    """
    nodes = checkpointed(df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector")).where(
        (V.norm(vector) > 0) & F.col(key).isNotNull()
    ))
    count, limit = nodes.count(), math.acos(max(-1.0, min(1.0, threshold)))
    if count <= block_rows:
        rows = nodes.select("*", F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("bundle"))
        sent = rows.withColumns({"other": F.col("bundle"), "pair": F.lit(0).cast("bigint")})
        bundles = 1
    else:
        first = _pivots(nodes, "key", "vector", min(pivots, math.ceil(count / block_rows)))
        placed = checkpointed(_placements(nodes, first).withColumn("cell", F.format_string("%06d", "cell")))
        full = cell_rows or FULL_BLOCKS * block_rows
        # No more vectors than one cell may hold: none can be over-full.
        placed = split_placements(placed, None, block_rows, full, pivots) if count > full else placed
        rows = checkpointed(_bundled(placed, count, bundle_rows, run_rows))
        bundles = rows.agg(F.max("bundle")).first()[0] + 1
        sent = _sent(rows, limit)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            cuts = [0, *np.flatnonzero(np.diff(pairs)) + 1, len(pairs)]
            for start, end in zip(cuts, cuts[1:]):
                if start < end:
                    if pairs[start] != now and held:
                        yield from _compare(held, threshold, limit)
                        held = []
                    now = pairs[start]
                    held.append(batch.slice(start, end - start))
        if held:
            yield from _compare(held, threshold, limit)

    # One pair of bundles in a partition, as long as there are not too many.
    parts = min(bundles * (bundles + 1) // 2, MAX_PARTS)
    dealt = sent.withColumn("part", F.pmod("pair", F.lit(parts)).cast("int")).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("pair", "bundle", "run").select("pair", "key", "vector", "run", "bundle", "other").mapInArrow(
        compare, "src bigint, dst bigint, weight double"
    )


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, group: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` nearest other rows of the same group, as (key, neighbour, distance, rank).

    Each block pair keeps only its ``k`` best per row, so at most ``k`` rows per vector and block
    leave a task; the final ranking picks among those.
    """
    nodes = df.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(vector).alias("vector"),
        F.col(group).cast("int").alias("cell"),
        F.lit(True).alias("at_home"),
    )

    def nearest(group_rows: pd.DataFrame) -> pd.DataFrame:
        left, right = int(group_rows["left"].iat[0]), int(group_rows["right"].iat[0])
        a = group_rows[group_rows["block"] == left]
        b = a if left == right else group_rows[group_rows["block"] == right]
        found = []
        if not (a.empty or b.empty):
            x, y = _stack(a["vector"]), _stack(b["vector"])
            found.append(_best(a["key"].to_numpy(), b["key"].to_numpy(), x, y, k))
            if left != right:
                found.append(_best(b["key"].to_numpy(), a["key"].to_numpy(), y, x, k))
        empty = pd.DataFrame({"key": [], "neighbour": [], "distance": []})
        return pd.concat(found) if found else empty

    best = _tasks(nodes, block_rows).groupBy("cell", "left", "right").applyInPandas(
        nearest, "key bigint, neighbour bigint, distance double"
    )
    return top_per_group(best, ["key"], ["distance", "neighbour"], k)


def _best(keys: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    distance = np.sqrt(np.maximum(squared, 0.0))
    distance[keys[:, None] == others[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(others, distance.shape), distance), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(keys)), order.shape[1])
    columns = order.ravel()
    values = distance[rows, columns]
    keep = np.isfinite(values)
    return pd.DataFrame(
        {"key": keys[rows][keep], "neighbour": others[columns][keep], "distance": values[keep]}
    )
