"""Exact top-k search by inner product (operator 10): a Voronoi kNN join.

Vectors are whole numbers. Equal vectors are one point that carries its ids, at most k rows of one id and 2 k in all,
smallest first: whichever single id a query leaves out, k rows remain, so that is all that any answer can show of
them. Lists of found rows are cut in the same way. Points and queries belong to the cell of their nearest pivot. With u = q - p_i for the
queries of cell i and v = x - p_j for the points of cell j, the product q.x lies within

    |p_i| |v| + |u| |p_j| + |u| |v|     of     p_i . p_j,

so the summaries of the cells (greatest |u|, greatest |v|, points) give a floor for the k-th score of each query
cell, not counting as many points as hold a query's own id, and a point is sent to a group of query cells only if it can reach the floor of one of them. Groups hold at
most ``group_queries`` query points, larger cells are split, and the points of a group are dealt over chunks, so no
task grows with the hottest cell. Chunks are solved with dense products and their best rows are merged.

Pivots are drawn by hash, at most ``MAX_PIVOTS``; the driver holds their matrix and one summary row per cell.

Defined results: vectors that are null, or hold a null or non-finite component, take no part. A shorter vector
counts as padded with zeros. Ties go to the smaller id. Rows that repeat an id are that many candidates; a query
leaves out the rows with its own id. Query rows that repeat an id have k results each from ``top_k``; the query op10
ranks them together, as its SQL does. Extra columns are not read. Products must fit into 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.base import settled, table

MAX_PIVOTS, GROUP_QUERIES, CHUNK_POINTS = 512, 1024, 16384


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vec (array<long>): floor(scale * component), for vectors that take part."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(good & F.col("vec_id").isNotNull()).select("vec_id", vec.alias("vec"))


def points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their ids: at most k rows of one id, and the 2 k smallest; rows of an id are counted first."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    times = rows.groupBy("vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    few = times.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * k)
    listed = F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("times"))))
    return few.groupBy("vec").agg(F.slice(F.sort_array(listed), 1, 2 * k).alias("ids"))


def _matrix(vecs, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), dtype=np.int64)
    for i, v in enumerate(vecs):
        out[i, :len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x ** 2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots ** 2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell and far (distance to the pivot, rounded up by a hair)."""
    width = pivots.shape[1]

    def assign(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vec"], width).astype(float)
                d = _distances(x, pivots)
                cell = d.argmin(1)
                # Whole numbers below 2 ** 53 make this exact; the margin is for larger ones.
                margin = 1e-6 * (np.linalg.norm(x, axis=1) + np.linalg.norm(pivots, axis=1)[cell])
                yield batch.assign(cell=cell.astype(np.int32), far=d[np.arange(len(d)), cell] + margin)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(assign, f"{fields}, cell int, far double")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while every sum stays below 2 ** 53."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best columns of one row: greater score, then smaller id."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _listed(score: np.ndarray, points: list[np.ndarray], first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of one query's 2 k best rows, of which at most k have one id."""
    much = 2 * k
    while True:
        best = _best(score, first, much)
        ids = np.concatenate([points[b] for b in best])
        found = np.repeat(score[best], [len(points[b]) for b in best])
        order = np.lexsort((ids, -found))
        ids, found = ids[order], found[order]
        by_id = np.argsort(ids, kind="stable")
        run = np.concatenate([[0], np.flatnonzero(np.diff(ids[by_id])) + 1])
        nth = np.empty(len(ids), dtype=np.int64)
        nth[by_id] = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))
        ids, found = ids[nth < k], found[nth < k]
        # Points not looked at come after the first row of the last one.
        settled_rows = (found > score[best[-1]]) | ((found == score[best[-1]]) & (ids <= first[best[-1]]))
        if len(best) == len(score) or settled_rows.sum() >= 2 * k:
            return ids[:2 * k], found[:2 * k]
        much *= 4


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, max_pivots: int = MAX_PIVOTS,
          group_queries: int = GROUP_QUERIES, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row of ``queries`` (vec_id, vec)."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = settled(points(rows, k))
    # Points that hold one id: a query's own ones give it no candidates.
    several = data.select(F.explode(F.array_distinct("ids")).alias("vec_id")).groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("own")).where(F.col("own") > 1)
    asked = settled(queries.select("vec_id", "vec").join(several, "vec_id", "left").groupBy("vec").agg(
        F.max(F.coalesce("own", F.lit(1))).alias("own")))
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    n_asked = asked.count()
    if not size.n or not n_asked:
        return spark.createDataFrame([], schema)
    n_pivots = int(min(max_pivots, max(1, np.sqrt(size.n))))
    drawn = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n_pivots).collect()
    pivots = _matrix([r.vec for r in drawn], size.width or 1).astype(float)
    data, asked = settled(placed(data, pivots)), settled(placed(asked, pivots))

    def summary(df, *more):
        return {r.cell: r for r in df.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"), *more).collect()}

    cells, homes = summary(data), summary(asked, F.max("own").alias("own"))  # at most one row per pivot
    norm = np.linalg.norm(pivots, axis=1)
    i, j = np.array(sorted(homes)), np.array(sorted(cells))
    u = np.array([homes[c].far for c in i])
    middle = pivots[i] @ pivots[j].T

    def slack(v):
        return (norm[i][:, None] * v + u[:, None] * norm[j][None, :] + u[:, None] * v) * (1 + 1e-9) + 1e-3

    low = middle - slack(np.array([cells[c].far for c in j])[None, :])
    floors = np.empty(len(i))
    for row in range(len(i)):
        order = np.argsort(-low[row])
        have = np.cumsum([cells[c].n for c in j[order]])
        at = np.searchsorted(have, k + homes[i[row]].own)  # so many may be the query itself
        floors[row] = low[row][order[at]] if at < len(order) else -np.inf

    # Query cells whose pivots are near in a chain share a group until it is full; a larger cell has groups of its own.
    group_of, load, group, left = {}, 0, -1, set(range(len(i)))
    here = 0
    while left:
        left.discard(here)
        n = homes[i[here]].n
        if group < 0 or load + n > group_queries:
            group, load = group + 1, 0
        blocks = -(-n // group_queries)
        group_of[here] = (group, blocks)
        group, load = (group + blocks - 1, group_queries) if blocks > 1 else (group, load + n)
        if left:
            rest = sorted(left)
            here = rest[int(np.argmin(((pivots[i[rest]] - pivots[i[here]]) ** 2).sum(1)))]
    n_groups = group + 1
    place_of = {int(c): spot for spot, c in enumerate(j)}
    chunks = int(-(-size.n // chunk_points))

    def send(batches):
        """A point goes to each group one of whose cells it may serve."""
        for batch in batches:
            if not len(batch):
                continue
            spot = batch["cell"].map(place_of).to_numpy()
            far = batch["far"].to_numpy()
            wide = norm[i][:, None] * far + u[:, None] * norm[j][spot][None, :] + u[:, None] * far
            reach = middle[:, spot] + wide * (1 + 1e-9) + 1e-3
            wanted = reach >= floors[:, None]
            want = np.zeros((n_groups, len(batch)), dtype=bool)
            for cell, (first, blocks) in group_of.items():
                want[first:first + blocks] |= wanted[cell]
            g, row = np.nonzero(want)
            yield pd.DataFrame({"grp": g.astype(np.int32), "ids": batch["ids"].to_numpy()[row], "vec": batch["vec"].to_numpy()[row]})

    chunk = F.pmod(F.xxhash64("vec"), F.lit(chunks)).cast("int")
    sent = data.select("cell", "far", "ids", "vec").mapInPandas(send, "grp int, ids array<long>, vec array<long>").withColumn("chunk", chunk)
    layout = spark.createDataFrame([(int(i[c]), g, b) for c, (g, b) in group_of.items()], "cell int, first int, blocks int")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec"), "blocks").cast("int")
    grouped = asked.join(F.broadcast(layout), "cell").select("vec", (F.col("first") + block).alias("grp"))
    spread = grouped.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    width = pivots.shape[1]

    def solve(_, q, x):
        if not len(q) or not len(x):
            return pd.DataFrame({"vec": [], "vec_id": [], "score": []}, dtype=object)
        qm, xm = _matrix(q["vec"], width), _matrix(x["vec"], width)
        points_ids = [np.asarray(a) for a in x["ids"]]
        first = np.array([a[0] for a in points_ids])
        out_q, out_id, out_s = [], [], []
        for at in range(0, len(qm), 128):
            scores = _products(qm[at:at + 128], xm)
            for r, row in enumerate(scores):
                ids, score = _listed(row, points_ids, first, k)
                out_q += [q["vec"].iat[at + r]] * len(ids)
                out_id.append(ids)
                out_s.append(score)
        return pd.DataFrame({"vec": out_q, "vec_id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    solved = spread.groupBy("grp", "chunk").cogroup(sent.groupBy("grp", "chunk")).applyInPandas(solve, "vec array<long>, vec_id long, score long")
    best = Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id")
    of_id = Window.partitionBy("vec", "vec_id").orderBy(F.desc("score"))
    capped = solved.repartition("vec").withColumn("of_id", F.row_number().over(of_id)).where(F.col("of_id") <= k).drop("of_id")
    merged = capped.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= 2 * k)
    # Query rows with one vector share its answers; each leaves out its own id and takes k of the rest.
    lists = merged.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    own = queries.select(F.col("vec_id").alias("query_id"), "vec").join(lists, "vec")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )


def op10_voronoi_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = whole_vectors(table(spark, folder, "embeddings"))
    found = top_k(rows, rows.where(F.col("vec_id") % 50 == 0)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
