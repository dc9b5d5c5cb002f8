"""Pair joins against brute force, and graph identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import pairs as P
from creditloom.plans import graph as G
from tests.conftest import rows

DIM = 6


def vectors(spark, clustered=True, n=300, copies=0):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(7, DIM)) * (4 if clustered else 0)
    points = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, DIM))
    points[n - copies:] = points[0]
    data = [(i, [float(np.float32(x)) for x in p], int(i % 4)) for i, p in enumerate(points)]
    data.append((n, [0.0] * DIM, 0))
    return spark.createDataFrame(data, "sk_id long, embedding array<float>, cluster int"), points.astype(np.float32)


def brute(points, threshold):
    x = points.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    return {(int(a), int(b)): s[a, b] for a, b in zip(i, j)}


@pytest.mark.parametrize("clustered,threshold", [(True, 0.9), (True, 0.5), (False, 0.3), (False, -1.0)])
def test_cells_and_blocks_lose_no_pair(spark, clustered, threshold):
    df, points = vectors(spark, clustered)
    got = {(r.src, r.dst): r.weight for r in P.similarity_pairs(df, "sk_id", "embedding", threshold, 32).collect()}
    want = brute(points, threshold)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_placement_skips_far_cells(spark):
    df, _ = vectors(spark)
    nodes = df.where("sk_id < 300").select(F.col("sk_id").alias("key"), F.col("embedding").alias("vector"))
    pivots = P._pivots(nodes, "key", "vector", 12)
    placed = P._placements(nodes, pivots, np.arccos(0.95)).count()
    assert 300 <= placed < 300 * 6


@pytest.mark.parametrize("clustered,threshold,copies", [(True, 0.95, 0), (True, 0.5, 40), (False, 0.3, 0)])
def test_split_cells_lose_no_pair(spark, clustered, threshold, copies):
    df, points = vectors(spark, clustered, copies=copies)
    found = P.similarity_pairs(df, "sk_id", "embedding", threshold, 8, cell_rows=16, pivots=3).collect()
    want = brute(points, threshold)
    assert len(found) == len(want) and {(r.src, r.dst) for r in found} == set(want)


def test_over_full_cells_are_split_more_than_once(spark):
    df, _ = vectors(spark)
    nodes = df.where("sk_id < 300").select(F.col("sk_id").alias("key"), F.col("embedding").alias("vector"))
    first = P._placements(nodes, P._pivots(nodes, "key", "vector", 3), np.arccos(0.95))
    placed = P.split_placements(first.withColumn("cell", F.col("cell").cast("string")), np.arccos(0.95), 8, 16, 3)
    cells = placed.groupBy("cell").agg(F.count_if("at_home").alias("h")).collect()
    assert max(r.cell.count(".") for r in cells) >= 2 and max(r.h for r in cells) <= 16
    # Every vector is at home once.
    assert placed.where("at_home").count() == placed.where("at_home").select("key").distinct().count() == 300


def test_each_pair_is_found_once(spark):
    df, _ = vectors(spark)
    found = P.similarity_pairs(df, "sk_id", "embedding", 0.5, 32)
    assert found.count() == found.select("src", "dst").distinct().count()


def test_nearest_neighbours(spark):
    df, points = vectors(spark)
    got = {}
    for r in P.nearest_neighbours(df.where("sk_id < 300"), "sk_id", "embedding", "cluster", 3, 16).collect():
        got.setdefault(r.key, {})[r["rank"]] = r.neighbour
    x = points.astype(float)
    for i in range(300):
        same = [j for j in range(300) if j % 4 == i % 4 and j != i]
        order = sorted(same, key=lambda j: (round(float(np.linalg.norm(x[i] - x[j])), 6), j))
        assert [got[i][r] for r in (1, 2, 3)] == order[:3]


def test_copies_are_one_node(spark):
    df, points = vectors(spark, copies=100)
    graph = G.threshold_graph(df.where("sk_id < 300"), 0.8)
    assert rows(graph.where("src = 0 and dst = 0"), "copies") == [(101,)]
    # Degrees follow from the copies exactly as if every copy were a node of its own.
    x = points.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (unit @ unit.T >= 0.8 - 1e-12).sum(1)
    assert {r.src: r.degree for r in G.degrees(graph).collect()} == {i: degree[i] for i in range(200)}
    members = P.copy_members(df.where("sk_id < 300"), "sk_id", "embedding")
    assert members.where("representative = 0").count() == 101


def test_propagation_equals_dense_algebra(spark):
    df, points = vectors(spark, copies=60)
    nodes = df.where("sk_id < 300")
    graph = G.threshold_graph(nodes, 0.8)
    values = nodes.select("sk_id", "embedding")
    x = points.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = (unit @ unit.T >= 0.8 - 1e-12).astype(float)
    d = a.sum(1)
    norm = a / np.sqrt(np.outer(d, d))
    for hops in (1, 2):
        want = np.linalg.matrix_power(norm, hops) @ x
        for r in G.propagate(graph, values, DIM, hops).collect():
            assert np.allclose(r.embedding, want[r.sk_id])
    mean = (a @ x) / d[:, None]
    for r in G.neighbour_mean(graph, values, DIM).collect():
        assert np.allclose(r.embedding, mean[r.sk_id])
    scores = np.where(a > 0, x @ x.T / np.sqrt(DIM), -np.inf)
    soft = np.exp(scores - scores.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    for r in G.attend(graph, values, DIM).collect():
        assert np.allclose(r.embedding, (soft @ x)[r.sk_id], atol=1e-6)


def test_attention_sums_to_one_and_normalised_is_symmetric(spark):
    df, _ = vectors(spark)
    nodes = df.where("sk_id < 300")
    graph = G.threshold_graph(nodes, 0.7)
    attention = G.attention(graph, nodes.select("sk_id", "embedding"), DIM)
    for r in attention.groupBy("src").agg(F.sum(F.col("attention") * F.col("copies")).alias("s")).collect():
        assert r.s == pytest.approx(1.0)
    weights = {(r.src, r.dst): r.weight for r in G.normalised(graph).collect()}
    assert all(weights[(j, i)] == pytest.approx(w) for (i, j), w in weights.items())


def test_cluster_graph_factored(spark):
    df, _ = vectors(spark)
    members = {r.sk_id: r for r in G.cluster_membership(df).collect()}
    by_cluster = {}
    for r in members.values():
        by_cluster.setdefault(r.cluster, []).append(r.sk_id)
    for r in members.values():
        assert r.degree == len(by_cluster[r.cluster]) and r.edge_weight == pytest.approx(1 / r.degree)
    edges = {r.cluster: r.n_edges for r in G.cluster_adjacency(df).collect()}
    assert edges == {c: len(m) * (len(m) - 1) // 2 for c, m in by_cluster.items()}


def test_every_copy_has_its_row(spark):
    df, points = vectors(spark, n=60, copies=20)
    edges, members = G.threshold_graph(df, 0.85), P.copy_members(df, "sk_id", "embedding")
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    want = {i: int((unit @ unit[i] >= 0.85).sum()) - 1 for i in range(len(points)) if np.linalg.norm(points[i]) > 0}
    got = {r.sk_id: r.links for r in G.node_links(edges, members).collect()}
    assert set(got) == set(range(len(points) + 1)) and {i: got[i] for i in want} == want
    means = G.for_every_node(G.neighbour_mean(edges, df.select("sk_id", "embedding"), DIM), members)
    assert means.count() == len(points) + 1


def bundled(spark, points, pivots):
    data = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    nodes = spark.createDataFrame(data, "key long, vector array<float>")
    placed = P._placements(nodes, P._pivots(nodes, "key", "vector", pivots)).withColumn("cell", F.col("cell").cast("string"))
    return P._bundled(placed, len(data), 32, 8).cache()


@pytest.mark.parametrize("clustered,threshold,copies", [(True, 0.95, 0), (True, 0.5, 40), (False, 0.3, 0), (False, -1.0, 0)])
def test_bundles_lose_no_pair(spark, monkeypatch, clustered, threshold, copies):
    monkeypatch.setattr(P, "RUN_ROWS", 16)
    df, points = vectors(spark, clustered, copies=copies)
    found = P.similarity_pairs(df, "sk_id", "embedding", threshold, 8, cell_rows=16, pivots=3, bundle_rows=32, run_rows=8).collect()
    got, want = {(r.src, r.dst): r.weight for r in found}, brute(points, threshold)
    assert len(found) == len(want) and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors_are_placed_once_and_sent_once_for_a_bundle(spark):
    """However many cells there are: before, a vector without near ones was stored in half of the cells and sent to all their blocks."""
    rows = bundled(spark, np.random.default_rng(5).normal(size=(300, DIM)), 60)
    bundles = rows.select("bundle").distinct().count()
    assert rows.count() == rows.select("key").distinct().count() == 300 and 7 <= bundles <= 10
    sent = P._sent(rows, np.arccos(0.3))
    assert sent.count() == sent.select("key", "pair").distinct().count() <= 300 * bundles
    assert sent.where("bundle = other").count() == 300


def test_bundles_out_of_reach_are_not_sent_to(spark):
    rng = np.random.default_rng(6)
    rows = bundled(spark, np.repeat(rng.normal(size=(10, DIM)), 30, axis=0) + 0.01 * rng.normal(size=(300, DIM)), 60)
    sent, bundles = P._sent(rows, np.arccos(0.99)).count(), rows.select("bundle").distinct().count()
    assert 300 <= sent < 300 * bundles / 2


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 16, "pivots": 3, "bundle_rows": 32, "run_rows": 8}])
def test_odd_rows_have_no_pairs_and_cost_none(spark, sizes):
    df, points = vectors(spark, False)
    odd = [(None, [1.0] * DIM), (900, [float("nan")] * DIM), (901, [float("inf")] + [0.0] * (DIM - 1)), (902, None), (903, [None] * DIM)]
    more = df.select("sk_id", "embedding").unionByName(spark.createDataFrame(odd, "sk_id long, embedding array<float>"))
    found = P.similarity_pairs(more, "sk_id", "embedding", 0.5, 8, **sizes).collect()
    assert len(found) == len(brute(points, 0.5)) and {(r.src, r.dst) for r in found} == set(brute(points, 0.5))


def test_keys_may_repeat(spark):
    """Pairs are those of rows: two rows of one key are two."""
    df, points = vectors(spark, False, n=60)
    twice = df.unionByName(df).where("sk_id < 60")
    for sizes in ({}, {"cell_rows": 16, "pivots": 3, "bundle_rows": 16, "run_rows": 8}):
        found = [(r.src, r.dst) for r in P.similarity_pairs(twice, "sk_id", "embedding", 0.5, 8, **sizes).collect()]
        want = [pair for pair in brute(points, 0.5) for _ in range(4)] + [(i, i) for i in range(60)]
        assert sorted(found) == sorted(want)


def test_dense_and_sparse_products_agree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.99, -0.5):  # few hits are computed one by one, many as a product
        i, j, weight = P._hits(x[:90], x[90:], x[:90].astype(np.float32), threshold)
        want = x[:90] @ x[90:].T
        assert list(zip(i, j)) == list(zip(*np.nonzero(want >= threshold)))
        assert np.abs(weight - want[i, j]).max() < 1e-12


def test_splitting_keeps_one_row_for_a_vector(spark):
    """On every level, also where nothing is out of reach; before, each level multiplied the rows by the cells in reach."""
    points = np.random.default_rng(7).normal(size=(300, DIM))
    nodes = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "key long, vector array<float>")
    first = P._placements(nodes, P._pivots(nodes, "key", "vector", 4)).withColumn("cell", F.col("cell").cast("string"))
    placed = P.split_placements(first, None, 8, 16, 4)
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("h")).collect()
    assert max(r.cell.count(".") for r in cells) >= 2 and max(r.h for r in cells) <= 16
    assert placed.where("at_home").count() == placed.select("key").distinct().count() == placed.count() == 300


def test_pairs_of_a_graph_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(*args, **settings):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return P.similarity_pairs(*args, **settings).mapInPandas(count, "src bigint, dst bigint, weight double")

    monkeypatch.setattr(G, "similarity_pairs", counted)
    df, points = vectors(spark)
    graph = G.threshold_graph(df, 0.8)
    assert graph.where("src < dst").count() == len(brute(points, 0.8)) == seen.value
