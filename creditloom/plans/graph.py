"""Similarity and cluster graphs as edge tables, and neighbour aggregation over them.

Edges are (src, dst, weight). ``copies`` counts the rows that the node ``dst`` stands for: a vector
that occurs many times is one node, and sums over neighbours count it with its multiplicity, which gives
every copy the value it would have had on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.functions import vectors as V
from creditloom.operators.joins import sized_join
from creditloom.operators.pairs import distinct_vectors, similarity_pairs
from creditloom.plans.explore import key_sample
from creditloom.session import checkpointed

# Defaults of the drawn graph.
THRESHOLD, MAX_NODES, MAX_EDGES = 0.85, 500, 1000


# ---------------------------------------------------------------- edges
def strongest_edges(edges: DataFrame, n: int = MAX_EDGES) -> DataFrame:
    return edges.orderBy(F.col("weight").desc(), F.col("src"), F.col("dst")).limit(n)


def similarity_edges(
    nodes: DataFrame, threshold: float = THRESHOLD, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, seed: int = 42
) -> DataFrame:
    """Strongest edges among a key-hash sample of nodes: the graph that is drawn."""
    sample = key_sample(nodes, "sk_id", max_nodes, seed)
    edges = similarity_pairs(sample, "sk_id", "embedding", threshold)
    return strongest_edges(edges, max_edges)


def threshold_graph(nodes: DataFrame, threshold: float) -> DataFrame:
    """Both directions of every similar pair, and a loop per node: (src, dst, weight, copies).

    The edges are checkpointed: finding them costs far more than reading them back, and every use of
    the graph reads them more than once.
    """
    distinct = checkpointed(distinct_vectors(nodes, "sk_id", "embedding"))
    # Exchanged and checkpointed, so that the pairs, which several branches below read, are compared once.
    half = checkpointed(similarity_pairs(distinct, "sk_id", "embedding", threshold).repartition("src", "dst"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    loops = distinct.select(F.col("sk_id").alias("src"), F.col("sk_id").alias("dst"), F.lit(1.0).alias("weight"))
    copies = distinct.select(F.col("sk_id").alias("dst"), "copies")
    edges = sized_join(both.unionByName(loops), copies, "dst").select("src", "dst", "weight", "copies")
    return checkpointed(edges)


def for_every_node(results: DataFrame, members: DataFrame) -> DataFrame:
    """Results on distinct vectors (sk_id, ...) as rows for every node: copies have what their representative has.

    ``members`` is the (sk_id, representative) table of :func:`pairs.copy_members`.
    """
    at = results.withColumnRenamed("sk_id", "representative")
    return sized_join(members, at, "representative").select("sk_id", *[c for c in results.columns if c != "sk_id"])


def node_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Number of other nodes that each node is linked to, copies included."""
    links = (F.sum("copies") - 1).cast("bigint").alias("links")
    return for_every_node(edges.groupBy(F.col("src").alias("sk_id")).agg(links), members)


def cluster_membership(nodes: DataFrame) -> DataFrame:
    """The same-cluster graph, factored: every node points at its cluster.

    All pairs inside clusters would be one row per pair, so a cluster with a third of the nodes
    would be quadratic. The adjacency with loops is block-constant, hence fully given by the size
    of each cluster: a node has ``degree`` neighbours and every one of its normalised edges weighs
    ``1 / degree``.
    """
    sizes = nodes.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("degree"))
    return sized_join(nodes.select("sk_id", "cluster"), sizes, "cluster").select(
        "sk_id", "cluster", "degree", (F.lit(1.0) / F.col("degree")).alias("edge_weight")
    )


def cluster_adjacency(nodes: DataFrame) -> DataFrame:
    """Per cluster: nodes, undirected edges between different nodes, and loops."""
    sizes = nodes.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_nodes"))
    n = F.col("n_nodes")
    return sizes.select(
        "cluster", "n_nodes", (n * (n - 1) / 2).cast("bigint").alias("n_edges"), n.alias("n_loops")
    )


def cluster_means(nodes: DataFrame, dim: int) -> DataFrame:
    """Mean vector per cluster: what aggregation over the normalised same-cluster graph gives its nodes."""
    return mean_vectors(nodes, ["cluster"], "embedding", dim)


def edge_features(edges: DataFrame) -> DataFrame:
    similarity = F.col("weight")
    return edges.select(
        "src", "dst", similarity.alias("similarity"), C.gaussian_kernel(similarity).alias("gaussian"),
        C.smooth_threshold(similarity).alias("smooth"),
    )


# ---------------------------------------------------------------- sums of vectors
def _element(vector: str, i: int) -> Column:
    return F.col(vector)[i].cast("double")


def sum_vectors(df: DataFrame, by: Sequence[str], vector: str, dim: int, weight: Column | None = None) -> DataFrame:
    """Weighted element-wise sum of a vector column per group, as ``array<double>``.

    One plain sum per element: rows stay as they are and combine before the shuffle.
    """
    factor = F.lit(1.0) if weight is None else weight
    reduced = df.groupBy(*by).agg(*[F.sum(_element(vector, i) * factor).alias(f"e{i}") for i in range(dim)])
    return reduced.select(*by, F.array(*[F.col(f"e{i}") for i in range(dim)]).alias(vector))


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str, dim: int) -> DataFrame:
    reduced = df.groupBy(*by).agg(*[F.avg(_element(vector, i)).alias(f"e{i}") for i in range(dim)])
    return reduced.select(*by, F.array(*[F.col(f"e{i}") for i in range(dim)]).alias(vector))


# ---------------------------------------------------------------- degrees and normalisation
def degrees(edges: DataFrame, weighted: bool = False) -> DataFrame:
    one = F.col("weight") if weighted else F.lit(1.0)
    return edges.groupBy("src").agg(F.sum(one * F.col("copies")).alias("degree"))


def normalised(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Symmetric normalisation: the weight of (i, j) over the root of both degrees."""
    degree = checkpointed(degrees(edges, weighted))
    at_src = sized_join(edges, degree.withColumnRenamed("degree", "d_src"), "src")
    at_both = sized_join(at_src, degree.select(F.col("src").alias("dst"), F.col("degree").alias("d_dst")), "dst")
    base = F.col("weight") if weighted else F.lit(1.0)
    return at_both.select(
        "src", "dst", (base / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("weight"), "copies"
    )


# ---------------------------------------------------------------- neighbour aggregation
def _messages(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with the vector of their ``dst`` side; a node with very many edges is spread over tasks."""
    return sized_join(edges, values.select(F.col("sk_id").alias("dst"), "embedding"), "dst")


def propagate(edges: DataFrame, values: DataFrame, dim: int, hops: int = 1) -> DataFrame:
    """``hops`` rounds of normalised neighbour sums, starting from ``values`` (sk_id, embedding)."""
    weights = checkpointed(normalised(edges))
    current = values
    for hop in range(hops):
        sums = sum_vectors(_messages(weights, current), ["src"], "embedding", dim, F.col("weight") * F.col("copies"))
        current = sums.select(F.col("src").alias("sk_id"), "embedding")
        if hop + 1 < hops:
            current = checkpointed(current)
    return current


def neighbour_mean(edges: DataFrame, values: DataFrame, dim: int) -> DataFrame:
    """Plain mean over neighbours, the node itself included through its loop."""
    joined = _messages(edges, values)
    reduced = joined.groupBy("src").agg(
        F.sum("copies").alias("n"),
        *[F.sum(_element("embedding", i) * F.col("copies")).alias(f"e{i}") for i in range(dim)],
    )
    means = F.array(*[F.col(f"e{i}") / F.col("n") for i in range(dim)])
    return reduced.select(F.col("src").alias("sk_id"), means.alias("embedding"))


def attention(edges: DataFrame, values: DataFrame, dim: int) -> DataFrame:
    """Attention weights over the neighbours of each node: (src, dst, attention, copies).

    Scores are scaled dot products; the softmax subtracts the largest score of the node.
    """
    targets = values.select(F.col("sk_id").alias("src"), F.col("embedding").alias("query"))
    scored = checkpointed(
        sized_join(_messages(edges, values), targets, "src").select(
            "src", "dst", "copies", (V.dot("query", "embedding") / F.lit(float(dim) ** 0.5)).alias("score")
        )
    )
    tops = scored.groupBy("src").agg(F.max("score").alias("top"))
    raised = checkpointed(sized_join(scored, tops, "src").withColumn("raised", F.exp(F.col("score") - F.col("top"))))
    totals = raised.groupBy("src").agg(F.sum(F.col("raised") * F.col("copies")).alias("total"))
    return sized_join(raised, totals, "src").select(
        "src", "dst", (F.col("raised") / F.col("total")).alias("attention"), "copies"
    )


def attend(edges: DataFrame, values: DataFrame, dim: int) -> DataFrame:
    """Attention-weighted sum over neighbours."""
    weights = attention(edges, values, dim)
    sums = sum_vectors(_messages(weights, values), ["src"], "embedding", dim, F.col("attention") * F.col("copies"))
    return sums.select(F.col("src").alias("sk_id"), "embedding")


def fuse(own: DataFrame, neighbours: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``alpha`` parts of the own vector and the rest of the neighbours' one."""
    other = neighbours.select("sk_id", F.col("embedding").alias("other"))
    return own.select("sk_id", "embedding").join(other, "sk_id").select(
        "sk_id", V.blend("embedding", "other", alpha).alias("embedding")
    )
