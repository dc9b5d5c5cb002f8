"""The two end-to-end jobs: train and store a run, and explain a stored run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.plans import evaluate, explain, families, graph, learn, prepare
from creditloom.session import checkpointed
from creditloom.sources import store

KEY, LABEL = "sk_id_curr", "target"


@dataclass(frozen=True)
class Options:
    model: str = "logistic"
    valid_share: float = prepare.VALID_SHARE
    up_sample: float = 0.0
    down_sample: float = 0.0
    clusters: int = learn.MAX_CLUSTERS
    restarts: int = learn.RESTARTS
    seed: int = learn.SEED


def encoded_features(tables: Mapping[str, DataFrame], options: Options = Options()) -> DataFrame:
    """The feature table with text columns as codes, checkpointed: everything below reads it often.

    Codes come from the training part; a value that only the validation part has becomes null.
    """
    return encoded(checkpointed(families.feature_table(tables)), options)


def encoded(features: DataFrame, options: Options = Options()) -> DataFrame:
    """A feature table that is stored, with its text columns as codes from the training part, checkpointed."""
    texts = [name for name, kind in features.dtypes if kind == "string"]
    training, _ = prepare.split(features, KEY, options.valid_share, options.seed)
    return checkpointed(prepare.factorise(training, texts).apply(features)) if texts else features


def train_run(tables: Mapping[str, DataFrame], folder: str, run: str, epoch: int = 1, options: Options = Options()):
    """Features, roles, clusters, training, validation scores, tiers and attributions; stores the run.

    Returns one row with AUC and log loss on the validation part. Codes, roles, limits and the projection
    are fitted on the training part; every stored row carries its key.
    """
    features = encoded_features(tables, options)
    training, validation = prepare.split(features, KEY, options.valid_share, options.seed)
    if options.up_sample:
        training = prepare.up_sample(training, LABEL, KEY, options.up_sample, options.seed)
    elif options.down_sample:
        training = prepare.down_sample(training, LABEL, KEY, options.down_sample, options.seed)

    roles = prepare.choose_roles(training, (KEY, LABEL))
    columns = [*roles.numeric, *roles.categorical]
    fitted = learn.train(options.model, training, KEY, LABEL, columns, options.seed)

    scaled = checkpointed(fitted.scaler.apply(features))
    chosen = prepare.cluster_columns(scaled, columns) or roles.numeric
    name = store.assignment_id(chosen, options.clusters, options.seed)

    def cluster() -> DataFrame:
        return learn.cluster_rows(scaled, KEY, chosen, options.clusters, options.restarts, options.seed)

    clustered = store.stored_clusters(scaled.select(KEY), KEY, folder, name, cluster)
    scores = checkpointed(fitted.score(validation))
    tiers = evaluate.risk_tiers(scores, "score").select(F.col(KEY).alias("sk_id"), "risk_level")

    vectors = checkpointed(learn.assemble_vector(scaled, columns).select(KEY, "features"))
    training_vectors, validation_vectors = prepare.split(vectors, KEY, options.valid_share, options.seed)
    placed = learn.fit_projection(training_vectors, "features", len(columns)).apply(validation_vectors)
    embeddings = placed.select(
        F.col(KEY).alias("sk_id"), vector_to_array("projected").cast("array<float>").alias("embedding")
    ).join(clustered.select(F.col(KEY).alias("sk_id"), "cluster"), "sk_id")

    parts = {"embeddings": embeddings, "risk_levels": tiers}
    if options.model == "logistic":
        weights, means = learn.linear_parts(fitted, training)
        contributions = explain.linear_attributions(fitted.scaler.apply(validation), KEY, weights, means)
        nodes = embeddings.select("sk_id", "cluster").join(tiers, "sk_id")
        parts["attributions"] = contributions.join(nodes, "sk_id")
    store.save_run(parts, folder, run, epoch)

    auc = evaluate.roc_auc(scores, "score", LABEL)
    return auc.withColumn("log_loss", evaluate.log_loss(scores, "score", LABEL).scalar())


def explain_run(
    spark: SparkSession, folder: str, run: str, epoch: int = 1, threshold: float = graph.THRESHOLD,
    max_nodes: int = graph.MAX_NODES, max_edges: int = graph.MAX_EDGES,
) -> dict[str, DataFrame]:
    """The tables behind the pictures of a stored run: tiers, plane, importances, explanations, edges."""
    parts = store.load_run(spark, folder, run, epoch)
    nodes, tiers = parts["embeddings"], parts["risk_levels"]
    attributions = parts["attributions"].withColumnRenamed("risk_level", "risk")
    dim = nodes.select(F.size("embedding")).first()[0]
    return {
        "tiers": evaluate.tier_distribution(tiers),
        "plane": graph_plane(nodes, tiers, dim),
        "top_features": explain.top_features_per_risk(attributions),
        "signed_features": explain.signed_by_risk(attributions),
        "explanations": explain.node_explanations(attributions),
        "edges": graph.similarity_edges(nodes, threshold, max_nodes, max_edges),
    }


def graph_plane(nodes: DataFrame, tiers: DataFrame, dim: int) -> DataFrame:
    return learn.plane(nodes, "sk_id", "embedding", dim).join(tiers, "sk_id", "left")
