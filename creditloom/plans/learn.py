"""Fitting with MLlib: projections, clusters, rebalancing with synthetic rows, classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators.joins import lookup_join
from creditloom.operators.ordered import positions
from creditloom.operators.pairs import nearest_neighbours
from creditloom.plans import evaluate
from creditloom.plans.clusters import Clusters, fit_starts
from creditloom.plans.prepare import MinMaxScaler, fit_minmax, split
from creditloom.session import checkpointed

# Limits of the projection and the clustering, and the random seed.
MAX_COMPONENTS, MAX_CLUSTERS, RESTARTS, SEED = 50, 100, 10, 42
# Fixed value: minority rows per majority row after rebalancing (30 to 70).
MINORITY_RATIO = 0.429
NEIGHBOURS = 5


def assemble_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric columns, nulls as 0, as one vector column."""
    zero = F.lit(0.0)
    filled = F.array(*[F.coalesce(F.col(c).cast("double"), zero) for c in features])
    return df.withColumn(name, array_to_vector(filled))


# ---------------------------------------------------------------- projection
@dataclass(frozen=True)
class Projection:
    """Principal components on centred vectors; adds ``centred`` and ``projected``."""

    centre: Model
    components: Model

    def apply(self, df: DataFrame) -> DataFrame:
        return self.components.transform(self.centre.transform(df))


def fit_projection(df: DataFrame, vector: str, dim: int, components: int = MAX_COMPONENTS) -> Projection:
    """At most ``components`` directions, and never more than the dimension or the rows allow."""
    k = min(components, dim, max(df.count() - 1, 1))
    centre = StandardScaler(withMean=True, withStd=False, inputCol=vector, outputCol="centred").fit(df)
    return Projection(centre, PCA(k=k, inputCol="centred", outputCol="projected").fit(centre.transform(df)))


def reconstruction_error(projected: DataFrame) -> DataFrame:
    """Adds ``error``: mean squared difference to the back-projection, from the lost squared length."""
    length = "aggregate({}, 0D, (acc, x) -> acc + x * x)"
    spread = projected.withColumns({"c__": vector_to_array("centred"), "p__": vector_to_array("projected")})
    lost = F.greatest(F.expr(length.format("c__")) - F.expr(length.format("p__")), F.lit(0.0))
    return spread.withColumn("error", lost / F.size("c__")).drop("c__", "p__")


def plane(nodes: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, x, y): position of every node on the first two principal components."""
    table = nodes.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    flat = fit_projection(table, "features", dim, 2).apply(table).withColumn("p__", vector_to_array("projected"))
    return flat.select(key, F.col("p__")[0].alias("x"), F.col("p__")[1].alias("y"))


# ---------------------------------------------------------------- clusters
def fit_clusters(
    df: DataFrame, vector: str, clusters: int = MAX_CLUSTERS, restarts: int = RESTARTS, seed: int = SEED
) -> Clusters:
    """K-means with the lowest cost of several starts, which advance together."""
    return fit_starts(df, vector, clusters, restarts, seed)


def cluster_rows(
    df: DataFrame, key: str, features: Sequence[str], clusters: int = MAX_CLUSTERS, restarts: int = RESTARTS, seed: int = SEED
) -> DataFrame:
    """(key, cluster) after projecting the features on their principal components."""
    table = assemble_vector(df, features).select(key, "features")
    projected = fit_projection(table, "features", len(features)).apply(table)
    return fit_clusters(projected, "projected", clusters, restarts, seed).assign(projected, key)


# ---------------------------------------------------------------- synthetic minority rows
def synthesise(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    group: str,
    ratio: float = MINORITY_RATIO,
    copied: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """Minority rows on segments between a minority row and one of its nearest minority neighbours.

    Enough rows to reach ``ratio`` minority rows per majority row. Neighbours are those inside the
    same ``group`` (a cluster). Columns in ``copied`` (codes) take the value of the base row. Output:
    (key, features..., copied..., label, base, partner, synthetic); keys are -1, -2, ..., in hash order of the base rows.
    """
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("minor"), F.count_if(F.col(label) != 1).alias("major")).first()
    wanted = max(0, round(ratio * sizes["major"]) - sizes["minor"])
    each, extra = divmod(wanted, sizes["minor"]) if sizes["minor"] else (0, 0)

    point = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    minority = checkpointed(
        df.where(F.col(label) == 1).select(F.col(key).alias("base"), group, *copied, point.alias("point"))
    )
    near = (
        nearest_neighbours(minority, "base", "point", group, NEIGHBOURS)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    )
    # Exactly ``extra`` rows get one more copy: the first ones in hash order.
    hashed = minority.select("base", C.key_hash("base", f"smote{seed}").alias("h"))
    counts = positions(hashed, ["h", "base"]).select(
        "base", "position", (F.lit(each) + F.when(F.col("position") < extra, 1).otherwise(0)).alias("n")
    ).where(F.col("n") > 0)
    planned = (
        minority.join(counts, "base")
        .join(near.withColumnRenamed("key", "base"), "base", "left")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn("draw", F.concat_ws("/", F.col("base").cast("string"), F.col("i").cast("string")))
    )
    pick = F.pmod(C.key_hash("draw", f"pick{seed}"), F.size("near")).cast("int")
    chosen = planned.withColumn("partner", F.when(F.size("near") > 0, F.col("near")[pick]["neighbour"]).otherwise(F.col("base")))
    others = minority.select(F.col("base").alias("partner"), F.col("point").alias("other"))
    share = C.hash_unit("draw", f"lambda{seed}")
    mixed = lookup_join(chosen, others, "partner").withColumn("share", share).withColumn(
        "point", F.zip_with("point", "other", lambda a, b: a + F.col("share") * (b - a))
    )
    # The i-th copies of all minority rows are numbered one after the other, so no two rows share a number.
    identity = -(F.col("position") + (F.col("i") - 1).cast("bigint") * F.lit(sizes["minor"]) + 1)
    return mixed.select(
        identity.alias(key),
        *[F.col("point")[i].alias(c) for i, c in enumerate(features)],
        *copied,
        F.lit(1).alias(label),
        "base",
        "partner",
        F.lit(True).alias("synthetic"),
    )


def rebalance(df: DataFrame, key: str, label: str, features: Sequence[str], group: str, **options) -> DataFrame:
    """Original rows followed by the synthetic ones, told apart by ``synthetic``."""
    made = synthesise(df, key, label, features, group, **options).drop("base", "partner")
    originals = df.select(
        key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], *options.get("copied", ()), label
    )
    return originals.withColumn("synthetic", F.lit(False)).unionByName(made)


# ---------------------------------------------------------------- classifiers
def classifier(name: str, width: int, seed: int = SEED, **settings):
    """An unfitted two-class model by short name; ``settings`` replace its parameters."""
    columns = {"featuresCol": "features", "labelCol": "label__"}
    return _classifier(name, width, seed, columns).copy().setParams(**settings)


def _classifier(name: str, width: int, seed: int, columns: dict):
    if name == "logistic":
        return LogisticRegression(maxIter=50, regParam=0.001, **columns)
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=6, seed=seed, **columns)
    if name == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **columns)
    if name == "boosted":
        return GBTClassifier(maxIter=10, maxDepth=4, seed=seed, **columns)
    if name == "network":
        return MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=50, seed=seed, **columns)
    raise ValueError(f"unknown classifier {name}")


@dataclass(frozen=True)
class Fitted:
    model: Model
    scaler: MinMaxScaler
    features: list[str]
    key: str
    label: str

    def prepare(self, df: DataFrame) -> DataFrame:
        """(key, label, label__, features): scaled features as one vector."""
        scaled = F.array(*[self.scaler.expression(c) for c in self.features])
        return df.select(
            self.key, self.label, F.col(self.label).cast("double").alias("label__"),
            array_to_vector(scaled).alias("features"),
        )

    def score(self, df: DataFrame) -> DataFrame:
        """(key, label, score): probability of label 1."""
        scored = self.model.transform(self.prepare(df))
        return scored.select(self.key, self.label, vector_to_array("probability")[1].alias("score"))


def train(
    name: str, rows: DataFrame, key: str, label: str, features: Sequence[str], seed: int = SEED, **settings
) -> Fitted:
    """Scale on the training rows only, then fit; ``settings`` replace parameters of the model."""
    scaler = fit_minmax(rows, features)
    unfitted = Fitted(None, scaler, list(features), key, label)
    prepared = unfitted.prepare(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = classifier(name, len(features), seed, **settings).fit(prepared)
    finally:
        prepared.unpersist()
    return Fitted(model, scaler, list(features), key, label)


def train_and_evaluate(name: str, df: DataFrame, key: str, label: str, features: Sequence[str]) -> DataFrame:
    """One row: AUC and log loss on the validation part."""
    training, validation = split(df, key)
    scores = train(name, training, key, label, features).score(validation)
    auc = evaluate.roc_auc(scores, "score", label)
    loss = evaluate.log_loss(scores, "score", label).scalar()
    return auc.select(F.lit(name).alias("model"), (F.col("p") + F.col("n")).alias("n_valid"), "auc", loss.alias("log_loss"))


def linear_parts(fitted: Fitted, rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Coefficients of a logistic model and the means of its scaled features over ``rows``."""
    weights = dict(zip(fitted.features, map(float, fitted.model.coefficients)))
    scaled = fitted.scaler.apply(rows)
    means = scaled.agg(*[F.avg(c).alias(c) for c in fitted.features]).first().asDict()
    return weights, means
