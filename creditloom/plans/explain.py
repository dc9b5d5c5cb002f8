"""Attribution tables in long form: (sk_id, feature, value), optionally with a class or a risk level."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ordered import top_per_group

# Sizes of the reports.
TOP_PER_RISK, TOP_OVERALL, TOP_PER_NODE = 10, 20, 5


def importance(attributions: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute attribution per feature and group."""
    return attributions.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def top_features_per_risk(attributions: DataFrame, n: int = TOP_PER_RISK) -> DataFrame:
    ranked = importance(attributions, ["risk"])
    return top_per_group(ranked, ["risk"], [F.col("importance").desc(), F.col("feature")], n)


def signed_by_risk(attributions: DataFrame, n: int = TOP_OVERALL) -> DataFrame:
    """Signed mean attribution per risk level for the features that matter most overall."""
    per_risk = attributions.groupBy("risk", "feature").agg(
        F.sum("value").alias("total"), F.sum(F.abs("value")).alias("size"), F.count("value").alias("n")
    )
    # One row per feature from here on.
    means = per_risk.groupBy("feature").agg(
        (F.sum("size") / F.sum("n")).alias("importance"),
        *[
            F.max(F.when(F.col("risk") == r, F.try_divide("total", "n"))).alias(name)
            for r, name in ((0, "low"), (1, "medium"), (2, "high"))
        ],
    )
    return means.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def top_per_node(attributions: DataFrame, n: int = TOP_PER_NODE) -> DataFrame:
    size = F.abs("value")
    return top_per_group(attributions, ["sk_id"], [size.desc(), F.col("feature")], n)


def node_explanations(attributions: DataFrame, n: int = TOP_PER_NODE) -> DataFrame:
    direction = F.when(F.col("value") > 0, "increases risk").otherwise("decreases risk")
    return top_per_node(attributions, n).select(
        "sk_id", "rank", "feature", F.abs("value").alias("size"), direction.alias("direction")
    )


def reduce_classes(attributions: DataFrame, classes: int) -> DataFrame:
    """One value per node and feature: that of class 1 of two, else the sum over the classes."""
    if classes == 2:
        return attributions.where(F.col("class") == 1).drop("class")
    return attributions.groupBy("sk_id", "feature").agg(F.sum("value").alias("value"))


def linear_attributions(
    df: DataFrame, key: str, weights: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """Exact contributions ``w * (x - mean)`` of a linear score; they add up to its distance from the mean score."""
    entries = [
        F.struct(
            F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(means[c])))).alias("value")
        )
        for c, w in weights.items()
    ]
    return df.select(F.col(key).alias("sk_id"), F.inline(F.array(*entries)))
