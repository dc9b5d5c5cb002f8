"""Evaluation of scores: ROC, AUC, risk tiers, losses, class separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.functions import vectors as V
from creditloom.operators.ordered import quantiles, running_totals
from creditloom.plans.graph import sum_vectors

# Percentiles above which a score is medium and high risk.
MEDIUM_ABOVE, HIGH_ABOVE = 0.4, 0.8
LOG_CLIP = 1e-7


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, with the numbers of both at lower scores."""
    counted = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(score)
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    return running_totals(counted, [score], ["neg", "pos"])


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve; a tie across labels counts one half, one class only gives null."""
    counted = score_counts(df, score, label)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    sums = counted.agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(C.safe_ratio("wins", F.col("p") * F.col("n")).alias("auc"), "p", "n")


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """False and true positive rate when everything at or above each distinct score is accepted."""
    counted = score_counts(df, score, label)
    totals = counted.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    p, n = totals.getField("p"), totals.getField("n")
    return counted.select(
        F.col(score).alias("threshold"),
        C.safe_ratio(n - F.col("neg_before"), n).alias("fpr"),
        C.safe_ratio(p - F.col("pos_before"), p).alias("tpr"),
    )


def risk_tiers(df: DataFrame, score: str, medium: float = MEDIUM_ABOVE, high: float = HIGH_ABOVE) -> DataFrame:
    """Adds ``risk_level``: 0, 1 above the medium percentile, 2 above the high one (strictly)."""
    limits = quantiles(df, score, {"medium": medium, "high": high})
    limit = limits.select(F.struct("medium", "high")).scalar()
    level = F.when(F.col(score) > limit.getField("high"), 2).when(F.col(score) > limit.getField("medium"), 1)
    return df.withColumn("risk_level", level.otherwise(0))


def tier_distribution(tiers: DataFrame) -> DataFrame:
    counts = tiers.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", C.safe_ratio(F.col("n") * F.lit(100.0), total))


def class_separation(df: DataFrame, vector: str, label: str, dim: int) -> DataFrame:
    """Absolute cosine between the mean vectors of the two classes (scale-free, so sums do)."""
    sums = sum_vectors(df.withColumn("positive", F.col(label) == 1), ["positive"], vector, dim)
    sides = sums.agg(
        F.max(F.when(F.col("positive"), F.col(vector))).alias("a"),
        F.max(F.when(~F.col("positive"), F.col(vector))).alias("b"),
    )
    return sides.select(F.abs(V.cosine("a", "b")).alias("similarity"))


def log_loss(df: DataFrame, score: str, label: str, clip: float = LOG_CLIP) -> DataFrame:
    """Mean log loss over the rows that have a score and a label, as in :func:`roc_auc`."""
    present = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    p: Column = C.clamp(F.col(score), clip, 1.0 - clip)
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))
    return present.agg(F.avg(loss).alias("log_loss"))
