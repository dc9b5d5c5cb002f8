"""Exploratory per-applicant statistics with plain column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators.grouped import Spec, grouped_features

KEY = "sk_id_curr"

# Column -> functions.
BUREAU_STATS: Spec = {
    "sk_id_bureau": ["count"],
    "days_credit": ["min", "max", "mean", "std"],
    "credit_day_overdue": ["max", "mean"],
    "amt_credit_max_overdue": ["max", "mean"],
    "amt_credit_sum": ["max", "mean", "sum"],
    "amt_credit_sum_debt": ["max", "mean", "sum"],
    "amt_credit_sum_overdue": ["max", "mean", "sum"],
    "amt_annuity": ["max", "mean", "sum"],
}
INSTALMENT_STATS: Spec = {
    "sk_id_prev": ["nunique"],
    "num_instalment_number": ["max", "mean", "std"],
    "days_instalment": ["min", "max", "mean"],
    "days_entry_payment": ["min", "max", "mean"],
    "amt_instalment": ["min", "max", "mean", "sum"],
    "amt_payment": ["min", "max", "mean", "sum"],
}
PAYMENT_STATS: Spec = {
    "payment_diff": ["min", "max", "mean", "std", "sum"],
    "payment_ratio": ["min", "max", "mean", "std"],
    "days_late": ["max", "mean", "std", "sum"],
}
PREVIOUS_STATS: Spec = {
    "sk_id_prev": ["count"],
    "amt_annuity": ["min", "max", "mean"],
    "amt_application": ["min", "max", "mean"],
    "amt_credit": ["min", "max", "mean"],
    "amt_down_payment": ["min", "max", "mean"],
    "amt_goods_price": ["min", "max", "mean"],
    "days_decision": ["min", "max", "mean"],
    "cnt_payment": ["min", "max", "mean"],
}


def bureau_stats(bureau: DataFrame) -> DataFrame:
    return grouped_features(bureau, KEY, BUREAU_STATS)


def instalment_stats(inst: DataFrame) -> DataFrame:
    return grouped_features(inst, KEY, INSTALMENT_STATS)


def previous_stats(prev: DataFrame) -> DataFrame:
    return grouped_features(prev, KEY, PREVIOUS_STATS)


def derive_payments(inst: DataFrame) -> DataFrame:
    return inst.select(
        KEY,
        C.diff("amt_payment", "amt_instalment").alias("payment_diff"),
        C.safe_ratio("amt_payment", "amt_instalment").alias("payment_ratio"),
        C.diff("days_entry_payment", "days_instalment").alias("days_late"),
    )


def payment_stats(inst: DataFrame) -> DataFrame:
    """Under- and over-payment and lateness per applicant."""
    return grouped_features(inst, KEY, PAYMENT_STATS, derive=derive_payments)


def approval_rate(prev: DataFrame) -> DataFrame:
    approved = C.flag(F.col("name_contract_status") == "Approved")
    return prev.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.avg(approved).alias("approval_rate"))


def key_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by key hash: the same rows on any cluster and in any order."""
    return df.orderBy(C.key_hash(key, seed), F.col(key)).limit(n)
