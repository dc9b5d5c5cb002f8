"""The feature families of the loan tables: what each is derived from and which aggregates it has."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators.grouped import Look, Spec, Window, grouped_features, window_features
from creditloom.sources import layout

KEY = "sk_id_curr"

# Aggregate specifications, column -> functions.
PREV_SPEC: Spec = {
    "sk_id_curr": ["count"],
    "amt_credit": ["mean", "max", "sum"],
    "amt_annuity": ["mean", "max", "sum"],
    "amt_application": ["mean", "max", "sum"],
    "amt_down_payment": ["mean", "max", "sum"],
    "amt_goods_price": ["mean", "max", "sum"],
    "rate_down_payment": ["min", "max", "mean"],
    "days_decision": ["min", "max", "mean"],
    "cnt_payment": ["mean", "sum"],
    "prev_credit_diff": ["mean", "max", "sum"],
    "prev_credit_appl_ratio": ["mean", "max"],
    "prev_goods_diff": ["mean", "max", "sum"],
    "prev_goods_appl_ratio": ["mean", "max"],
    "prev_days_last_due_diff": ["mean", "max", "sum"],
    "prev_interests_rate": ["mean", "max"],
}
BUREAU_SPEC: Spec = {
    "sk_id_bureau": ["count"],
    "days_credit": ["min", "max", "mean"],
    "credit_day_overdue": ["min", "max", "mean"],
    "days_credit_enddate": ["min", "max", "mean"],
    "days_enddate_fact": ["min", "max", "mean"],
    "amt_credit_max_overdue": ["max", "mean"],
    "amt_credit_sum": ["max", "mean", "sum"],
    "amt_credit_sum_debt": ["max", "mean", "sum"],
    "amt_credit_sum_overdue": ["max", "mean", "sum"],
    "amt_annuity": ["max", "mean", "sum"],
    "bureau_enddate_fact_diff": ["min", "max", "mean"],
    "bureau_credit_fact_diff": ["min", "max", "mean"],
    "bureau_credit_enddate_diff": ["min", "max", "mean"],
    "bureau_credit_debt_ratio": ["min", "max", "mean"],
    "bureau_credit_debt_diff": ["min", "max", "mean"],
    "bureau_is_dpd": ["mean", "sum"],
    "bureau_is_dpd_over120": ["mean", "sum"],
}
BUREAU_BAL_SPEC: Spec = {
    "sk_id_curr": ["count"],
    "months_balance": ["min", "max", "mean"],
    "bureau_bal_is_dpd": ["mean", "sum"],
    "bureau_bal_is_dpd_over120": ["mean", "sum"],
}
POS_SPEC: Spec = {
    "sk_id_curr": ["count"],
    "months_balance": ["min", "mean", "max"],
    "sk_dpd": ["min", "max", "mean", "sum"],
    "cnt_instalment": ["min", "max", "mean", "sum"],
    "cnt_instalment_future": ["min", "max", "mean", "sum"],
    "pos_is_dpd": ["mean", "sum"],
    "pos_is_dpd_under_120": ["mean", "sum"],
    "pos_is_dpd_over_120": ["mean", "sum"],
}
INST_SPEC: Spec = {
    "sk_id_curr": ["count"],
    "num_instalment_version": ["nunique"],
    "days_entry_payment": ["mean", "max", "sum"],
    "days_instalment": ["mean", "max", "sum"],
    "amt_instalment": ["mean", "max", "sum"],
    "amt_payment": ["mean", "max", "sum"],
    "amt_diff": ["mean", "min", "max", "sum"],
    "amt_ratio": ["mean", "max"],
    "sk_dpd": ["mean", "min", "max"],
    "ins_is_dpd": ["mean", "sum"],
    "ins_is_dpd_under_120": ["mean", "sum"],
    "ins_is_dpd_over_120": ["mean", "sum"],
}
CARD_SPEC: Spec = {
    "sk_id_curr": ["count"],
    "amt_balance": ["max"],
    "amt_credit_limit_actual": ["max"],
    "amt_drawings_atm_current": ["max", "sum"],
    "amt_drawings_current": ["max", "sum"],
    "amt_drawings_pos_current": ["max", "sum"],
    "amt_inst_min_regularity": ["max", "mean"],
    "amt_payment_total_current": ["max", "sum"],
    "amt_total_receivable": ["max", "mean"],
    "cnt_drawings_atm_current": ["max", "sum"],
    "cnt_drawings_current": ["max", "mean", "sum"],
    "cnt_drawings_pos_current": ["mean"],
    "sk_dpd": ["mean", "max", "sum"],
    "balance_limit_ratio": ["min", "max"],
    "drawing_limit_ratio": ["min", "max"],
    "card_is_dpd": ["mean", "sum"],
    "card_is_dpd_under_120": ["mean", "sum"],
    "card_is_dpd_over_120": ["mean", "sum"],
}

# Recency limits, in days or months before the application.
PREV_RECENT_DAYS = -365
BUREAU_RECENT_DAYS = -750
POS_RECENT_MONTHS = -20
INST_RECENT_DAYS = -365
CARD_RECENT_MONTHS = -3

# Previous-application date columns in which the sentinel day number means "unknown".
SENTINEL_COLUMNS = (
    "days_first_drawing", "days_first_due", "days_last_due_1st_version", "days_last_due", "days_termination",
)
EXT_SOURCES = ("ext_source_1", "ext_source_2", "ext_source_3")


def prev_recent():
    return F.col("days_decision") > PREV_RECENT_DAYS


def bureau_active():
    return F.col("credit_active") == "Active"


def bureau_recent():
    return F.col("days_credit") > BUREAU_RECENT_DAYS


def pos_recent():
    return F.col("months_balance") > POS_RECENT_MONTHS


def inst_recent():
    return F.col("days_entry_payment") >= INST_RECENT_DAYS


def card_recent():
    return F.col("months_balance") >= CARD_RECENT_MONTHS


def applicant_ratios() -> dict:
    """The eleven applicant-level ratios by output name."""
    # Numerator and denominator of each ratio.
    pairs = {
        "apps_annuity_credit_ratio": ("amt_annuity", "amt_credit"),
        "apps_goods_credit_ratio": ("amt_goods_price", "amt_credit"),
        "apps_annuity_income_ratio": ("amt_annuity", "amt_income_total"),
        "apps_credit_income_ratio": ("amt_credit", "amt_income_total"),
        "apps_goods_income_ratio": ("amt_goods_price", "amt_income_total"),
        "apps_cnt_fam_income_ratio": ("amt_income_total", "cnt_fam_members"),
        "apps_employed_birth_ratio": ("days_employed", "days_birth"),
        "apps_income_employed_ratio": ("amt_income_total", "days_employed"),
        "apps_income_birth_ratio": ("amt_income_total", "days_birth"),
        "apps_car_birth_ratio": ("own_car_age", "days_birth"),
        "apps_car_employed_ratio": ("own_car_age", "days_employed"),
    }
    return {name: C.safe_ratio(a, b) for name, (a, b) in pairs.items()}


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Nulls of a column replaced by its mean over the table (a scalar subquery)."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def derive_app(app: DataFrame) -> DataFrame:
    derived = app.withColumns(
        {
            "apps_ext_source_mean": C.row_mean(EXT_SOURCES),
            "apps_ext_source_std": C.row_std(EXT_SOURCES),
            **applicant_ratios(),
        }
    )
    return fill_with_mean(derived, "apps_ext_source_std")


def derive_prev(prev: DataFrame) -> DataFrame:
    cleaned = prev.withColumns({c: C.sentinel_to_null(c) for c in SENTINEL_COLUMNS if c in prev.columns})
    return cleaned.withColumns(
        {
            "prev_credit_diff": C.diff("amt_application", "amt_credit"),
            "prev_goods_diff": C.diff("amt_application", "amt_goods_price"),
            "prev_credit_appl_ratio": C.safe_ratio("amt_credit", "amt_application"),
            "prev_goods_appl_ratio": C.safe_ratio("amt_goods_price", "amt_application"),
            "prev_days_last_due_diff": C.diff("days_last_due_1st_version", "days_last_due"),
            "prev_interests_rate": C.implied_rate("amt_annuity", "cnt_payment", "amt_credit"),
        }
    )


def derive_bureau(bureau: DataFrame) -> DataFrame:
    overdue = F.col("credit_day_overdue")
    return bureau.withColumns(
        {
            "bureau_enddate_fact_diff": C.diff("days_credit_enddate", "days_enddate_fact"),
            "bureau_credit_fact_diff": C.diff("days_credit", "days_enddate_fact"),
            "bureau_credit_enddate_diff": C.diff("days_credit", "days_credit_enddate"),
            "bureau_credit_debt_ratio": C.safe_ratio("amt_credit_sum_debt", "amt_credit_sum"),
            "bureau_credit_debt_diff": C.diff("amt_credit_sum_debt", "amt_credit_sum"),
            "bureau_is_dpd": C.flag(overdue > 0),
            "bureau_is_dpd_over120": C.flag(overdue > C.DPD_LIMIT),
        }
    )


def derive_bureau_bal(bureau_bal: DataFrame) -> DataFrame:
    return bureau_bal.withColumns(
        {
            "bureau_bal_is_dpd": C.member_flag("status", C.OVERDUE_STATUSES),
            "bureau_bal_is_dpd_over120": C.flag(F.col("status") == C.WORST_STATUS),
        }
    )


def derive_pos(pos: DataFrame) -> DataFrame:
    return pos.withColumns(C.dpd_flags(F.col("sk_dpd"), "pos_"))


def derive_inst(inst: DataFrame) -> DataFrame:
    return inst.withColumns(
        {
            "amt_diff": C.diff("amt_instalment", "amt_payment"),
            "amt_ratio": C.smoothed_ratio("amt_payment", "amt_instalment"),
            "sk_dpd": C.diff("days_entry_payment", "days_instalment"),
        }
    ).withColumns(C.dpd_flags(F.col("sk_dpd"), "ins_"))


def derive_card(card: DataFrame) -> DataFrame:
    return card.withColumns(
        {
            "balance_limit_ratio": C.safe_ratio("amt_balance", "amt_credit_limit_actual"),
            "drawing_limit_ratio": C.safe_ratio("amt_drawings_current", "amt_credit_limit_actual"),
            **C.dpd_flags(F.col("sk_dpd"), "card_"),
        }
    )


def prev_windows() -> list[Window]:
    return [Window("prev_"), Window("prev_d365_", prev_recent())]


def bureau_windows() -> list[Window]:
    return [Window("bureau_"), Window("bureau_act_", bureau_active()), Window("bureau_d750_", bureau_recent())]


def status_counts(prev: DataFrame) -> DataFrame:
    """Approved and refused counts of the applicants that have either."""
    counts = (
        prev.where(F.col("name_contract_status").isin("Approved", "Refused"))
        .groupBy(KEY)
        .pivot("name_contract_status", ["Approved", "Refused"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["Approved", "Refused"])
    )
    return counts.withColumnsRenamed({"Approved": "prev_approved_count", "Refused": "prev_refused_count"})


def status_ratios(prev: DataFrame) -> DataFrame:
    """Share of approved and refused among all previous applications.

    Null for an applicant with neither kind, which is how joining the two counts would leave it.
    """
    counted = prev.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("name_contract_status") == "Approved").alias("approved"),
        F.count_if(F.col("name_contract_status") == "Refused").alias("refused"),
    )
    return counted.select(KEY, *_status_share("approved", "refused", "n"))


def _status_share(approved: str, refused: str, total: str):
    decided = F.col(approved) + F.col(refused) > 0
    return (
        F.when(decided, C.safe_ratio(refused, total)).alias("prev_refused_ratio"),
        F.when(decided, C.safe_ratio(approved, total)).alias("prev_approved_ratio"),
    )


def prev_features(prev: DataFrame) -> DataFrame:
    """Both windows and the two status ratios, from one scan."""

    def derive(rows: DataFrame) -> DataFrame:
        status = F.col("name_contract_status")
        flags = {"is_approved": C.flag(status == "Approved"), "is_refused": C.flag(status == "Refused")}
        return derive_prev(rows).withColumns(flags)

    spec = {**PREV_SPEC, "is_approved": ["sum"], "is_refused": ["sum"]}
    features = window_features(prev, KEY, spec, prev_windows(), derive)
    ratios = _status_share("prev_is_approved_sum", "prev_is_refused_sum", "prev_sk_id_curr_count")
    helpers = [f"{p}is_{s}_sum" for p in ("prev_", "prev_d365_") for s in ("approved", "refused")]
    return features.select("*", *ratios).drop(*helpers)


def active_overdue_ratios() -> dict:
    total = "bureau_sk_id_bureau_count"
    return {
        "bureau_act_is_dpd_ratio": C.safe_ratio("bureau_act_bureau_is_dpd_sum", total),
        "bureau_act_is_dpd_over120_ratio": C.safe_ratio("bureau_act_bureau_is_dpd_over120_sum", total),
    }


def bureau_window_features(bureau: DataFrame) -> DataFrame:
    """All, active and recent credits from one scan, with the active-overdue ratios."""
    features = window_features(bureau, KEY, BUREAU_SPEC, bureau_windows(), derive_bureau)
    return features.withColumns(active_overdue_ratios())


def bureau_balance_features(bureau: DataFrame, bureau_bal: DataFrame) -> DataFrame:
    """Monthly balance features per applicant.

    The months of a credit are reduced before the parent lookup, so the join has one row per credit
    on both sides and a credit with very many months cannot skew it.
    """
    months = derive_bureau_bal(bureau_bal).withColumnRenamed("months_balance", "m")
    per_credit = months.where(F.col("sk_id_bureau").isNotNull()).groupBy("sk_id_bureau").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("m").alias("m_n"),
        F.sum("m").alias("m_sum"),
        F.min("m").alias("m_min"),
        F.max("m").alias("m_max"),
        F.sum("bureau_bal_is_dpd").alias("dpd"),
        F.sum("bureau_bal_is_dpd_over120").alias("over"),
    )
    owned = per_credit.join(bureau.select(KEY, "sk_id_bureau"), "sk_id_bureau", "inner")
    merged = owned.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        *[F.sum(c).alias(c) for c in ("rows", "m_n", "m_sum", "dpd", "over")],
        F.min("m_min").alias("m_min"),
        F.max("m_max").alias("m_max"),
    )
    p = "bureau_bal_"
    return merged.select(
        KEY,
        F.col("rows").alias(f"{p}sk_id_curr_count"),
        F.col("m_min").alias(f"{p}months_balance_min"),
        F.col("m_max").alias(f"{p}months_balance_max"),
        F.try_divide("m_sum", "m_n").alias(f"{p}months_balance_mean"),
        F.try_divide("dpd", "rows").alias(f"{p}bureau_bal_is_dpd_mean"),
        F.col("dpd").alias(f"{p}bureau_bal_is_dpd_sum"),
        F.try_divide("over", "rows").alias(f"{p}bureau_bal_is_dpd_over120_mean"),
        F.col("over").alias(f"{p}bureau_bal_is_dpd_over120_sum"),
    )


def bureau_features(bureau: DataFrame, bureau_bal: DataFrame) -> DataFrame:
    return bureau_window_features(bureau).join(bureau_balance_features(bureau, bureau_bal), KEY, "left")


def pos_windows() -> list[Window]:
    return [Window("pos_"), Window("pos_m20_", pos_recent())]


def inst_windows() -> list[Window]:
    return [Window("ins_"), Window("ins_d365_", inst_recent())]


def card_windows() -> list[Window]:
    return [Window("card_"), Window("card_m3_", card_recent())]


def pos_features(pos: DataFrame) -> DataFrame:
    return window_features(pos, KEY, POS_SPEC, pos_windows(), derive_pos)


def inst_features(inst: DataFrame, look: Look | None = None) -> DataFrame:
    return window_features(inst, KEY, INST_SPEC, inst_windows(), derive_inst, look)


def card_features(card: DataFrame) -> DataFrame:
    return window_features(card, KEY, CARD_SPEC, card_windows(), derive_card)


def assemble(app: DataFrame, features: list[DataFrame]) -> DataFrame:
    """Left star join on the applicant key; every side has one row per applicant."""
    result = app
    for table in features:
        result = result.join(table, KEY, "left")
    return result


def feature_families(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The applicants and every family of features, one row per applicant each."""
    return {
        "app": derive_app(tables["app"]),
        "prev": prev_features(tables["prev"]),
        "bureau": bureau_features(tables["bureau"], tables["bureau_bal"]),
        "pos": pos_features(tables["pos"]),
        "inst": inst_features(tables["inst"]),
        "card": card_features(tables["card"]),
    }


def feature_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The whole applicant feature table before encoding."""
    app, *features = feature_families(tables).values()
    return assemble(app, features)


def store_features(tables: Mapping[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """Compute every family once and store it by applicant."""
    layout.store_families(feature_families(tables), folder, KEY, buckets)


def stored_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table from the stored families, in the order of :func:`feature_table`, without an exchange."""
    return layout.merged(spark, folder, "app", KEY, ["prev", "bureau", "pos", "inst", "card"])


def single_window(df: DataFrame, spec: Spec, window: Window, derive) -> DataFrame:
    """One window of a family on its own."""
    rows = df if window.condition is None else df.where(window.condition)
    return grouped_features(rows, KEY, spec, window.prefix, derive)
