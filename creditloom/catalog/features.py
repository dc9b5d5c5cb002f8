"""Queries: derived columns, feature families and their assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.base import (
    Catalog,
    quotient_features,
    r6,
    rounded,
    select_list,
    spec_sql,
)
from creditloom.functions import columns as C
from creditloom.operators.grouped import Look, feature_names, grouped_features, joined_windows, window_features
from creditloom.plans import families as fam
from creditloom.plans import prepare
from creditloom.session import fresh_path
from creditloom.sources import layout

catalog = Catalog()

# ---------------------------------------------------------------- derived tables in SQL
# Numerator and denominator of each ratio.
APP_RATIOS = {
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


def quotient(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


EXT_MEAN = "list_avg(list_filter([ext_source_1, ext_source_2, ext_source_3], lambda x: x IS NOT NULL))"
EXT_STD = "list_stddev_samp(list_filter([ext_source_1, ext_source_2, ext_source_3], lambda x: x IS NOT NULL))"

PREV_D = f"""prev_d AS (
SELECT * REPLACE (nullif(days_last_due, 365243) AS days_last_due,
                  nullif(days_last_due_1st_version, 365243) AS days_last_due_1st_version),
  amt_application - amt_credit AS prev_credit_diff,
  amt_application - amt_goods_price AS prev_goods_diff,
  {quotient('amt_credit', 'amt_application')} AS prev_credit_appl_ratio,
  {quotient('amt_goods_price', 'amt_application')} AS prev_goods_appl_ratio,
  nullif(days_last_due_1st_version, 365243) - nullif(days_last_due, 365243) AS prev_days_last_due_diff,
  (amt_annuity * cnt_payment / nullif(amt_credit, 0) - 1) / nullif(cnt_payment, 0) AS prev_interests_rate
FROM prev)"""
BUREAU_D = f"""bureau_d AS (
SELECT *, days_credit_enddate - days_enddate_fact AS bureau_enddate_fact_diff,
  days_credit - days_enddate_fact AS bureau_credit_fact_diff,
  days_credit - days_credit_enddate AS bureau_credit_enddate_diff,
  {quotient('amt_credit_sum_debt', 'amt_credit_sum')} AS bureau_credit_debt_ratio,
  amt_credit_sum_debt - amt_credit_sum AS bureau_credit_debt_diff,
  CASE WHEN credit_day_overdue > 0 THEN 1 ELSE 0 END AS bureau_is_dpd,
  CASE WHEN credit_day_overdue > 120 THEN 1 ELSE 0 END AS bureau_is_dpd_over120
FROM bureau)"""
BUREAU_BAL_D = """bureau_bal_d AS (
SELECT *, CASE WHEN status IN ('1', '2', '3', '4', '5') THEN 1 ELSE 0 END AS bureau_bal_is_dpd,
  CASE WHEN status = '5' THEN 1 ELSE 0 END AS bureau_bal_is_dpd_over120
FROM bureau_bal)"""


def dpd_sql(value: str, prefix: str) -> str:
    return f"""CASE WHEN {value} > 0 THEN 1 ELSE 0 END AS {prefix}is_dpd,
  CASE WHEN {value} > 0 AND {value} < 120 THEN 1 ELSE 0 END AS {prefix}is_dpd_under_120,
  CASE WHEN {value} >= 120 THEN 1 ELSE 0 END AS {prefix}is_dpd_over_120"""


POS_D = f"pos_d AS (\nSELECT *, {dpd_sql('sk_dpd', 'pos_')}\nFROM pos)"
INST_D = f"""inst_d AS (
SELECT *, amt_instalment - amt_payment AS amt_diff,
  (amt_payment + 1) / nullif(amt_instalment + 1, 0) AS amt_ratio,
  days_entry_payment - days_instalment AS sk_dpd,
  {dpd_sql('(days_entry_payment - days_instalment)', 'ins_')}
FROM inst)"""
CARD_D = f"""card_d AS (
SELECT *, {quotient('amt_balance', 'amt_credit_limit_actual')} AS balance_limit_ratio,
  {quotient('amt_drawings_current', 'amt_credit_limit_actual')} AS drawing_limit_ratio,
  {dpd_sql('sk_dpd', 'card_')}
FROM card)"""
APP_D = f"""app_s AS (SELECT *, {EXT_MEAN} AS apps_ext_source_mean, {EXT_STD} AS std0 FROM app),
app_d AS (
SELECT * EXCLUDE (std0), coalesce(std0, (SELECT avg(std0) FROM app_s)) AS apps_ext_source_std,
  {select_list(f'{quotient(a, b)} AS {n}' for n, (a, b) in APP_RATIOS.items())}
FROM app_s)"""

PREV_RECENT, BUREAU_ACTIVE, BUREAU_RECENT = "days_decision > -365", "credit_active = 'Active'", "days_credit > -750"
POS_RECENT, INST_RECENT, CARD_RECENT = "months_balance > -20", "days_entry_payment >= -365", "months_balance >= -3"


# ---------------------------------------------------------------- P: derived columns and predicates
def columns_job(view: str, keys: list[str], make, digits: bool = True):
    def job(v):
        made = make()
        df = getattr(v, view).select(*keys, *[c.alias(n) for n, c in made.items()])
        return rounded(df, *made) if digits else df

    return job


def columns_sql(view: str, keys: list[str], made: dict[str, str], digits: bool = True) -> str:
    items = [f"{r6(sql) if digits else sql} AS {name}" for name, sql in made.items()]
    return f"SELECT {select_list([*keys, *items])}\nFROM {view}"


def add_columns(name: str, view: str, keys: list[str], make, sql: dict[str, str], digits: bool = True) -> None:
    catalog.add(name, columns_job(view, keys, make, digits), columns_sql(view, keys, sql, digits))


PREV_KEYS, BUREAU_KEYS = ["sk_id_curr", "sk_id_prev"], ["sk_id_curr", "sk_id_bureau"]
INST_KEYS = ["sk_id_curr", "sk_id_prev", "num_instalment_number", "days_instalment"]

add_columns(
    "p1_prev_diffs", "prev", PREV_KEYS,
    lambda: {
        "prev_credit_diff": C.diff("amt_application", "amt_credit"),
        "prev_goods_diff": C.diff("amt_application", "amt_goods_price"),
        "prev_days_last_due_diff": C.diff(
            C.sentinel_to_null("days_last_due_1st_version"), C.sentinel_to_null("days_last_due")
        ),
    },
    {
        "prev_credit_diff": "amt_application - amt_credit",
        "prev_goods_diff": "amt_application - amt_goods_price",
        "prev_days_last_due_diff": "nullif(days_last_due_1st_version, 365243) - nullif(days_last_due, 365243)",
    },
    digits=False,
)
add_columns(
    "p1_bureau_diffs", "bureau", BUREAU_KEYS,
    lambda: {
        "bureau_enddate_fact_diff": C.diff("days_credit_enddate", "days_enddate_fact"),
        "bureau_credit_fact_diff": C.diff("days_credit", "days_enddate_fact"),
        "bureau_credit_enddate_diff": C.diff("days_credit", "days_credit_enddate"),
        "bureau_credit_debt_diff": C.diff("amt_credit_sum_debt", "amt_credit_sum"),
    },
    {
        "bureau_enddate_fact_diff": "days_credit_enddate - days_enddate_fact",
        "bureau_credit_fact_diff": "days_credit - days_enddate_fact",
        "bureau_credit_enddate_diff": "days_credit - days_credit_enddate",
        "bureau_credit_debt_diff": "amt_credit_sum_debt - amt_credit_sum",
    },
    digits=False,
)
add_columns(
    "p1_inst_diffs", "inst", INST_KEYS,
    lambda: {
        "amt_diff": C.diff("amt_instalment", "amt_payment"),
        "days_late": C.diff("days_entry_payment", "days_instalment"),
    },
    {"amt_diff": "amt_instalment - amt_payment", "days_late": "days_entry_payment - days_instalment"},
    digits=False,
)
add_columns(
    "p2_app_ratios", "app", ["sk_id_curr"], fam.applicant_ratios,
    {name: quotient(a, b) for name, (a, b) in APP_RATIOS.items()},
)
add_columns(
    "p2_prev_ratios", "prev", PREV_KEYS,
    lambda: {
        "prev_credit_appl_ratio": C.safe_ratio("amt_credit", "amt_application"),
        "prev_goods_appl_ratio": C.safe_ratio("amt_goods_price", "amt_application"),
    },
    {
        "prev_credit_appl_ratio": quotient("amt_credit", "amt_application"),
        "prev_goods_appl_ratio": quotient("amt_goods_price", "amt_application"),
    },
)
add_columns(
    "p2_bureau_ratio", "bureau", BUREAU_KEYS,
    lambda: {"bureau_credit_debt_ratio": C.safe_ratio("amt_credit_sum_debt", "amt_credit_sum")},
    {"bureau_credit_debt_ratio": quotient("amt_credit_sum_debt", "amt_credit_sum")},
)
add_columns(
    "p2_card_ratios", "card", PREV_KEYS,
    lambda: {
        "balance_limit_ratio": C.safe_ratio("amt_balance", "amt_credit_limit_actual"),
        "drawing_limit_ratio": C.safe_ratio("amt_drawings_current", "amt_credit_limit_actual"),
    },
    {
        "balance_limit_ratio": quotient("amt_balance", "amt_credit_limit_actual"),
        "drawing_limit_ratio": quotient("amt_drawings_current", "amt_credit_limit_actual"),
    },
)
add_columns(
    "p2_inst_payment_ratio", "inst", INST_KEYS,
    lambda: {"payment_ratio": C.safe_ratio("amt_payment", "amt_instalment")},
    {"payment_ratio": quotient("amt_payment", "amt_instalment")},
)
add_columns(
    "p3_smoothed_ratio", "inst", INST_KEYS,
    lambda: {"amt_ratio": C.smoothed_ratio("amt_payment", "amt_instalment")},
    {"amt_ratio": "(amt_payment + 1) / nullif(amt_instalment + 1, 0)"},
)
add_columns(
    "p4_implied_rate", "prev", PREV_KEYS,
    lambda: {"prev_interests_rate": C.implied_rate("amt_annuity", "cnt_payment", "amt_credit")},
    {"prev_interests_rate": "(amt_annuity * cnt_payment / nullif(amt_credit, 0) - 1) / nullif(cnt_payment, 0)"},
)
add_columns(
    "p5_row_mean", "app", ["sk_id_curr"],
    lambda: {"apps_ext_source_mean": C.row_mean(fam.EXT_SOURCES)}, {"apps_ext_source_mean": EXT_MEAN},
)
add_columns(
    "p6_row_std", "app", ["sk_id_curr"],
    lambda: {"apps_ext_source_std": C.row_std(fam.EXT_SOURCES)}, {"apps_ext_source_std": EXT_STD},
)
catalog.add(
    "p7_fill_with_mean",
    lambda v: rounded(
        fam.fill_with_mean(
            v.app.select("sk_id_curr", C.row_std(fam.EXT_SOURCES).alias("apps_ext_source_std")),
            "apps_ext_source_std",
        ),
        "apps_ext_source_std",
    ),
    f"""WITH s AS (SELECT sk_id_curr, {EXT_STD} AS x FROM app)
SELECT sk_id_curr, {r6('coalesce(x, (SELECT avg(x) FROM s))')} AS apps_ext_source_std FROM s""",
)
add_columns(
    "p8_sentinel_to_null", "prev", PREV_KEYS,
    lambda: {c: C.sentinel_to_null(c) for c in ("days_last_due", "days_last_due_1st_version")},
    {c: f"nullif({c}, 365243)" for c in ("days_last_due", "days_last_due_1st_version")},
    digits=False,
)


def flags_sql(value: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}is_dpd": f"CASE WHEN {value} > 0 THEN 1 ELSE 0 END",
        f"{prefix}is_dpd_under_120": f"CASE WHEN {value} > 0 AND {value} < 120 THEN 1 ELSE 0 END",
        f"{prefix}is_dpd_over_120": f"CASE WHEN {value} >= 120 THEN 1 ELSE 0 END",
    }


add_columns(
    "p9_pos_flags", "pos", PREV_KEYS, lambda: C.dpd_flags(F.col("sk_dpd"), "pos_"),
    flags_sql("sk_dpd", "pos_"), digits=False,
)
add_columns(
    "p9_card_flags", "card", PREV_KEYS, lambda: C.dpd_flags(F.col("sk_dpd"), "card_"),
    flags_sql("sk_dpd", "card_"), digits=False,
)
add_columns(
    "p9_inst_flags", "inst", INST_KEYS,
    lambda: C.dpd_flags(C.diff("days_entry_payment", "days_instalment"), "ins_"),
    flags_sql("(days_entry_payment - days_instalment)", "ins_"), digits=False,
)
add_columns(
    "p9_bureau_flags", "bureau", BUREAU_KEYS,
    lambda: {
        "bureau_is_dpd": C.flag(F.col("credit_day_overdue") > 0),
        "bureau_is_dpd_over120": C.flag(F.col("credit_day_overdue") > C.DPD_LIMIT),
    },
    {
        "bureau_is_dpd": "CASE WHEN credit_day_overdue > 0 THEN 1 ELSE 0 END",
        "bureau_is_dpd_over120": "CASE WHEN credit_day_overdue > 120 THEN 1 ELSE 0 END",
    },
    digits=False,
)
add_columns(
    "p10_status_flags", "bureau_bal", ["sk_id_bureau", "months_balance", "status"],
    lambda: {
        "bureau_bal_is_dpd": C.member_flag("status", C.OVERDUE_STATUSES),
        "bureau_bal_is_dpd_over120": C.flag(F.col("status") == C.WORST_STATUS),
    },
    {
        "bureau_bal_is_dpd": "CASE WHEN status IN ('1', '2', '3', '4', '5') THEN 1 ELSE 0 END",
        "bureau_bal_is_dpd_over120": "CASE WHEN status = '5' THEN 1 ELSE 0 END",
    },
    digits=False,
)
add_columns(
    "p10_approved_flag", "prev", PREV_KEYS,
    lambda: {"approved": C.flag(F.col("name_contract_status") == "Approved")},
    {"approved": "CASE WHEN name_contract_status = 'Approved' THEN 1 ELSE 0 END"}, digits=False,
)
for _name, _view, _keys, _make, _sql in [
    ("p11_prev_recent", "prev", [*PREV_KEYS, "days_decision"], fam.prev_recent, PREV_RECENT),
    ("p11_bureau_recent", "bureau", [*BUREAU_KEYS, "days_credit"], fam.bureau_recent, BUREAU_RECENT),
    ("p11_pos_recent", "pos", [*PREV_KEYS, "months_balance"], fam.pos_recent, POS_RECENT),
    ("p11_inst_recent", "inst", [*INST_KEYS, "days_entry_payment"], fam.inst_recent, INST_RECENT),
    ("p11_card_recent", "card", [*PREV_KEYS, "months_balance"], fam.card_recent, CARD_RECENT),
    ("p12_active_credits", "bureau", [*BUREAU_KEYS, "credit_active"], fam.bureau_active, BUREAU_ACTIVE),
]:
    catalog.add(
        _name,
        lambda v, view=_view, keys=_keys, make=_make: getattr(v, view).where(make()).select(*keys),
        f"SELECT {', '.join(_keys)} FROM {_view} WHERE {_sql}",
    )
catalog.add(
    "p12_decided_applications",
    lambda v: v.prev.where(F.col("name_contract_status").isin("Approved", "Refused")).select(
        *PREV_KEYS, "name_contract_status"
    ),
    "SELECT sk_id_curr, sk_id_prev, name_contract_status FROM prev "
    "WHERE name_contract_status IN ('Approved', 'Refused')",
)
RENAME_SPEC = {"sk_dpd": ["max", "mean"], "months_balance": ["min"]}
catalog.add(
    "p13_prefixed_names",
    lambda v: grouped_features(v.pos, "sk_id_curr", RENAME_SPEC, "pos_x_").withColumnsRenamed(
        {"pos_x_sk_dpd_max": "POS_WORST_DPD"}
    ),
    "SELECT sk_id_curr, max(sk_dpd) AS \"POS_WORST_DPD\", avg(sk_dpd) AS pos_x_sk_dpd_mean, "
    "min(months_balance) AS pos_x_months_balance_min FROM pos GROUP BY sk_id_curr",
)
catalog.add(
    "p14_keep_columns",
    lambda v: v.bureau.drop(*[c for c in v.bureau.columns if c not in BUREAU_KEYS]),
    "SELECT sk_id_curr, sk_id_bureau FROM bureau",
)

# ---------------------------------------------------------------- A: aggregates
FAMILIES = {
    # name: (view, derive, spec, window, derived-table SQL, derived-table name, condition SQL)
    "a2_prev_agg": ("prev", fam.derive_prev, fam.PREV_SPEC, lambda: fam.prev_windows()[0], PREV_D, "prev_d", None),
    "a4_prev_recent_agg": (
        "prev", fam.derive_prev, fam.PREV_SPEC, lambda: fam.prev_windows()[1], PREV_D, "prev_d", PREV_RECENT,
    ),
    "a6_bureau_agg": (
        "bureau", fam.derive_bureau, fam.BUREAU_SPEC, lambda: fam.bureau_windows()[0], BUREAU_D, "bureau_d", None,
    ),
    "a7_bureau_active_agg": (
        "bureau", fam.derive_bureau, fam.BUREAU_SPEC, lambda: fam.bureau_windows()[1], BUREAU_D, "bureau_d",
        BUREAU_ACTIVE,
    ),
    "a8_bureau_recent_agg": (
        "bureau", fam.derive_bureau, fam.BUREAU_SPEC, lambda: fam.bureau_windows()[2], BUREAU_D, "bureau_d",
        BUREAU_RECENT,
    ),
}
PREFIXES = {
    "a2_prev_agg": "prev_", "a4_prev_recent_agg": "prev_d365_", "a6_bureau_agg": "bureau_",
    "a7_bureau_active_agg": "bureau_act_", "a8_bureau_recent_agg": "bureau_d750_",
}
A1_SPEC = {
    "sk_id_prev": ["count", "nunique"], "amt_payment": ["min", "max", "mean", "sum"],
    "days_entry_payment": ["mean", "std"], "num_instalment_version": ["nunique"],
}
catalog.add(
    "a1_grouped_features",
    lambda v: rounded(
        grouped_features(v.inst, "sk_id_curr", A1_SPEC, "g_"), *quotient_features(A1_SPEC, "g_")
    ),
    f"SELECT sk_id_curr, {select_list(spec_sql(A1_SPEC, 'g_'))} FROM inst GROUP BY sk_id_curr",
)
for _name, (_view, _derive, _spec, _window, _cte, _table, _cond) in FAMILIES.items():
    _prefix = PREFIXES[_name]

    def _family_job(v, view=_view, derive=_derive, spec=_spec, window=_window, prefix=_prefix):
        df = fam.single_window(getattr(v, view), spec, window(), derive)
        return rounded(df, *quotient_features(spec, prefix))

    catalog.add(
        _name, _family_job,
        f"WITH {_cte}\nSELECT sk_id_curr, {select_list(spec_sql(_spec, _prefix))}\nFROM {_table}"
        + (f" WHERE {_cond}" if _cond else "") + "\nGROUP BY sk_id_curr",
    )

A3_SQL = """SELECT sk_id_curr, count(*) FILTER (WHERE name_contract_status = 'Approved') AS prev_approved_count,
  count(*) FILTER (WHERE name_contract_status = 'Refused') AS prev_refused_count
FROM prev WHERE name_contract_status IN ('Approved', 'Refused') GROUP BY sk_id_curr"""
catalog.add("a3_status_pivot", lambda v: fam.status_counts(v.prev), A3_SQL)
STATUS_RATIOS = [
    f"CASE WHEN count(*) FILTER (WHERE name_contract_status IN ('Approved', 'Refused')) > 0 "
    f"THEN {r6(f'''count(*) FILTER (WHERE name_contract_status = '{status}') / CAST(count(*) AS DOUBLE)''')} "
    f"END AS prev_{status.lower()}_ratio"
    for status in ("Refused", "Approved")
]
catalog.add(
    "a5_status_ratios",
    lambda v: rounded(fam.status_ratios(v.prev), "prev_refused_ratio", "prev_approved_ratio"),
    f"SELECT sk_id_curr, {select_list(STATUS_RATIOS)} FROM prev GROUP BY sk_id_curr",
)
ACTIVE_RATIOS = [
    f"CASE WHEN count(*) FILTER (WHERE {BUREAU_ACTIVE}) > 0 THEN "
    + r6(f"sum({flag}) FILTER (WHERE {BUREAU_ACTIVE}) / CAST(count(*) AS DOUBLE)")
    + f" END AS {name}"
    for flag, name in (
        ("bureau_is_dpd", "bureau_act_is_dpd_ratio"), ("bureau_is_dpd_over120", "bureau_act_is_dpd_over120_ratio"),
    )
]
ACTIVE_RATIO_NAMES = ["bureau_act_is_dpd_ratio", "bureau_act_is_dpd_over120_ratio"]
catalog.add(
    "a9_active_overdue_ratios",
    lambda v: rounded(
        window_features(
            v.bureau, fam.KEY,
            {"sk_id_bureau": ["count"], "bureau_is_dpd": ["sum"], "bureau_is_dpd_over120": ["sum"]},
            fam.bureau_windows()[:2], fam.derive_bureau,
        )
        .withColumns(fam.active_overdue_ratios())
        .select(fam.KEY, *ACTIVE_RATIO_NAMES),
        *ACTIVE_RATIO_NAMES,
    ),
    f"WITH {BUREAU_D}\nSELECT sk_id_curr, {select_list(ACTIVE_RATIOS)} FROM bureau_d GROUP BY sk_id_curr",
)
A10_SQL = f"""WITH {BUREAU_BAL_D}
SELECT sk_id_curr, {select_list(spec_sql(fam.BUREAU_BAL_SPEC, 'bureau_bal_'))}
FROM bureau_bal_d JOIN (SELECT sk_id_curr, sk_id_bureau FROM bureau) USING (sk_id_bureau) GROUP BY sk_id_curr"""
catalog.add("a10_bureau_balance_agg", lambda v: fam.bureau_balance_features(v.bureau, v.bureau_bal), A10_SQL)


def window_sql(cte: str, table: str, spec, windows: list[tuple[str, str | None]], extra: list[str] = []) -> str:
    items = [item for prefix, condition in windows for item in spec_sql(spec, prefix, condition)]
    return f"WITH {cte}\nSELECT sk_id_curr, {select_list([*items, *extra])}\nFROM {table} GROUP BY sk_id_curr"


def add_windows(name: str, job, cte: str, table: str, spec, windows: list[tuple[str, str | None]]) -> None:
    unstable = [f for prefix, _ in windows for f in quotient_features(spec, prefix)]
    catalog.add(name, lambda v: rounded(job(v), *unstable), window_sql(cte, table, spec, windows))


PREV_W = [("prev_", None), ("prev_d365_", PREV_RECENT)]
BUREAU_W = [("bureau_", None), ("bureau_act_", BUREAU_ACTIVE), ("bureau_d750_", BUREAU_RECENT)]
add_windows(
    "a11_pos_agg", lambda v: fam.pos_features(v.pos), POS_D, "pos_d", fam.POS_SPEC,
    [("pos_", None), ("pos_m20_", POS_RECENT)],
)
add_windows(
    "a12_inst_agg", lambda v: fam.inst_features(v.inst), INST_D, "inst_d", fam.INST_SPEC,
    [("ins_", None), ("ins_d365_", INST_RECENT)],
)
# The routes that only tables of millions of rows take on their own.
for _name, _look in (("narrow", Look(share=1.0, min_rows=1, hot_share=1.0)), ("hot_apart", Look(share=1.0, min_rows=1, hot_share=0.003))):
    add_windows(
        f"a12_inst_agg_{_name}", lambda v, look=_look: fam.inst_features(v.inst, look), INST_D, "inst_d", fam.INST_SPEC,
        [("ins_", None), ("ins_d365_", INST_RECENT)],
    )
add_windows(
    "a13_card_agg", lambda v: fam.card_features(v.card), CARD_D, "card_d", fam.CARD_SPEC,
    [("card_", None), ("card_m3_", CARD_RECENT)],
)
add_windows(
    "a14_prev_windows_one_scan",
    lambda v: window_features(v.prev, fam.KEY, fam.PREV_SPEC, fam.prev_windows(), fam.derive_prev),
    PREV_D, "prev_d", fam.PREV_SPEC, PREV_W,
)
add_windows(
    "a14_bureau_windows_one_scan",
    lambda v: window_features(v.bureau, fam.KEY, fam.BUREAU_SPEC, fam.bureau_windows(), fam.derive_bureau),
    BUREAU_D, "bureau_d", fam.BUREAU_SPEC, BUREAU_W,
)
add_windows(
    "j3_prev_windows_joined",
    lambda v: joined_windows(v.prev, fam.KEY, fam.PREV_SPEC, fam.prev_windows(), fam.derive_prev),
    PREV_D, "prev_d", fam.PREV_SPEC, PREV_W,
)

# ---------------------------------------------------------------- A18 / J1: the star
CORE = [
    "sk_id_curr", "target", "apps_ext_source_mean", "apps_ext_source_std", "apps_annuity_credit_ratio",
    "apps_income_employed_ratio", "prev_sk_id_curr_count", "prev_amt_credit_mean", "prev_d365_sk_id_curr_count",
    "prev_d365_amt_credit_sum", "prev_refused_ratio", "prev_approved_ratio", "bureau_sk_id_bureau_count",
    "bureau_amt_credit_sum_sum", "bureau_act_sk_id_bureau_count", "bureau_d750_days_credit_mean",
    "bureau_bal_months_balance_mean", "bureau_bal_bureau_bal_is_dpd_sum", "pos_sk_dpd_sum", "pos_m20_sk_dpd_mean",
    "ins_num_instalment_version_nunique", "ins_d365_amt_payment_sum", "ins_d365_sk_dpd_max", "card_amt_balance_max",
    "card_m3_amt_drawings_current_sum",
]
CORE_ROUNDED = [
    "apps_ext_source_mean", "apps_ext_source_std", "apps_annuity_credit_ratio", "apps_income_employed_ratio",
    "prev_refused_ratio", "prev_approved_ratio",
]


def core_sql(app_table: str, keep: list[str], extra: list[str] = []) -> str:
    ctes = ",\n".join([APP_D, PREV_D, BUREAU_D, BUREAU_BAL_D, POS_D, INST_D, CARD_D])
    wanted = set(keep)

    def chosen(items: list[str]) -> list[str]:
        return [i for i in items if i.rsplit(" AS ", 1)[1] in wanted]

    def table(name: str, items: list[str], source: str) -> str:
        return f"{name} AS (SELECT sk_id_curr, {select_list(chosen(items))} FROM {source} GROUP BY sk_id_curr)"

    def windows(spec, pairs):
        return [i for prefix, cond in pairs for i in spec_sql(spec, prefix, cond)]

    groups = [
        table("f_prev", [*windows(fam.PREV_SPEC, PREV_W), *STATUS_RATIOS], "prev_d"),
        table("f_bureau", [*windows(fam.BUREAU_SPEC, BUREAU_W), *ACTIVE_RATIOS], "bureau_d"),
        table(
            "f_bal", spec_sql(fam.BUREAU_BAL_SPEC, "bureau_bal_"),
            "bureau_bal_d JOIN (SELECT sk_id_curr, sk_id_bureau FROM bureau) USING (sk_id_bureau)",
        ),
        table("f_pos", windows(fam.POS_SPEC, [("pos_", None), ("pos_m20_", POS_RECENT)]), "pos_d"),
        table("f_ins", windows(fam.INST_SPEC, [("ins_", None), ("ins_d365_", INST_RECENT)]), "inst_d"),
        table("f_card", windows(fam.CARD_SPEC, [("card_", None), ("card_m3_", CARD_RECENT)]), "card_d"),
    ]
    # Balance features hang on the bureau features, which every bureau client has.
    items = [*[r6(c) + f" AS {c}" if c.startswith("apps_") else c for c in keep], *extra]
    return (
        f"WITH {ctes},\n" + ",\n".join(groups)
        + f"\nSELECT {select_list(items)}\nFROM {app_table} LEFT JOIN f_prev USING (sk_id_curr) "
        "LEFT JOIN f_bureau USING (sk_id_curr) LEFT JOIN f_bal USING (sk_id_curr) LEFT JOIN f_pos USING (sk_id_curr) "
        "LEFT JOIN f_ins USING (sk_id_curr) LEFT JOIN f_card USING (sk_id_curr)"
    )


def loan_tables(v) -> dict:
    return {name: getattr(v, name) for name in ("app", "prev", "bureau", "bureau_bal", "pos", "inst", "card")}


APP_COLUMNS = (
    "sk_id_curr target ext_source_1 ext_source_2 ext_source_3 amt_income_total amt_credit amt_annuity "
    "amt_goods_price cnt_fam_members own_car_age days_birth days_employed region"
).split()
FAMILY_PREFIXES = [
    (fam.PREV_SPEC, ["prev_", "prev_d365_"]), (fam.BUREAU_SPEC, ["bureau_", "bureau_act_", "bureau_d750_"]),
    (fam.BUREAU_BAL_SPEC, ["bureau_bal_"]), (fam.POS_SPEC, ["pos_", "pos_m20_"]),
    (fam.INST_SPEC, ["ins_", "ins_d365_"]), (fam.CARD_SPEC, ["card_", "card_m3_"]),
]
DERIVED = ["apps_ext_source_mean", "apps_ext_source_std", *APP_RATIOS]
RATIOS = ["prev_refused_ratio", "prev_approved_ratio"]
FULL = [
    *APP_COLUMNS, *DERIVED, *[n for s, ps in FAMILY_PREFIXES for p in ps for n in feature_names(s, p)],
    *RATIOS, *ACTIVE_RATIO_NAMES,
]
FULL_ROUNDED = [
    *DERIVED, *[n for s, ps in FAMILY_PREFIXES for p in ps for n in quotient_features(s, p)], *RATIOS, *ACTIVE_RATIO_NAMES,
]


def stored_table(v):
    """The feature table from families that are stored by applicant first."""
    folder = fresh_path(v.spark, "families")
    fam.store_features(loan_tables(v), folder)
    return fam.stored_feature_table(v.spark, folder)


def full_table(v, features=None):
    """Every feature, with the text column as codes."""
    features = fam.feature_table(loan_tables(v)) if features is None else features
    return prepare.factorise(v.app, ["name_income_type"]).apply(features)


catalog.add(
    "a18_feature_table_full",
    lambda v: rounded(full_table(v), *FULL_ROUNDED),
    core_sql("app_d", FULL, ["CAST(dense_rank() OVER (ORDER BY name_income_type) - 1 AS INTEGER) AS name_income_type"]),
)
catalog.add(
    "a18_feature_table_core",
    lambda v: rounded(fam.feature_table(loan_tables(v)).select(*CORE), *CORE_ROUNDED),
    core_sql("app_d", CORE),
)
catalog.add(
    "a18_stored_table_full",
    lambda v: rounded(full_table(v, stored_table(v)), *FULL_ROUNDED),
    core_sql("app_d", FULL, ["CAST(dense_rank() OVER (ORDER BY name_income_type) - 1 AS INTEGER) AS name_income_type"]),
)
catalog.add(
    "a18_stored_table_core",
    lambda v: rounded(stored_table(v).select(*CORE), *CORE_ROUNDED),
    core_sql("app_d", CORE),
)


def star_families(v) -> dict:
    return {
        "app": v.app.select("sk_id_curr", "target"),
        "prev": grouped_features(v.prev, "sk_id_curr", {"amt_credit": ["sum"]}, "prev_"),
        "bureau": grouped_features(v.bureau, "sk_id_curr", {"sk_id_bureau": ["count"]}, "bureau_"),
        "pos": grouped_features(v.pos, "sk_id_curr", {"sk_dpd": ["max"]}, "pos_"),
        "inst": grouped_features(v.inst, "sk_id_curr", {"amt_payment": ["sum"]}, "ins_"),
        "card": grouped_features(v.card, "sk_id_curr", {"amt_balance": ["max"]}, "card_"),
    }


def star_join(v):
    app, *features = star_families(v).values()
    return fam.assemble(app, features)


def refreshed_star(v):
    """The stored star, one family of which is computed again alone after its table has changed."""
    folder, star = fresh_path(v.spark, "star"), star_families(v)
    half = grouped_features(v.card.where("sk_id_prev % 2 = 0"), "sk_id_curr", {"amt_balance": ["max"]}, "card_")
    layout.store_families({**star, "card": half}, folder, "sk_id_curr", 12)
    layout.store_family(star["card"], folder, "card", "sk_id_curr")
    return layout.merged(v.spark, folder, "app", "sk_id_curr")


STAR = (
    """SELECT sk_id_curr, target, prev_amt_credit_sum, bureau_sk_id_bureau_count, pos_sk_dpd_max, ins_amt_payment_sum,
  card_amt_balance_max
FROM app
LEFT JOIN (SELECT sk_id_curr, coalesce(sum(amt_credit), 0) AS prev_amt_credit_sum FROM prev GROUP BY 1) a
  USING (sk_id_curr)
LEFT JOIN (SELECT sk_id_curr, count(sk_id_bureau) AS bureau_sk_id_bureau_count FROM bureau GROUP BY 1) b
  USING (sk_id_curr)
LEFT JOIN (SELECT sk_id_curr, max(sk_dpd) AS pos_sk_dpd_max FROM pos GROUP BY 1) c USING (sk_id_curr)
LEFT JOIN (SELECT sk_id_curr, coalesce(sum(amt_payment), 0) AS ins_amt_payment_sum FROM inst GROUP BY 1) d
  USING (sk_id_curr)
LEFT JOIN (SELECT sk_id_curr, max(amt_balance) AS card_amt_balance_max FROM card GROUP BY 1) e USING (sk_id_curr)"""
)
catalog.add("j1_star_join", star_join, STAR)
catalog.add("j1_stored_star_join", refreshed_star, STAR)
