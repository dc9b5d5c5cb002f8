"""Queries: key joins, set operations, exploratory statistics, reports, table preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.base import Catalog, quotient_features, r6, rounded, select_list, spec_sql
from creditloom.functions import columns as C
from creditloom.operators import joins as J
from creditloom.operators import ordered as O
from creditloom.operators.grouped import grouped_features
from creditloom.plans import explore as X
from creditloom.plans import prepare as P
from creditloom.plans import profile as R

catalog = Catalog()
VIEWS = ("app", "prev", "bureau", "bureau_bal", "pos", "inst", "card")

# Column names and types of the views, as the checks need them spelled out.
NUM = {
    "app": "sk_id_curr target ext_source_1 ext_source_2 ext_source_3 amt_income_total amt_credit amt_annuity "
    "amt_goods_price cnt_fam_members own_car_age days_birth days_employed region".split(),
    "prev": "sk_id_curr sk_id_prev days_decision amt_application amt_credit amt_annuity amt_down_payment "
    "rate_down_payment amt_goods_price cnt_payment days_last_due days_last_due_1st_version".split(),
    "inst": "sk_id_curr sk_id_prev num_instalment_number num_instalment_version days_instalment days_entry_payment "
    "amt_instalment amt_payment".split(),
}
ALL_COLUMNS = {
    "app": [*NUM["app"], "name_income_type"],
    "prev": [*NUM["prev"], "name_contract_status"],
    "inst": NUM["inst"],
    "bureau": "sk_id_curr sk_id_bureau credit_active days_credit credit_day_overdue days_credit_enddate "
    "days_enddate_fact amt_credit_max_overdue amt_credit_sum amt_credit_sum_debt amt_credit_sum_overdue "
    "amt_annuity".split(),
    "bureau_bal": "sk_id_bureau months_balance status".split(),
    "pos": "sk_id_curr sk_id_prev months_balance sk_dpd cnt_instalment cnt_instalment_future".split(),
    "card": "sk_id_curr sk_id_prev months_balance amt_balance amt_credit_limit_actual amt_drawings_current "
    "amt_drawings_atm_current amt_drawings_pos_current amt_inst_min_regularity amt_payment_total_current "
    "amt_total_receivable cnt_drawings_atm_current cnt_drawings_current cnt_drawings_pos_current sk_dpd".split(),
}

# ---------------------------------------------------------------- J2, J4, J5, U
catalog.add(
    "j2_parent_lookup",
    lambda v: J.lookup_join(v.bureau_bal, v.bureau.select("sk_id_curr", "sk_id_bureau"), "sk_id_bureau"),
    "SELECT sk_id_bureau, months_balance, status, sk_id_curr FROM bureau_bal "
    "JOIN (SELECT sk_id_curr, sk_id_bureau FROM bureau) USING (sk_id_bureau)",
)
catalog.add(
    "j4_target_left",
    lambda v: v.app.select("sk_id_curr", "target").join(X.bureau_stats(v.bureau).select(
        "sk_id_curr", "amt_credit_sum_sum", "sk_id_bureau_count"), "sk_id_curr", "left"),
    """SELECT sk_id_curr, target, amt_credit_sum_sum, sk_id_bureau_count FROM app LEFT JOIN
(SELECT sk_id_curr, coalesce(sum(amt_credit_sum), 0) AS amt_credit_sum_sum, count(sk_id_bureau) AS sk_id_bureau_count
 FROM bureau GROUP BY 1) USING (sk_id_curr)""",
)
catalog.add(
    "j4_target_inner",
    lambda v: rounded(
        X.payment_stats(v.inst).join(v.app.select("sk_id_curr", "target"), "sk_id_curr", "inner").select(
            "sk_id_curr", "target", "days_late_mean", "payment_ratio_mean"), "payment_ratio_mean"),
    f"""SELECT sk_id_curr, target, days_late_mean, payment_ratio_mean FROM app JOIN
(SELECT sk_id_curr, avg(days_entry_payment - days_instalment) AS days_late_mean,
  {r6('avg(amt_payment / nullif(amt_instalment, 0))')} AS payment_ratio_mean
 FROM inst GROUP BY 1) USING (sk_id_curr)""",
)
catalog.add(
    "j5_keys_in_both",
    lambda v: J.shared_keys(v.app, v.pos, "sk_id_curr"),
    "SELECT DISTINCT sk_id_curr FROM app WHERE sk_id_curr IN (SELECT sk_id_curr FROM pos)",
)
catalog.add(
    "j5_keys_in_one",
    lambda v: J.keys_only_in(v.app, v.pos, "sk_id_curr"),
    "SELECT DISTINCT sk_id_curr FROM app WHERE sk_id_curr NOT IN (SELECT sk_id_curr FROM pos)",
)
catalog.add(
    "u1_key_intersection",
    lambda v: J.key_intersection(v.app, v.card, "sk_id_curr").agg(F.count(F.lit(1)).alias("n")),
    "SELECT count(*) AS n FROM (SELECT sk_id_curr FROM app INTERSECT SELECT sk_id_curr FROM card)",
)
catalog.add(
    "u2_append",
    lambda v: P.down_sample(v.app, "target", "sk_id_curr", 0.25).select("sk_id_curr", "target").unionByName(
        v.scores.where(F.col("score") > 0.9).select("target", "sk_id_curr")),
    "SELECT sk_id_curr, target FROM app WHERE target = 1 OR "
    "('0x' || substr(md5(sk_id_curr || ':down42'), 1, 8))::BIGINT < 1073741824 "
    "UNION ALL SELECT sk_id_curr, target FROM scores WHERE score > 0.9",
)
catalog.add(
    "u3_key_difference",
    lambda v: J.key_difference(v.bureau_bal, v.bureau, "sk_id_bureau"),
    "SELECT sk_id_bureau FROM bureau_bal EXCEPT SELECT sk_id_bureau FROM bureau",
)

# ---------------------------------------------------------------- A15 - A17
for _name, _view, _spec, _job in [
    ("a15_bureau_stats", "bureau", X.BUREAU_STATS, lambda v: X.bureau_stats(v.bureau)),
    ("a15_instalment_stats", "inst", X.INSTALMENT_STATS, lambda v: X.instalment_stats(v.inst)),
    ("a15_previous_stats", "prev", X.PREVIOUS_STATS, lambda v: X.previous_stats(v.prev)),
]:
    catalog.add(
        _name,
        lambda v, job=_job, spec=_spec: rounded(job(v), *quotient_features(spec, "")),
        f"SELECT sk_id_curr, {select_list(spec_sql(_spec, ''))} FROM {_view} GROUP BY sk_id_curr",
    )
catalog.add(
    "a15_payment_stats",
    lambda v: rounded(X.payment_stats(v.inst), *quotient_features(X.PAYMENT_STATS, "")),
    f"""WITH d AS (SELECT sk_id_curr, amt_payment - amt_instalment AS payment_diff,
  amt_payment / nullif(amt_instalment, 0) AS payment_ratio, days_entry_payment - days_instalment AS days_late FROM inst)
SELECT sk_id_curr, {select_list(spec_sql(X.PAYMENT_STATS, ''))} FROM d GROUP BY sk_id_curr""",
)
catalog.add(
    "a16_approval_rate",
    lambda v: rounded(X.approval_rate(v.prev), "approval_rate"),
    f"SELECT sk_id_curr, {r6('''avg(CASE WHEN name_contract_status = 'Approved' THEN 1 ELSE 0 END)''')} "
    "AS approval_rate FROM prev GROUP BY sk_id_curr",
)
catalog.add(
    "a17_global_aggregates",
    lambda v: v.inst.agg(
        F.count(F.lit(1)).alias("n"), F.avg("amt_instalment").alias("mean_amount"),
        F.min("days_instalment").alias("first_day"), F.max("days_instalment").alias("last_day"),
        F.sum("amt_payment").alias("paid"),
    ),
    "SELECT count(*) AS n, avg(amt_instalment) AS mean_amount, min(days_instalment) AS first_day, "
    "max(days_instalment) AS last_day, sum(amt_payment) AS paid FROM inst",
)

# ---------------------------------------------------------------- G: reports
TYPE_NAMES = "CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"


def _union(frames):
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


catalog.add(
    "g1_shape_and_types",
    lambda v: _union([R.shape_report(getattr(v, name), name) for name in VIEWS]),
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, {len(ALL_COLUMNS[t])} AS n_columns, "
        f"'{c}' AS column_name, {TYPE_NAMES.format(t=f'(SELECT typeof(any_value({c})) FROM {t})')} AS kind"
        for t in VIEWS for c in ALL_COLUMNS[t]
    ),
)


def missing_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 2) AS missing_percent FROM {table}"
        for c in ALL_COLUMNS[table]
    )


for _view in VIEWS:
    catalog.add(
        f"g2_missing_{_view}", lambda v, view=_view: R.missing_report(getattr(v, view)), missing_sql(_view)
    )


def describe_sql(table: str) -> str:
    parts = []
    for c in NUM[table]:
        x = f"CAST({c} AS DOUBLE)"
        q = [r6(f"quantile_cont({x}, {p})") + f" AS {n}" for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
            f"min({x}) AS min, max({x}) AS max, {', '.join(q)} FROM {table}"
        )
    return "\nUNION ALL ".join(parts)


for _view in NUM:
    catalog.add(
        f"g3_describe_{_view}",
        lambda v, view=_view: rounded(
            R.describe(getattr(v, view), R.numeric_columns(getattr(v, view))), "mean", "std", "q25", "q50", "q75"
        ),
        describe_sql(_view),
    )
PATTERN = ["ext_source_1", "ext_source_2", "ext_source_3", "cnt_fam_members", "own_car_age"]
catalog.add(
    "g4_missing_patterns",
    lambda v: R.missing_patterns(v.app, PATTERN),
    "SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PATTERN)
    + " AS pattern, count(*) AS n FROM app GROUP BY 1",
)
catalog.add(
    "g5_label_distribution",
    lambda v: rounded(R.label_distribution(v.app, "target"), "percent"),
    f"SELECT target, count(*) AS n, {r6('count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM app)')} AS percent "
    "FROM app GROUP BY target",
)


def integrity_sql(children) -> str:
    shared = "(SELECT count(DISTINCT sk_id_curr) FROM app WHERE sk_id_curr IN (SELECT sk_id_curr FROM {t}))"
    total = "(SELECT count(DISTINCT sk_id_curr) FROM app)"
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(DISTINCT sk_id_curr) FROM {t}) AS distinct_keys, "
        f"{shared.format(t=t)} AS shared, {r6(f'{shared.format(t=t)} * CAST(100 AS DOUBLE) / {total}')} AS shared_percent, "
        f"{total} - {shared.format(t=t)} AS parents_without_rows, (SELECT count(DISTINCT sk_id_curr) FROM {t} "
        "WHERE sk_id_curr NOT IN (SELECT sk_id_curr FROM app)) AS orphan_keys" for t in children
    )


CHILDREN = ("prev", "bureau", "pos", "inst", "card")
catalog.add(
    "g6_key_integrity",
    lambda v: rounded(
        R.integrity_report(v.app, {name: getattr(v, name) for name in CHILDREN}, "sk_id_curr"), "shared_percent"
    ),
    integrity_sql(CHILDREN),
)
catalog.add(
    "g6_balance_orphans",
    lambda v: rounded(R.integrity_report(v.bureau, {"bureau_bal": v.bureau_bal}, "sk_id_bureau"), "shared_percent"),
    f"""WITH p AS (SELECT DISTINCT sk_id_bureau FROM bureau), c AS (SELECT DISTINCT sk_id_bureau FROM bureau_bal)
SELECT 'bureau_bal' AS table_name, (SELECT count(*) FROM c) AS distinct_keys,
  (SELECT count(*) FROM p SEMI JOIN c USING (sk_id_bureau)) AS shared,
  {r6('(SELECT count(*) FROM p SEMI JOIN c USING (sk_id_bureau)) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM p)')}
    AS shared_percent,
  (SELECT count(*) FROM p ANTI JOIN c USING (sk_id_bureau)) AS parents_without_rows,
  (SELECT count(*) FROM c ANTI JOIN p USING (sk_id_bureau)) AS orphan_keys""",
)


def pearson_sql(c: str, label: str = "target") -> str:
    both = f"FILTER (WHERE {c} IS NOT NULL AND {label} IS NOT NULL)"
    return r6(
        f"covar_pop({c}, {label}) / nullif(stddev_pop({c}) {both} * stddev_pop({label}) {both}, 0)"
    )


CORR = [c for c in NUM["app"] if c != "target"]
CORR_SQL = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, {pearson_sql(c)} AS correlation FROM app" for c in CORR)
catalog.add(
    "g7_label_correlations", lambda v: rounded(R.label_correlations(v.app, "target"), "correlation"), CORR_SQL
)
catalog.add(
    "w5_extreme_correlations",
    lambda v: R.extreme_correlations(rounded(R.label_correlations(v.app, "target"), "correlation"), 5),
    f"""WITH c AS ({CORR_SQL})
(SELECT *, 'top' AS side FROM c ORDER BY correlation DESC, column_name LIMIT 5)
UNION ALL (SELECT *, 'bottom' AS side FROM c ORDER BY correlation, column_name LIMIT 5)""",
)
catalog.add(
    "w5_bureau_correlations",
    lambda v: R.extreme_correlations(
        rounded(
            R.label_correlations(
                v.app.select("sk_id_curr", "target").join(X.bureau_stats(v.bureau), "sk_id_curr", "left"), "target",
                [f"{c}_{f}" for c, fns in X.BUREAU_STATS.items() for f in fns],
            ),
            "correlation",
        ),
        10,
    ),
    "WITH b AS (SELECT sk_id_curr, " + select_list(spec_sql(X.BUREAU_STATS, "")) + " FROM bureau GROUP BY sk_id_curr), "
    "j AS (SELECT * FROM (SELECT sk_id_curr, target FROM app) LEFT JOIN b USING (sk_id_curr)), c AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{c}_{f}' AS column_name, {pearson_sql(f'{c}_{f}')} AS correlation FROM j"
        for c, fns in X.BUREAU_STATS.items() for f in fns
    )
    + ")\n(SELECT *, 'top' AS side FROM c WHERE correlation IS NOT NULL ORDER BY correlation DESC, column_name LIMIT 10)\n"
    "UNION ALL (SELECT *, 'bottom' AS side FROM c WHERE correlation IS NOT NULL ORDER BY correlation, column_name LIMIT 10)",
)
HIST = ["days_birth", "days_employed", "amt_income_total", "amt_credit", "amt_annuity"]
catalog.add(
    "g8_label_histogram",
    lambda v: R.label_histogram(v.app, "target", HIST, 20),
    "\nUNION ALL ".join(
        f"SELECT target, '{c}' AS column_name, least(CAST(floor((CAST({c} AS DOUBLE) - lo) * 20 / nullif(hi - lo, 0)) "
        f"AS BIGINT), 19) AS bin, count(*) AS n FROM app, (SELECT CAST(min({c}) AS DOUBLE) AS lo, "
        f"CAST(max({c}) AS DOUBLE) AS hi FROM app) GROUP BY 1, 2, 3" for c in HIST
    ),
)
catalog.add(
    "g8_payment_ratio_histogram",
    lambda v: R.label_histogram(
        rounded(X.payment_stats(v.inst).join(v.app.select("sk_id_curr", "target"), "sk_id_curr"), "payment_ratio_mean"),
        "target", ["payment_ratio_mean"], 20,
    ),
    f"""WITH d AS (SELECT target, x FROM app JOIN (SELECT sk_id_curr,
  {r6('avg(amt_payment / nullif(amt_instalment, 0))')} AS x FROM inst GROUP BY 1) USING (sk_id_curr)),
l AS (SELECT min(x) AS lo, max(x) AS hi FROM d)
SELECT target, 'payment_ratio_mean' AS column_name,
  least(CAST(floor((x - lo) * 20 / nullif(hi - lo, 0)) AS BIGINT), 19) AS bin, count(*) AS n
FROM d, l WHERE x IS NOT NULL GROUP BY 1, 2, 3""",
)


def box_sql(source: str, column: str) -> str:
    return f"""WITH d AS ({source}), b AS (SELECT target, quantile_cont(x, 0.0) AS low, quantile_cont(x, 0.25) AS q25,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 1.0) AS high FROM d GROUP BY target)
SELECT target, {', '.join(r6(c) + f' AS {c}' for c in ('low', 'q25', 'median', 'q75', 'high'))},
  {r6('q25 - 1.5 * (q75 - q25)')} AS lower_fence, {r6('q75 + 1.5 * (q75 - q25)')} AS upper_fence,
  (SELECT count(*) FROM d WHERE d.target = b.target AND (x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25)))
    AS outliers FROM b"""


BOX = ("low", "q25", "median", "q75", "high", "lower_fence", "upper_fence")
catalog.add(
    "g9_days_late_box",
    lambda v: rounded(
        R.label_box(
            X.payment_stats(v.inst).join(v.app.select("sk_id_curr", "target"), "sk_id_curr").withColumn(
                "days_late_mean", F.round("days_late_mean", 6)), "target", "days_late_mean"), *BOX),
    box_sql("SELECT target, x FROM app JOIN (SELECT sk_id_curr, round(avg(days_entry_payment - days_instalment), 6) AS x "
            "FROM inst GROUP BY 1) USING (sk_id_curr) WHERE x IS NOT NULL", "x"),
)
catalog.add(
    "g9_approval_rate_box",
    lambda v: rounded(
        R.label_box(
            v.app.select("sk_id_curr", "target").join(
                rounded(X.approval_rate(v.prev), "approval_rate"), "sk_id_curr", "left"), "target", "approval_rate"),
        *BOX),
    box_sql("SELECT target, x FROM app LEFT JOIN (SELECT sk_id_curr, round(avg(CASE WHEN name_contract_status = 'Approved' "
            "THEN 1 ELSE 0 END), 6) AS x FROM prev GROUP BY 1) USING (sk_id_curr) WHERE x IS NOT NULL", "x"),
)


def ranges_sql(table: str, columns) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, "
        f"count(*) - count({c}) AS missing FROM {table}" for c in columns
    )


catalog.add("g10_time_ranges_app", lambda v: R.time_ranges(v.app), ranges_sql("app", ["days_birth", "days_employed"]))
catalog.add(
    "g10_time_ranges_inst", lambda v: R.time_ranges(v.inst),
    ranges_sql("inst", ["days_instalment", "days_entry_payment"]),
)

# ---------------------------------------------------------------- W6, W7
catalog.add(
    "w6_top_values",
    lambda v: R.top_values(v.prev, R.text_columns(v.prev)).unionByName(R.top_values(v.app, R.text_columns(v.app))),
    "\nUNION ALL ".join(
        f"(SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY n DESC, value LIMIT 10)" for t, c in (("prev", "name_contract_status"), ("app", "name_income_type"))
    ),
)
catalog.add(
    "w7_head", lambda v: v.app.orderBy("sk_id_curr").limit(5).select("sk_id_curr", "target", "amt_credit"),
    "SELECT sk_id_curr, target, amt_credit FROM app ORDER BY sk_id_curr LIMIT 5",
)
catalog.add(
    "w7_node_sample",
    lambda v: X.key_sample(v.app, "sk_id_curr", 500, 42).select("sk_id_curr", "target"),
    "SELECT sk_id_curr, target FROM app ORDER BY ('0x' || substr(md5(sk_id_curr || ':42'), 1, 8))::BIGINT, sk_id_curr "
    "LIMIT 500",
)

# ---------------------------------------------------------------- T, P15, P16
PREP = ["sk_id_curr", "target", "ext_source_1", "ext_source_2", "amt_credit", "amt_annuity", "cnt_fam_members",
        "own_car_age", "days_birth", "days_employed", "name_income_type", "region"]
catalog.add(
    "p15_select_columns",
    lambda v: v.app.select(
        "sk_id_curr", *R.columns_by(v.app, ["amt_", "DAYS_"]), *R.columns_by(v.app, kinds=["string"])
    ),
    "SELECT sk_id_curr, amt_income_total, amt_credit, amt_annuity, amt_goods_price, days_birth, days_employed, "
    "name_income_type FROM app",
)
catalog.add(
    "p16_fill_zero",
    lambda v: P.fill_zero(v.app.select("sk_id_curr", *PATTERN), PATTERN),
    f"SELECT sk_id_curr, {', '.join(f'coalesce({c}, 0) AS {c}' for c in PATTERN)} FROM app",
)


def roles_sql(table: str, columns) -> str:
    rows = []
    for c in columns:
        forced = P.forced_numeric(c)
        role = "'numeric'" if forced else (
            f"CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 50 "
            "THEN 'numeric' ELSE 'categorical' END"
        )
        rows.append(f"SELECT '{c}' AS column_name, {role} AS role FROM {table} {'LIMIT 1' if forced else ''}")
    return "\nUNION ALL ".join(f"({row})" for row in rows)


ROLE_COLUMNS = [c for c in ALL_COLUMNS["app"] if c not in ("sk_id_curr", "target")]
catalog.add("t1_column_roles", lambda v: P.choose_roles(v.app).report(v.app), roles_sql("app", ROLE_COLUMNS))
catalog.add(
    "t2_factorise_app",
    lambda v: P.factorise(v.app, ["name_income_type"]).apply(v.app.select("sk_id_curr", "name_income_type")),
    "SELECT sk_id_curr, CAST(dense_rank() OVER (ORDER BY name_income_type) - 1 AS INTEGER) AS name_income_type FROM app",
)
def _decided(v):
    status = F.col("name_contract_status")
    return v.prev.select("sk_id_prev", status, F.when(status != "Canceled", status).alias("decided"))


catalog.add(
    "t2_factorise_with_nulls",
    lambda v: P.factorise(_decided(v), ["name_contract_status", "decided"]).apply(_decided(v)),
    """WITH d AS (SELECT sk_id_prev, name_contract_status,
  CASE WHEN name_contract_status <> 'Canceled' THEN name_contract_status END AS decided FROM prev)
SELECT sk_id_prev, CAST(dense_rank() OVER (ORDER BY name_contract_status) - 1 AS INTEGER) AS name_contract_status,
  CAST(CASE decided WHEN 'Approved' THEN 0 WHEN 'Refused' THEN 1 ELSE -1 END AS INTEGER) AS decided FROM d""",
)
SCALE = ["ext_source_1", "amt_credit", "amt_annuity", "own_car_age", "days_birth"]
SPLIT_HASH = "('0x' || substr(md5(sk_id_curr || ':split42'), 1, 8))::BIGINT"


def scaled(v):
    train, _ = P.split(v.app, "sk_id_curr")
    return P.fit_minmax(train, SCALE).apply(v.app).select("sk_id_curr", *SCALE)


catalog.add(
    "t3_minmax_scale",
    lambda v: rounded(scaled(v), *SCALE),
    "WITH l AS (SELECT "
    + ", ".join(f"min(coalesce({c}, 0)) AS {c}_lo, max(coalesce({c}, 0)) AS {c}_hi" for c in SCALE)
    + f" FROM app WHERE {SPLIT_HASH} >= 429496729) SELECT sk_id_curr, "
    + ", ".join(
        r6(f"coalesce((CAST(coalesce({c}, 0) AS DOUBLE) - {c}_lo) / nullif(CAST({c}_hi - {c}_lo AS DOUBLE), 0), 0)") + f" AS {c}"
        for c in SCALE
    )
    + " FROM app, l",
)
ENCODE = ["cnt_fam_members", "name_income_type", "region"]


def encoded(v):
    return P.offset_codes(v.app, ENCODE).apply(v.app.select("sk_id_curr", *ENCODE))


def offset_sql() -> str:
    ctes, offset = [], "0"
    for i, c in enumerate(ENCODE):
        ctes.append(
            f"b{i} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c} NULLS LAST) - 1 AS r "
            f"FROM (SELECT DISTINCT {c} FROM app))"
        )
    items, joins = [], []
    for i, c in enumerate(ENCODE):
        items.append(f"CAST(b{i}.r + {offset} AS INTEGER) AS {c}")
        joins.append(f"JOIN b{i} ON app.{c} IS NOT DISTINCT FROM b{i}.x")
        offset += f" + (SELECT count(*) FROM b{i})"
    return f"WITH {', '.join(ctes)} SELECT sk_id_curr, {', '.join(items)} FROM app {' '.join(joins)}"


catalog.add("t4_offset_codes", encoded, offset_sql())
CLUSTER = ["ext_source_2", "amt_credit", "cnt_fam_members", "own_car_age", "days_employed", "region", "amt_goods_price"]
catalog.add(
    "t5_cluster_columns",
    lambda v: rounded(P.cluster_column_report(P.fill_zero(v.app, CLUSTER), CLUSTER), "zero_ratio"),
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6(f'count(*) FILTER (WHERE coalesce({c}, 0) = 0) / CAST(count(*) AS DOUBLE)')} "
        f"AS zero_ratio, count(*) FILTER (WHERE coalesce({c}, 0) = 0) / CAST(count(*) AS DOUBLE) < 0.3 "
        f"AND count(DISTINCT coalesce({c}, 0)) < 20 AS selected FROM app" for c in CLUSTER
    ),
)
catalog.add(
    "t9_up_sample",
    lambda v: P.up_sample(v.app.select("sk_id_curr", "target"), "target", "sk_id_curr", 3.0),
)
catalog.add(
    "t9_draws_per_key",
    lambda v: P.up_sample(v.app.select("sk_id_curr", "target"), "target", "sk_id_curr", 3.0).groupBy("sk_id_curr").agg(
        F.count(F.lit(1)).alias("draws")),
    """WITH t AS (SELECT sk_id_curr, target, ('0x' || substr(md5(sk_id_curr || ':up42/u0__'), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) AS u,
  (SELECT count(*) / sum(CASE WHEN target = 1 THEN CAST(3 AS DOUBLE) ELSE 1 END) FROM app) AS scale FROM app),
r AS (SELECT *, CASE WHEN target = 1 THEN 3 * scale ELSE scale END AS rate FROM t),
d AS (SELECT sk_id_curr, CAST(len(list_filter(range(0, 28), lambda k:
  u >= list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate) * pow(rate, i) / gamma(i + 1))))) AS BIGINT) AS draws FROM r)
SELECT * FROM d WHERE draws > 0""",
)
catalog.add(
    "t10_down_sample",
    lambda v: P.down_sample(v.app, "target", "sk_id_curr", 0.3).select("sk_id_curr", "target"),
    "SELECT sk_id_curr, target FROM app WHERE target = 1 OR "
    "('0x' || substr(md5(sk_id_curr || ':down42'), 1, 8))::BIGINT < 1288490188",
)


def split_report(v):
    train, valid = P.split(v.app, "sk_id_curr")
    return train.select("sk_id_curr", F.lit("train").alias("part")).unionByName(
        valid.select("sk_id_curr", F.lit("valid").alias("part"))
    )


catalog.add(
    "t11_split", split_report,
    f"SELECT sk_id_curr, CASE WHEN {SPLIT_HASH} < 429496729 THEN 'valid' ELSE 'train' END AS part FROM app",
)
