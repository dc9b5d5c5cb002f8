"""Loan-table views over the TPC-H style test tables.

One text per view serves Spark and the SQL check; only the day difference and the JSON lookup are
spelled differently. Amounts are small dyadic rationals, so sums and means are exact in any order.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _days(dialect: str, ts: str) -> str:
    if dialect == "spark":
        return f"CAST(datediff(CAST({ts} AS DATE), DATE '2001-08-01') AS BIGINT)"
    return f"datediff('day', DATE '2001-08-01', CAST({ts} AS DATE))"


def _prop_k(dialect: str) -> str:
    return "get_json_object(props, '$.k')" if dialect == "spark" else "json_extract_string(props, '$.k')"


def _attributions(dialect: str) -> str:
    if dialect == "spark":
        return """
SELECT vec_id AS sk_id, concat('f', lpad(CAST(pos AS STRING), 2, '0')) AS feature, CAST(x AS DOUBLE) AS value,
  CAST(vec_id % 3 AS INT) AS risk
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x"""
    return """
SELECT vec_id AS sk_id, 'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value,
  CAST(vec_id % 3 AS INTEGER) AS risk
FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""


def view_sql(dialect: str) -> dict[str, str]:
    """View name -> SELECT text in the given dialect (``spark`` or ``duckdb``)."""
    order_day, ship_day, prop_k = _days(dialect, "o_orderdate"), _days(dialect, "l_shipdate"), _prop_k(dialect)
    moved = "CAST(x + CAST(0.0625 AS FLOAT) AS FLOAT)"  # a power of two, so the sum is the same everywhere
    if dialect == "spark":
        nudged = f"transform(embedding, (x, i) -> CASE WHEN i < 4 THEN {moved} ELSE x END)"
        zeroed = "transform(embedding, x -> CAST(0 AS FLOAT))"
    else:
        nudged = f"list_transform(embedding, lambda x, i: CASE WHEN i <= 4 THEN {moved} ELSE x END)"
        zeroed = "list_transform(embedding, lambda x: CAST(0 AS FLOAT))"
    return {
        "app": """
SELECT c_custkey AS sk_id_curr, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target,
  CAST(NULLIF(c_custkey % 7, 0) AS DOUBLE) / 10 AS ext_source_1,
  CAST(CASE WHEN c_custkey % 35 = 0 THEN NULL ELSE c_custkey % 11 END AS DOUBLE) / 11 AS ext_source_2,
  CAST(NULLIF(c_custkey % 5, 0) AS DOUBLE) / 5 AS ext_source_3,
  CAST(floor(abs(c_acctbal)) AS DOUBLE) + 1000 AS amt_income_total,
  CAST(c_custkey % 9 AS DOUBLE) * 1000 AS amt_credit,
  CAST(1 + c_custkey % 40 AS DOUBLE) * 25 AS amt_annuity,
  CAST(c_custkey % 8 AS DOUBLE) * 950 AS amt_goods_price,
  CAST(NULLIF(c_custkey % 6, 0) AS DOUBLE) AS cnt_fam_members,
  CAST(NULLIF(c_custkey % 3, 0) AS DOUBLE) * 4 AS own_car_age,
  -7000 - (c_custkey % 18000) AS days_birth,
  CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE -(c_custkey % 5000) END AS days_employed,
  c_mktsegment AS name_income_type, c_nationkey AS region
FROM customer""",
        "prev": f"""
SELECT o_custkey AS sk_id_curr, o_orderkey AS sk_id_prev, {order_day} AS days_decision,
  CAST(floor(o_totalprice) AS DOUBLE) AS amt_application,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       ELSE CAST(floor(o_totalprice) AS DOUBLE) * CAST(13 + o_orderkey % 8 AS DOUBLE) / 16 END AS amt_credit,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(floor(o_totalprice) AS DOUBLE) / 8 END AS amt_annuity,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) / 8 END AS amt_down_payment,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 16 END AS rate_down_payment,
  CAST(floor(o_totalprice) AS DOUBLE) * CAST(14 + o_orderkey % 5 AS DOUBLE) / 16 AS amt_goods_price,
  CAST((CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) * 6 AS DOUBLE) AS cnt_payment,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Refused' ELSE 'Canceled' END
    AS name_contract_status,
  CASE WHEN o_orderkey % 10 = 0 THEN 365243 ELSE {order_day} + 180 END AS days_last_due,
  CASE WHEN o_orderkey % 14 = 0 THEN 365243 ELSE {order_day} + 210 + CAST(o_orderkey % 30 AS INT) END
    AS days_last_due_1st_version
FROM orders""",
        "bureau": f"""
SELECT o_custkey AS sk_id_curr, o_orderkey AS sk_id_bureau,
  CASE o_orderstatus WHEN 'O' THEN 'Active' ELSE 'Closed' END AS credit_active,
  {order_day} AS days_credit,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 200 ELSE 0 END AS credit_day_overdue,
  {order_day} + 365 AS days_credit_enddate,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {order_day} + 300 + o_orderkey % 90 END AS days_enddate_fact,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
       ELSE CAST(floor(o_totalprice) AS DOUBLE) / 64 END AS amt_credit_max_overdue,
  CASE WHEN o_orderkey % 31 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS amt_credit_sum,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
       ELSE CAST(floor(o_totalprice) AS DOUBLE) * CAST(o_orderkey % 11 AS DOUBLE) / 8 END AS amt_credit_sum_debt,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE) / 128
       ELSE CAST(0 AS DOUBLE) END AS amt_credit_sum_overdue,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) / 32 END AS amt_annuity
FROM orders WHERE o_orderkey % 29 <> 0""",
        "bureau_bal": """
SELECT l_orderkey AS sk_id_bureau, CAST(-floor(l_quantity) AS INT) AS months_balance,
  CASE WHEN l_linenumber <= 5 THEN CAST(l_linenumber AS VARCHAR(2)) ELSE 'C' END AS status
FROM lineitem""",
        "pos": f"""
SELECT user_id AS sk_id_curr, event_id AS sk_id_prev, -CAST({prop_k} AS INT) AS months_balance,
  CAST(floor(greatest(value - 60, 0)) AS INT) AS sk_dpd,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS cnt_instalment,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 2 END AS cnt_instalment_future
FROM events WHERE event_type <> 'purchase'""",
        "inst": f"""
SELECT o_custkey AS sk_id_curr, l_orderkey AS sk_id_prev, l_linenumber AS num_instalment_number,
  CAST(floor(l_quantity) AS INT) % 3 AS num_instalment_version, {ship_day} AS days_instalment,
  CASE WHEN l_partkey % 19 = 0 THEN NULL
       ELSE {ship_day} + CAST(l_partkey % 161 AS INT) - 20 END AS days_entry_payment,
  CAST(floor(l_extendedprice) AS DOUBLE) AS amt_instalment,
  CASE WHEN l_partkey % 19 = 0 THEN NULL
       ELSE CAST(floor(l_extendedprice * (1 - l_discount)) AS DOUBLE) END AS amt_payment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "card": f"""
SELECT user_id AS sk_id_curr, event_id AS sk_id_prev, -CAST({prop_k} AS INT) % 12 AS months_balance,
  CAST(floor(value) AS DOUBLE) * 3 AS amt_balance,
  CAST(event_id % 4 AS INT) * 100 AS amt_credit_limit_actual,
  CAST(floor(value) AS DOUBLE) AS amt_drawings_current,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 2 END AS amt_drawings_atm_current,
  CAST(floor(value) AS DOUBLE) / 4 AS amt_drawings_pos_current,
  CAST(floor(value) AS DOUBLE) / 16 AS amt_inst_min_regularity,
  CAST(floor(value) AS DOUBLE) * 2 AS amt_payment_total_current,
  CAST(floor(value) AS DOUBLE) * 3 AS amt_total_receivable,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS cnt_drawings_atm_current,
  CAST(event_id % 7 AS INT) AS cnt_drawings_current, CAST(event_id % 6 AS DOUBLE) AS cnt_drawings_pos_current,
  CAST(floor(greatest(value - 60, 0)) AS INT) AS sk_dpd
FROM events WHERE event_type = 'purchase'""",
        # Scored applicants: a score with ties next to the label.
        "scores": """
SELECT c_custkey AS sk_id_curr, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target,
  CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 1000 AS score
FROM customer""",
        # Attributions in long form: one row per node and feature, with a risk level per node.
        "attr": _attributions(dialect),
        # Node table of the similarity graph.
        "nodes": "\nSELECT vec_id AS sk_id, embedding, label AS cluster FROM embeddings",
        # The same with exact copies (of some, two), near neighbours and a zero vector.
        "twins": f"""
SELECT vec_id AS sk_id, embedding, label AS cluster FROM embeddings
UNION ALL SELECT 1000000 + vec_id, embedding, label FROM embeddings WHERE vec_id % 7 = 0
UNION ALL SELECT 2000000 + vec_id, embedding, label FROM embeddings WHERE vec_id % 49 = 0
UNION ALL SELECT 3000000 + vec_id, {nudged}, label FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT 4000000 + vec_id, {zeroed}, label FROM embeddings WHERE vec_id = 1""",
    }


class LoanViews:
    """The views as lazy DataFrames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _texts(self) -> dict[str, str]:
        return view_sql("spark")

    def view(self, name: str) -> DataFrame:
        text = self._texts[name]
        used = [table for table in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {table}\b", text)]
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
        return self.spark.sql(text, **{table: self.table(table) for table in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._texts:
            return self.view(name)
        raise AttributeError(name)
