"""Registry of named queries, each a Spark job over the loan views and, where possible, its SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.grouped import Spec, feature_name
from creditloom.sources.projections import LoanViews, view_sql

Job = Callable[[LoanViews], DataFrame]


@dataclass(frozen=True)
class Query:
    job: Job
    sql: str | None = None


class Catalog(dict[str, Query]):
    def add(self, name: str, job: Job, sql: str | None = None) -> None:
        if name in self:
            raise ValueError(f"query {name} is registered twice")
        self[name] = Query(job, sql)

    def jobs(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {name: _bound(query.job) for name, query in self.items()}

    def checks(self) -> dict[str, str]:
        return {name: with_views(query.sql) for name, query in self.items() if query.sql is not None}


def _bound(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: job(LoanViews(spark, folder))


def with_views(sql: str) -> str:
    """Prefix the check with the view definitions it refers to."""
    views = view_sql("duckdb")
    ctes = [f"{name} AS ({text})" for name, text in views.items() if re.search(rf"\b{name}\b", sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded for comparison; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def r6(expression: str) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"(round({expression}, 6) + CAST(0 AS DOUBLE))"


# Columns whose values are quotients: their means depend on summation order, so they are rounded.
QUOTIENTS = {
    "prev_credit_appl_ratio", "prev_goods_appl_ratio", "prev_interests_rate", "bureau_credit_debt_ratio",
    "amt_ratio", "balance_limit_ratio", "drawing_limit_ratio", "payment_ratio",
}
INTEGERS = {
    "sk_id_curr", "sk_id_prev", "sk_id_bureau", "days_decision", "days_credit", "credit_day_overdue",
    "days_credit_enddate", "days_enddate_fact", "bureau_enddate_fact_diff", "bureau_credit_fact_diff",
    "bureau_credit_enddate_diff", "bureau_is_dpd", "bureau_is_dpd_over120", "months_balance", "bureau_bal_is_dpd",
    "bureau_bal_is_dpd_over120", "sk_dpd", "pos_is_dpd", "pos_is_dpd_under_120", "pos_is_dpd_over_120",
    "days_entry_payment", "days_instalment", "ins_is_dpd", "ins_is_dpd_under_120", "ins_is_dpd_over_120",
    "cnt_drawings_current", "card_is_dpd", "card_is_dpd_under_120", "card_is_dpd_over_120",
    "prev_days_last_due_diff", "days_late", "num_instalment_number",
}


def quotient_features(spec: Spec, prefix: str) -> list[str]:
    return [
        feature_name(prefix, column, fn)
        for column, fns in spec.items()
        for fn in fns
        if (column in QUOTIENTS and fn in ("mean", "sum", "std")) or fn == "std"
    ]


def spec_sql(spec: Spec, prefix: str, condition: str | None = None) -> list[str]:
    """Aggregate expressions of a specification, optionally under a row filter.

    Under a filter, counts and sums are null when no row passes it.
    """
    where = f" FILTER (WHERE {condition})" if condition else ""
    rows = f"count(*){where}"
    out = []
    for column, fns in spec.items():
        for fn in fns:
            if fn == "count":
                sql = f"count({column}){where}"
            elif fn == "nunique":
                sql = f"count(DISTINCT {column}){where}"
            elif fn == "sum":
                sql = f"coalesce(sum({column}){where}, 0)"
                sql = f"CAST({sql} AS BIGINT)" if column in INTEGERS else sql
            elif fn == "mean":
                sql = f"avg({column}){where}"
            elif fn == "std":
                sql = f"stddev_samp({column}){where}"
            else:
                sql = f"{fn}({column}){where}"
            if (column in QUOTIENTS and fn in ("mean", "sum")) or fn == "std":
                sql = r6(sql)
            if condition and fn in ("count", "nunique", "sum"):
                sql = f"CASE WHEN {rows} > 0 THEN {sql} END"
            out.append(f"{sql} AS {feature_name(prefix, column, fn)}")
    return out


def select_list(items: Iterable[str]) -> str:
    return ",\n  ".join(items)
