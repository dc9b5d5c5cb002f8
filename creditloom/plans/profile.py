"""Profiling and integrity reports. Every report is a DataFrame with one row per column, key or bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.joins import sized_join
from creditloom.operators.ordered import head_and_tail, quantiles, top_per_group, value_counts

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in NUMERIC]


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def columns_by(df: DataFrame, keywords: Sequence[str] = (), kinds: Sequence[str] = ()) -> list[str]:
    """Columns whose name contains a keyword (any case) or whose type is listed, in table order."""
    lowered = [k.lower() for k in keywords]
    return [
        name for name, kind in df.dtypes if kind in kinds or any(k in name.lower() for k in lowered)
    ]


def melt(row: DataFrame, measures: Mapping[str, Sequence[Column]], names: Sequence[str], label: str = "column_name"):
    """One row of ``measures[column] -> values`` turned into one row per column."""
    entries = [
        F.struct(F.lit(column).alias(label), *[value.alias(name) for name, value in zip(names, values)])
        for column, values in measures.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def shape_report(df: DataFrame, table: str) -> DataFrame:
    """Row count, column count, and the type of every column."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"))
    types = [F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind")) for name, kind in df.dtypes]
    return row.select(
        F.lit(table).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.inline(F.array(*types))
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("rows__"), *[F.count(c).alias(c) for c in df.columns])
    total = F.col("rows__")
    measures = {
        c: (total - F.col(c), F.round(F.try_divide((total - F.col(c)) * F.lit(100.0), total), 2)) for c in df.columns
    }
    return melt(row, measures, ["missing", "missing_percent"])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns.

    Moments come from one aggregate; quartiles are exact and come from counted values.
    """
    row = df.agg(
        *[f(c).alias(f"{c}__{n}") for c in columns for n, f in
          (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    measures = {
        c: tuple(F.col(f"{c}__{n}").cast("bigint" if n == "n" else "double") for n in ("n", "mean", "std", "min", "max"))
        for c in columns
    }
    moments = melt(row, measures, ["n", "mean", "std", "min", "max"])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    quartiles = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"])
    return moments.join(quartiles, "column_name", "left")


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of missing columns, written as a 0/1 string."""
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.try_divide(F.col("n") * F.lit(100.0), total))


def integrity_report(parents: DataFrame, children: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Distinct keys, overlap with the parent table, and orphans on either side, per child table.

    Every table is read once: its keys carry one bit each, and one grouping by key tells which tables
    know the key.
    """
    tables = [parents, *children.values()]
    marked = [df.select(key, F.lit(1 << i).alias("known")) for i, df in enumerate(tables)]
    keys = reduce(DataFrame.unionByName, marked).where(F.col(key).isNotNull()).groupBy(key)
    known = keys.agg(F.bit_or("known").alias("known"))
    parent = F.col("known").bitwiseAND(1) != 0
    measures = [F.count_if(parent).alias("parents")]
    for i, name in enumerate(children, start=1):
        child = F.col("known").bitwiseAND(1 << i) != 0
        measures += [F.count_if(child).alias(f"{name}__keys"), F.count_if(child & parent).alias(f"{name}__shared")]
    row = known.agg(*measures)
    reports = {}
    for name in children:
        own, shared = F.col(f"{name}__keys"), F.col(f"{name}__shared")
        percent = F.try_divide(shared * F.lit(100.0), F.col("parents"))
        reports[name] = (own, shared, percent, F.col("parents") - shared, own - shared)
    names = ["distinct_keys", "shared", "shared_percent", "parents_without_rows", "orphan_keys"]
    return melt(row, reports, names, "table_name")


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both sides are present; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def label_correlations(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each numeric column with the label, from one aggregate."""
    chosen = [c for c in (columns or numeric_columns(df)) if c != label]
    y = F.col(label).cast("double")
    row = df.agg(*[_pearson(F.col(c).cast("double"), y).alias(c) for c in chosen])
    return melt(row, {c: (F.col(c),) for c in chosen}, ["correlation"])


def extreme_correlations(correlations: DataFrame, n: int = 10) -> DataFrame:
    return head_and_tail(correlations, "correlation", "column_name", n)


def label_histogram(df: DataFrame, label: str, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Rows per label and equal-width bin between the minimum and maximum of each column."""
    limits = df.agg(
        F.struct(*[F.min(c).cast("double").alias(f"{c}__lo") for c in columns],
                 *[F.max(c).cast("double").alias(f"{c}__hi") for c in columns])
    ).scalar()
    binned = []
    for c in columns:
        low, high = limits.getField(f"{c}__lo"), limits.getField(f"{c}__hi")
        position = F.floor(F.try_divide((F.col(c).cast("double") - low) * F.lit(bins), high - low))
        binned.append(F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).alias(c))
    present = df.select(label, *[F.when(F.col(c).isNotNull(), b).alias(c) for c, b in zip(columns, binned)])
    long = present.unpivot([label], list(columns), "column_name", "bin").where(F.col("bin").isNotNull())
    return long.groupBy(label, "column_name", "bin").agg(F.count(F.lit(1)).alias("n"))


def label_box(df: DataFrame, label: str, column: str) -> DataFrame:
    """Five-number summary per label, the 1.5 IQR fences and how many rows lie outside them."""
    probs = {"low": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "high": 1.0}
    boxes = quantiles(df, column, probs, [label])
    spread = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    fenced = boxes.withColumns({"lower_fence": F.col("q25") - spread, "upper_fence": F.col("q75") + spread})
    beyond = (F.col(column) < F.col("lower_fence")) | (F.col(column) > F.col("upper_fence"))
    outside = (
        sized_join(df.where(F.col(column).isNotNull()).select(label, column), fenced.select(label, "lower_fence", "upper_fence"), label)
        .groupBy(label)
        .agg(F.count_if(beyond).alias("outliers"))
    )
    return fenced.join(outside, label, "left")


def time_ranges(df: DataFrame) -> DataFrame:
    """Minimum, maximum and missing values of the day and month columns."""
    chosen = [c for c in columns_by(df, ["days_", "months_"]) if c in numeric_columns(df)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows__"),
        *[f(c).alias(f"{c}__{n}") for c in chosen for n, f in (("n", F.count), ("min", F.min), ("max", F.max))],
    )
    measures = {
        c: (F.col(f"{c}__min").cast("double"), F.col(f"{c}__max").cast("double"), F.col("rows__") - F.col(f"{c}__n"))
        for c in chosen
    }
    return melt(row, measures, ["low", "high", "missing"])


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The most frequent values of each of the text columns given, from one scan."""
    counts = value_counts(df.select(*columns).unpivot([], list(columns), "column_name", "value"),
                          "value", ["column_name"])
    return top_per_group(counts, ["column_name"], [F.col("n").desc(), F.col("value")], n).drop("rank")
