"""Grouped feature aggregates generated from a column -> functions specification.

A window is a named row filter (all rows, the last year, active credits, ...). All windows of a table are
computed together, from one scan and with one exchange.

What crosses the network decides the cost here. A feature family has several times more aggregate
buffers than source columns, and an applicant has a few dozen rows spread over the whole table, so
combining before the exchange would ship wide buffers and reduce next to nothing. Rows of ordinary keys
are therefore exchanged as they are, with derived columns computed afterwards. Keys that own a large
share of the table are the opposite case: they are few and combine to one row per task, so they take
the ordinary partial aggregation and never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.joins import hot_share

Spec = Mapping[str, Sequence[str]]
Derive = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Look:
    """How a table is looked at to choose a route. The result is the same on every route.

    share: of the rows looked at. min_rows: with fewer looked-at rows the table is small enough for any route.
    rows_per_key: above this many on average, combining before the exchange pays for every key. hot_share: a key
    is hot when it owns more of the rows; None: as in :func:`joins.hot_share`, by the number of shuffle partitions.
    """

    share: float = 0.01
    min_rows: int = 10_000
    rows_per_key: int = 256
    hot_share: float | None = None


LOOK = Look()

# Which mergeable parts a function is computed from.
_PARTS = {"count": ("n",), "sum": ("sum",), "mean": ("n", "sum"), "min": ("min",), "max": ("max",)}
_COMPUTE = {"n": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Window:
    """A row filter and the prefix of the features computed under it."""

    prefix: str
    condition: Column | None = None

    def inside(self, value: Column) -> Column:
        return value if self.condition is None else F.when(self.condition, value)


def feature_name(prefix: str, column: str, fn: str) -> str:
    return f"{prefix}{column}_{fn}"


def feature_names(spec: Spec, prefix: str) -> list[str]:
    return [feature_name(prefix, column, fn) for column, fns in spec.items() for fn in fns]


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _routes(df: DataFrame, key: str, look: Look) -> tuple[list, bool]:
    """Hot keys, and whether ordinary keys have few enough rows to be exchanged uncombined."""
    counts = df.select(key).sample(look.share, seed=11).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, keys, most = counts.agg(F.sum("n"), F.count(F.lit(1)), F.max("n")).first()
    if not rows or rows < look.min_rows or rows > keys * look.rows_per_key * look.share + keys:
        return [], False
    limit = rows * (hot_share(df) if look.hot_share is None else look.hot_share)
    hot = [row[0] for row in counts.where(F.col("n") > limit).select(key).collect()] if most > limit else []
    return hot, True


def window_features(
    df: DataFrame, key: str, spec: Spec, windows: Sequence[Window], derive: Derive = _as_is, look: Look | None = None
) -> DataFrame:
    """Features of several windows of ``derive(df)``, one row per non-null key.

    Features of a window without rows are null, counts included, as a left join of separately
    aggregated windows would leave them. ``std`` is the sample deviation (null for one row),
    ``nunique`` ignores nulls, ``sum`` of an all-null group is 0.
    """
    present = df.where(F.col(key).isNotNull())
    hot, uncombined = _routes(present, key, look or LOOK)
    if not uncombined:
        return _aggregate(derive(present), key, spec, windows)
    if not hot:
        return _aggregate(derive(present.repartition(key)), key, spec, windows)
    is_hot = F.col(key).isin(hot)
    ordinary = _aggregate(derive(present.where(~is_hot).repartition(key)), key, spec, windows)
    return ordinary.unionByName(_aggregate(derive(present.where(is_hot)), key, spec, windows))


def _aggregate(rows: DataFrame, key: str, spec: Spec, windows: Sequence[Window]) -> DataFrame:
    parts = list({(column, part): None for column, fns in spec.items() for fn in fns for part in _PARTS.get(fn, ())})
    distinct = [column for column, fns in spec.items() if "nunique" in fns]
    deviating = [column for column, fns in spec.items() if "std" in fns]
    # One distinct column is counted by grouping on it first; that needs every other part to be mergeable.
    two_steps = len(distinct) == 1 and not deviating

    first = []
    for i, window in enumerate(windows):
        first.append(F.sum(window.inside(F.lit(1))).alias(f"w{i}__rows"))
        for column, part in parts:
            first.append(_COMPUTE[part](window.inside(F.col(column))).alias(f"w{i}__{column}__{part}"))
        for column in deviating:
            first.append(F.stddev_samp(window.inside(F.col(column))).alias(f"w{i}__{column}__std"))
        if not two_steps:
            for column in distinct:
                first.append(F.count_distinct(window.inside(F.col(column))).alias(f"w{i}__{column}__nunique"))
    reduced = rows.groupBy(key, *(distinct if two_steps else [])).agg(*first)

    if two_steps:
        merged = []
        for i, _ in enumerate(windows):
            held = F.col(f"w{i}__rows")
            merged.append(F.sum(held).alias(f"w{i}__rows"))
            for column, part in parts:
                merged.append(_MERGE[part](f"w{i}__{column}__{part}").alias(f"w{i}__{column}__{part}"))
            seen = F.col(distinct[0]).isNotNull() & held.isNotNull()
            merged.append(F.count_if(seen).alias(f"w{i}__{distinct[0]}__nunique"))
        reduced = reduced.groupBy(key).agg(*merged)

    features, kept = [], None
    for i, window in enumerate(windows):
        for column, fns in spec.items():
            for fn in fns:
                value = _feature(f"w{i}__{column}__", fn)
                if window.condition is not None and fn in ("sum", "nunique", "count"):
                    value = F.when(F.col(f"w{i}__rows").isNotNull(), value)
                features.append(value.alias(feature_name(window.prefix, column, fn)))
        held = F.col(f"w{i}__rows").isNotNull()
        kept = held if kept is None else kept | held
    if all(window.condition is not None for window in windows):
        reduced = reduced.where(kept)
    return reduced.select(key, *features)


def _feature(stem: str, fn: str) -> Column:
    if fn == "mean":
        return F.try_divide(F.col(f"{stem}sum"), F.col(f"{stem}n"))
    if fn == "sum":
        return F.coalesce(F.col(f"{stem}sum"), F.lit(0))
    return F.col(stem + {"count": "n"}.get(fn, fn))


def grouped_features(df: DataFrame, key: str, spec: Spec, prefix: str = "", derive: Derive = _as_is) -> DataFrame:
    """The features of all rows, one row per non-null key."""
    return window_features(df, key, spec, [Window(prefix)], derive)


def joined_windows(
    df: DataFrame, key: str, spec: Spec, windows: Sequence[Window], derive: Derive = _as_is
) -> DataFrame:
    """The same features from one aggregate per window, left-joined to the first window."""
    tables = [
        grouped_features(df if w.condition is None else df.where(w.condition), key, spec, w.prefix, derive)
        for w in windows
    ]
    result = tables[0]
    for table in tables[1:]:
        result = result.join(table, key, "left")
    return result
