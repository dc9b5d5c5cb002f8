"""Joins and key-set operations that stay balanced when a few keys own much of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it owns more than this share of the rows, or than a quarter of a shuffle partition's part if that
# is less; at most 1/share keys can be.
HOT_SHARE = 0.002
PART_OF_PARTITION = 0.25
# Counters of a summary for each key that a share allows, the types of keys it takes, and its limits.
SUMMARY = 16
SUMMARISED = ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "string")
MOST_COUNTERS, MOST_LISTED = 1_000_000, 100_000
# Salts of a hot key whose share isn't known, and of rows without a key.
SALTS = 64
# Largest lookup that is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_share(df: DataFrame) -> float:
    """Share of the rows above which a key would fill a good part of a shuffle partition."""
    return min(HOT_SHARE, PART_OF_PARTITION / partitions(df))


def key_counts(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(keys..., n__, total__) of every key that owns more than ``share`` of the rows, and of some that own less.

    One key column of a plain type goes through a mergeable summary of counters, so that each task sends its counters
    and not its keys: with SUMMARY / share of them a count is off by less than half the share, and no key above it is missed.
    Other keys are counted one by one.
    """
    single = keys[0] if len(keys) == 1 else None
    if single is None or df.schema[single].dataType.typeName() not in SUMMARISED or SUMMARY / share > MOST_COUNTERS:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
        return counts.withColumn("total__", counts.agg(F.sum("n__")).scalar()).dropna(subset=list(keys))
    counters = int(SUMMARY / share)
    named = df.select(F.col(single).alias("key__"))
    summary = named.agg(
        F.count(F.lit(1)).alias("total__"), F.expr(f"approx_top_k(key__, {min(counters, MOST_LISTED)}, {counters})").alias("top__"))
    each = summary.select("total__", F.inline("top__").alias("item__", "n__"))
    return each.select(F.col("item__").alias(single), "n__", "total__").dropna(subset=[single])


def salted_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hot keys with ``salts__``: enough that a salt's rows are about PART_OF_PARTITION of a partition's part."""
    counts, limit = key_counts(df, keys, hot_share(df)), hot_share(df) / 2
    share = F.col("n__") / F.col("total__")
    salts = F.ceil(share * F.lit(partitions(df) / PART_OF_PARTITION)).cast("int") + 1
    return counts.where(share > F.lit(limit)).select(*keys, salts.alias("salts__"))


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys owning more than ``share`` of the rows: never more than ``1 / share`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
    total = counts.agg(F.sum("n__")).scalar()
    return counts.where(F.col("n__") > total * F.lit(share)).select(*keys).dropna()


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: str | Sequence[str], how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join of ``rows`` with a ``lookup`` that has one row per key.

    Rows of a hot key are spread over salts and only the lookup rows of hot keys are repeated per
    salt, so no task receives all rows of such a key. Threshold and salts follow the number of shuffle
    partitions, so a salt holds less than a partition's even part at any size. The hot keys themselves
    are few by definition (at most ``1 / hot_share``), hence the broadcast. ``hot`` names them, with
    ``salts__`` if known, where the caller can find them more cheaply than by counting ``rows``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how}")
    on = [keys] if isinstance(keys, str) else list(keys)
    hot = salted_keys(rows, on) if hot is None else hot
    hot = F.broadcast(hot if "salts__" in hot.columns else hot.withColumn("salts__", F.lit(max(SALTS, partitions(rows)))))
    # Rows with a null key match nothing; they are spread like hot ones instead of meeting in one task.
    unmatched = reduce(or_, [F.col(k).isNull() for k in on])
    hashed = [F.col(c) for c in rows.columns if rows.schema[c].dataType.typeName() not in ("map", "variant")]
    salts = F.coalesce("salts__", F.when(unmatched, F.lit(max(SALTS, partitions(rows)))), F.lit(1))
    salted_rows = rows.join(hot, on, "left").withColumn("salt__", F.pmod(F.xxhash64(*hashed), salts).cast("int"))
    copies = F.sequence(F.lit(0), F.coalesce("salts__", F.lit(1)) - 1)
    salted_lookup = lookup.join(hot, on, "left").withColumn("salt__", F.explode(copies)).drop("salts__")
    return salted_rows.drop("salts__").join(salted_lookup, [*on, "salt__"], how).drop("salt__")


def _is_small(lookup: DataFrame) -> bool:
    """Counts the rows and the bytes of their variable-length values, up to the broadcast limits."""
    sizes = [F.lit(16 * len(lookup.columns))]
    for name, kind in lookup.dtypes:
        if kind == "string":
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind.startswith("array"):
            sizes.append(F.greatest(F.size(name), F.lit(0)) * 8)
    row_bytes = reduce(add, sizes).cast("bigint")
    measured = lookup.limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")
    ).first()
    return measured["n"] <= BROADCAST_ROWS and measured["bytes"] <= BROADCAST_BYTES


def sized_join(rows: DataFrame, lookup: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``lookup_join``, replaced by a broadcast when the lookup is measured and found small."""
    on = [keys] if isinstance(keys, str) else list(keys)
    if _is_small(lookup):
        return rows.join(F.broadcast(lookup), on, how)
    return lookup_join(rows, lookup, on, how)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present in both tables."""
    return distinct_keys(left, key).join(distinct_keys(right, key), key, "left_semi")


def keys_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left table that the right one lacks."""
    return distinct_keys(left, key).join(distinct_keys(right, key), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return distinct_keys(left, key).intersect(distinct_keys(right, key))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return distinct_keys(left, key).exceptAll(distinct_keys(right, key))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on each side, shared keys, and keys on one side only."""
    marked = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .where(F.col(key).isNotNull())
    )
    sides = marked.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.count_if(F.col("l") == 1).alias("left_keys"),
        F.count_if(F.col("r") == 1).alias("right_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
    )
