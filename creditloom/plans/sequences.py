"""Ordered histories per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.joins import hot_share, lookup_join, sized_join
from creditloom.operators.ordered import positions
from creditloom.session import checkpointed

CHUNK = 256
# Steps of a history that is gathered as one array.
BOUND = 8192


def ordered_steps(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with their zero-based ``step`` in the history of their key."""
    return positions(df, order, [key], "step")


def _ranged_chunks(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], chunk: int) -> DataFrame:
    """(key, chunk, steps) of histories of any length: rows are placed by range, so no task holds a history."""
    return (
        ordered_steps(rows, key, order)
        .groupBy(key, F.floor(F.col("step") / chunk).cast("int").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("step", *values))).alias("steps"))
    )


def _merged_chunks(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], chunk: int) -> DataFrame:
    """The same for bounded histories, each gathered and sorted as one array: a single exchange."""
    entry = F.struct(F.struct(*order).alias("at"), F.struct(*values).alias("values"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("whole"))
    numbered = F.transform("whole", lambda x, i: F.struct(
        i.cast("bigint").alias("step"), *[x["values"][name].alias(name) for name in values]))
    chunks = F.sequence(F.lit(0), F.floor((F.size("whole") - 1) / chunk).cast("int"))
    cut = F.transform(chunks, lambda c: F.struct(c.alias("chunk"), F.slice("numbered", c * chunk + 1, chunk).alias("steps")))
    return whole.withColumn("numbered", numbered).select(key, F.inline(cut))


def sequences(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    chunk: int = CHUNK,
    labels: DataFrame | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """Histories as arrays of at most ``chunk`` steps: (key, chunk, n_steps, steps, length, padding).

    Histories are counted first. Those of at most ``bound`` steps are gathered and sorted in one exchange; longer ones
    are ordered by range. ``length`` is that of the longest history. Padding to it is stated as the number of missing zero
    steps after the last chunk of a key instead of being stored, since one very long history would
    otherwise blow up every other one. Chunks keep any single array small. ``labels`` has one row per
    key, whose columns are added; keys without one are left out.
    """
    known = df.where(F.col(key).isNotNull())
    # One small row per key.
    lengths = checkpointed(known.groupBy(key).agg(F.count(F.lit(1)).alias("total__")))
    rows, most = lengths.agg(F.sum("total__"), F.max("total__")).first()
    longest = F.lit(most).cast("bigint")
    extra = [] if labels is None else [c for c in labels.columns if c != key]
    if (most or 0) <= bound:
        pieces = _merged_chunks(known, key, order, values, chunk)
    else:
        # At most one key in ``bound`` rows is long.
        long = lengths.where(F.col("total__") > bound).select(key, F.lit(True).alias("long__"))
        marked = sized_join(known, long, key, "left")
        pieces = _merged_chunks(marked.where("long__ is null"), key, order, values, chunk).unionByName(
            _ranged_chunks(marked.where("long__"), key, order, values, chunk))
    hot = lengths.where(F.col("total__") > (rows or 0) * hot_share(df)).select(key)
    per_key = lengths if labels is None else lengths.join(labels, key)
    joined = lookup_join(pieces, per_key, key, hot=hot)
    is_last = F.col("chunk") == F.floor((F.col("total__") - 1) / chunk)
    return joined.select(
        key, *extra, "chunk", F.size("steps").cast("bigint").alias("n_steps"), "steps", longest.alias("length"),
        F.when(is_last, longest - F.col("total__")).otherwise(0).alias("padding"),
    )
