"""Order-dependent work without a window over the whole table or over one large key.

Rows are range-partitioned by (keys, order), so a key that owns a large part of the table is spread
over several partitions. Sums inside a partition are combined with the totals of the partitions before
it. The partition number of a row is stored with the checkpointed table, so both uses of it agree even
when tasks are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.joins import sized_join
from creditloom.session import checkpointed

# Relative error of the quantile summary is 1 / ACCURACY; a bracket reaches BRACKET times that to either side.
ACCURACY, BRACKET = 10_000, 10
# Number of the slot of a group that is its own bracket for all probabilities.
WHOLE = -1


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``<column>_before``: the sum of ``column`` over the rows earlier in the order of the key.

    The order must be unique per key for the result to be determined.
    """
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("part__", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "part__").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a partition can have started in an earlier one: the table has at most one
    # row per partition, whatever the size of the data, so the partition number alone identifies it.
    offsets = totals.select(
        *[F.col(k).alias(f"{k}__at") for k in keys],
        F.col("part__").alias("part____at"),
        *[F.sum(c).over(earlier).alias(f"{c}__offset") for c in sums],
    ).where(F.col(f"{sums[0]}__offset").isNotNull())
    same = [F.col(k).eqNullSafe(F.col(f"{k}__at")) for k in (*keys, "part__")]
    placed = ranged.join(F.broadcast(offsets), same, "left")
    inside = (
        Window.partitionBy(*keys, "part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {
        f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"{c}__offset"), F.lit(0))
        for c in sums
    }
    return placed.withColumns(before).select(*df.columns, *before)


def positions(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Adds the zero-based position of every row in the order of its key."""
    numbered = running_totals(df.withColumn("one__", F.lit(1)), order, ["one__"], keys)
    return numbered.withColumnRenamed("one___before", name).drop("one__")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value; ties of a value shrink to one row before any ordering."""
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _brackets(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """Per group the number of values, and for each probability two values (lo, hi) between which its rank lies.

    They come from Spark's mergeable quantile summary, asked BRACKET times its error to either side. A group
    with too few values for that is its own bracket (``whole``), and brackets at the ends end with it.
    """
    margin = BRACKET / accuracy
    asked = sorted({min(max(p + side, 0.0), 1.0) for p in probs for side in (-margin, margin)})
    summary = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total__"), F.min(value).alias("least__"), F.max(value).alias("most__"),
        F.percentile_approx(value, asked, accuracy).alias("asked__"),
    )

    def limit(p: float, side: float, end: str):
        at = p + side
        return F.col("asked__")[asked.index(at)] if 0.0 < at < 1.0 else F.col(end)

    brackets = [F.struct(limit(p, -margin, "least__").alias("lo"), limit(p, margin, "most__").alias("hi")) for p in probs]
    whole = F.col("total__") < BRACKET * accuracy
    return summary.select(*by, "total__", F.struct(whole.alias("whole"), F.array(*brackets).alias("each")).alias("brackets__"))


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Exact linearly interpolated quantiles as one row per group, one column per name in ``probs``.

    Two scans: a mergeable summary brackets each rank, then values below a bracket are counted and the ones inside
    are ordered, after ties have become one row. What is ordered is a few parts in ``accuracy`` of the values at any
    size; a group small enough to be its own bracket has fewer than BRACKET times ``accuracy`` of them.
    """
    names, ps = list(probs), [float(p) for p in probs.values()]
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value__"))
    summary = checkpointed(_brackets(present, "value__", ps, by, accuracy))
    if by:
        joined = sized_join(present, summary, by)
    else:
        joined = present.withColumn("brackets__", summary.select("brackets__").scalar())
    # A value is nothing to a bracket below it, a count (null) to one above it, and a member of one around it.
    whole = F.col("brackets__.whole")
    slots = [F.when(whole, F.struct(F.lit(WHOLE).alias("slot__"), F.col("value__").alias("member__")))]
    for slot in range(len(ps)):
        low, high = (F.col("brackets__.each")[slot][end] for end in ("lo", "hi"))
        member = F.when(F.col("value__") >= low, F.col("value__"))
        slots.append(F.when(~whole & (F.col("value__") <= high), F.struct(F.lit(slot).alias("slot__"), member.alias("member__"))))
    parts = joined.select(*by, F.explode(F.array(*slots)).alias("x")).where("x is not null")
    members = parts.groupBy(*by, "x.slot__", "x.member__").agg(F.count(F.lit(1)).alias("n"))
    ordered = running_totals(members, ["member__"], ["n"], [*by, "slot__"])  # the count, a null, comes first
    totals = summary.select(*by, "total__")
    ranked = sized_join(ordered, totals, by) if by else ordered.withColumn("total__", totals.scalar())
    picked = []
    for slot, (name, p) in enumerate(zip(names, ps)):
        rank = (F.col("total__") - 1) * F.lit(p)
        for suffix, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = F.col("slot__").isin(slot, WHOLE) & (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            picked.append(F.max(F.when(holds, F.col("member__"))).alias(f"{name}__{suffix}"))
    ends = ranked.groupBy(*by).agg(F.max("total__").alias("total__"), *picked)
    result = []
    for name, p in zip(names, ps):
        rank = (F.col("total__") - 1) * F.lit(p)
        low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        missed = F.col("total__").isNotNull() & (low.isNull() | high.isNull())
        error = F.raise_error(F.lit(f"the rank of {name} is outside its bracket")).cast("double")
        result.append(F.when(missed, error).otherwise(low + (high - low) * (rank - F.floor(rank))).alias(name))
    return ends.select(*by, *result)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark trims each group before the shuffle, so hot groups stay small."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def head_and_tail(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows, marked by side."""
    present = df.where(F.col(order).isNotNull())
    top = present.orderBy(F.col(order).desc(), F.col(tie)).limit(n).withColumn("side", F.lit("top"))
    bottom = present.orderBy(F.col(order), F.col(tie)).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
