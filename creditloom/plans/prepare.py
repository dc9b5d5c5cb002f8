"""Turning the feature table into model input: roles, codes, scaling, sampling, splitting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators.joins import lookup_join
from creditloom.operators.ordered import positions
from creditloom.plans.profile import melt, numeric_columns
from creditloom.session import checkpointed

# Name parts and names that make a column numeric whatever its values.
NUMERIC_KEYWORDS = ("MEAN", "SUM", "MIN", "MAX", "COUNT", "RATIO", "STD", "AVG", "TOTAL", "MODE", "MEDI")
ALWAYS_NUMERIC = (
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "REGION_POPULATION_RELATIVE", "DAYS_EMPLOYED",
    "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "DAYS_LAST_PHONE_CHANGE",
)
# A column with more distinct values is numeric; limits of the clustering columns.
MAX_CATEGORIES = 50
CLUSTER_ZERO_RATIO = 0.3
CLUSTER_DISTINCT = 20
VALID_SHARE = 0.1


def small_distinct_counts(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int | None]:
    """Distinct values per column, null counted as one; None when certainly above ``limit``.

    One sketch pass rules out the columns far above the limit. The rest have few values, and are
    counted exactly from their combined (column, value) pairs.
    """
    # One binary buffer per column, where the built-in approximate count would need hundreds of fields.
    sketch = {c: F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 12)).alias(c) for c in columns}
    sketches = df.agg(*sketch.values()).first()
    near = [c for c in columns if (sketches[c] or 0) <= 2 * limit]
    counts: dict[str, int | None] = {c: None for c in columns if c not in near}
    if near:
        pairs = df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in near]))
        ).distinct()
        exact = dict(pairs.groupBy("c").agg(F.count(F.lit(1))).collect())
        counts.update({c: exact.get(c, 0) for c in near})
    return counts


def forced_numeric(name: str) -> bool:
    upper = name.upper()
    return upper in ALWAYS_NUMERIC or any(k in upper for k in NUMERIC_KEYWORDS)


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]

    def report(self, df: DataFrame) -> DataFrame:
        rows = [(c, "numeric" if c in set(self.numeric) else "categorical") for c in self.numeric + self.categorical]
        return df.sparkSession.createDataFrame(rows, "column_name string, role string")


def choose_roles(df: DataFrame, skip: Sequence[str] = ("sk_id_curr", "target")) -> Roles:
    """Numeric by name or by having more than fifty distinct values, else categorical."""
    columns = [c for c in df.columns if c not in skip]
    undecided = [c for c in columns if not forced_numeric(c)]
    counts = small_distinct_counts(df, undecided, MAX_CATEGORIES) if undecided else {}
    numeric = [c for c in columns if forced_numeric(c) or counts[c] is None or counts[c] > MAX_CATEGORIES]
    return Roles(numeric, [c for c in columns if c not in set(numeric)])


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, list(columns))


# ---------------------------------------------------------------- codes
# Columns with more codes are joined: a map is searched entry by entry. Bytes of all maps together.
MAP_CODES = 2 * MAX_CATEGORIES
MAP_BYTES = 16 << 20


def _value_text(value: Column, is_text: bool) -> Column:
    """The value as text, equal exactly where the values are: adding 0 makes one zero of two."""
    return value if is_text else (value.cast("double") + F.lit(0.0)).cast("string")


def _entry(column: Column, text: Column) -> Column:
    """Column and value as one key, different for any other pair; null for a null value."""
    return F.concat(F.length(column).cast("string"), F.lit(":"), column, text)


@dataclass(frozen=True)
class CodeBook:
    """Codes per column as a table (column_name, missing, number, label, code)."""

    table: DataFrame
    columns: list[str]
    null_codes: Mapping[str, int]
    size: int
    small: frozenset[str]

    def apply(self, df: DataFrame) -> DataFrame:
        """Values replaced by their codes; a value the book lacks becomes null.

        Columns with few codes look them up in one map, which a subquery gathers: no join. All other columns are
        melted to (row, column, value), meet the book in one join that spreads frequent values, and are put together
        by row: two exchanges of values and one of rows for any number of columns.
        """
        kinds = dict(df.dtypes)
        value = {c: _value_text(F.col(c), kinds[c] == "string") for c in self.columns}
        label = F.coalesce("label", _value_text(F.col("number"), False))
        book = self.table.where(~F.col("missing")).select("column_name", label.alias("label__"), F.col("code").alias("code__"))
        found = {}
        mapped = [c for c in self.columns if c in self.small]
        if mapped:
            parts = book.where(F.col("column_name").isin(mapped)).groupBy("column_name").agg(
                F.map_from_entries(F.collect_list(F.struct("label__", "code__"))).alias("codes"))
            of = {c: F.first(F.when(F.col("column_name") == c, F.col("codes")), ignorenulls=True) for c in mapped}
            codes = parts.agg(F.struct(*[of[c].alias(c) for c in mapped])).scalar()
            found = {c: F.element_at(codes.getField(c), value[c]) for c in mapped}
        melted = [c for c in self.columns if c not in self.small]
        rows = df
        if melted:
            # Row numbers must survive a lost executor, so they are stored before they are used twice.
            rows = checkpointed(df.withColumn("row__", F.monotonically_increasing_id()))
            cells = F.array(*[F.struct(F.lit(i).alias("at__"), _entry(F.lit(c), value[c]).alias("entry__"))
                              for i, c in enumerate(melted)])
            each = rows.select("row__", F.inline(cells)).where(F.col("entry__").isNotNull())
            joined = book.where(F.col("column_name").isin(melted)).select(
                _entry(F.col("column_name"), F.col("label__")).alias("entry__"), "code__")
            coded = lookup_join(each, joined, "entry__")
            wide = coded.groupBy("row__").agg(
                F.map_from_entries(F.collect_list(F.struct("at__", "code__"))).alias("codes__"))
            rows = rows.join(wide, "row__", "left")
            found |= {c: F.element_at("codes__", F.lit(i)) for i, c in enumerate(melted)}
        null_code = {c: F.lit(self.null_codes.get(c)).cast("int") for c in self.columns}
        return rows.select(*[
            F.when(F.col(c).isNull(), null_code[c]).otherwise(found[c]).alias(c) if c in found else F.col(c)
            for c in df.columns
        ])


def _measured(ranked: DataFrame) -> dict:
    """Per column: number of codes, whether null is one of them, and the bytes of its part of the book."""
    rows = ranked.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("missing").cast("int")).alias("has_null"),
        F.sum(F.coalesce(F.octet_length("label"), F.lit(0)) + F.octet_length("column_name") + F.lit(32)).alias("bytes"),
    )
    return {r["column_name"]: (r["n"], r["has_null"], r["bytes"]) for r in rows.collect()}


def _mapped(columns: Sequence[str], measured: Mapping[str, tuple]) -> frozenset[str]:
    """Columns that go into the map: few codes each, and together no more than MAP_BYTES."""
    chosen, used = [], 0
    for c in columns:
        n, _, size = measured.get(c, (0, 0, 0))
        if n <= MAP_CODES and used + size <= MAP_BYTES:
            chosen.append(c)
            used += size
    return frozenset(chosen)


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    entries = []
    for c in columns:
        is_text = kinds[c] == "string"
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).isNull().alias("missing"),
                (F.lit(None) if is_text else F.col(c)).cast("double").alias("number"),
                (F.col(c) if is_text else F.lit(None)).cast("string").alias("label"),
            )
        )
    return df.select(F.inline(F.array(*entries))).distinct()


def factorise(df: DataFrame, columns: Sequence[str]) -> CodeBook:
    """Code = rank of the value within its column, from 0; null is -1."""
    values = _distinct_values(df, columns).where(~F.col("missing"))
    ranked = positions(values, ["number", "label"], ["column_name"], "code")
    table = ranked.withColumn("code", F.col("code").cast("int"))
    measured = _measured(table)
    small = _mapped(columns, measured)
    return CodeBook(table, list(columns), {c: -1 for c in columns}, sum(n for n, _, _ in measured.values()), small)


def offset_codes(df: DataFrame, columns: Sequence[str]) -> CodeBook:
    """Codes that are unique across columns: ranks, null last, shifted by the sizes of earlier columns."""
    ranked = positions(_distinct_values(df, columns), ["missing", "number", "label"], ["column_name"], "rank")
    measured = _measured(ranked)
    offset, shift, null_codes = 0, F.lit(0), {}
    for c in columns:
        n, has_null, _ = measured.get(c, (0, 0, 0))
        shift = F.when(F.col("column_name") == c, offset).otherwise(shift)
        if has_null:
            null_codes[c] = offset + n - 1
        offset += n
    table = ranked.withColumn("code", (F.col("rank") + shift).cast("int"))
    small = _mapped(columns, measured)
    return CodeBook(table, list(columns), null_codes, offset, small)


# ---------------------------------------------------------------- scaling
@dataclass(frozen=True)
class MinMaxScaler:
    limits: Mapping[str, tuple[float, float]]

    def expression(self, column: str) -> Column:
        low, high = self.limits[column]
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        if high == low:
            return F.lit(0.0)
        return (value - F.lit(low)) / F.lit(high - low)

    def apply(self, df: DataFrame) -> DataFrame:
        """Values outside the fitted range are not clipped."""
        return df.withColumns({c: self.expression(c) for c in self.limits})


def fit_minmax(train: DataFrame, columns: Sequence[str]) -> MinMaxScaler:
    """Limits over the training rows, nulls taken as 0: one vector summary, one row to the driver."""
    zero = F.lit(0.0)
    filled = F.array(*[F.coalesce(F.col(c).cast("double"), zero) for c in columns])
    summary = Summarizer.metrics("count", "min", "max").summary(array_to_vector(filled))
    found = train.select(summary.alias("s")).first()["s"]
    if not found["count"]:
        return MinMaxScaler({c: (0.0, 0.0) for c in columns})
    return MinMaxScaler({c: (float(lo), float(hi)) for c, lo, hi in zip(columns, found["min"], found["max"])})


# ---------------------------------------------------------------- clustering columns
def cluster_column_report(
    df: DataFrame, columns: Sequence[str], zero_ratio: float = CLUSTER_ZERO_RATIO, distinct: int = CLUSTER_DISTINCT
) -> DataFrame:
    """Share of zeros per column and whether it qualifies for clustering (few zeros, few values)."""
    counts = small_distinct_counts(df, columns, distinct)
    few = {c: counts[c] is not None and counts[c] < distinct for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("rows__"), *[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    ratios = {c: F.try_divide(F.col(c).cast("double"), F.col("rows__")) for c in columns}
    measures = {c: (ratio, (ratio < zero_ratio) & F.lit(few[c])) for c, ratio in ratios.items()}
    return melt(row, measures, ["zero_ratio", "selected"])


def cluster_columns(df: DataFrame, columns: Sequence[str] | None = None, **limits) -> list[str]:
    chosen = list(columns or numeric_columns(df))
    report = cluster_column_report(df, chosen, **limits).where("selected").select("column_name")
    keep = {row[0] for row in report.collect()}
    return [c for c in chosen if c in keep]


# ---------------------------------------------------------------- sampling and splitting
def down_sample(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """All positives and the given share of negatives, chosen by key hash."""
    return df.where((F.col(label) == 1) | C.hash_below(key, f"down{seed}", share))


def split(df: DataFrame, key: str, valid_share: float = VALID_SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation), disjoint and stable under any reordering of the rows."""
    is_valid = C.hash_below(key, f"split{seed}", valid_share)
    return df.where(~is_valid), df.where(is_valid)


# A Poisson count is drawn as a sum of parts with at most this rate, and the part's tail beyond
# MAX_DRAWS has less probability than the hash can resolve.
PART_RATE = 4.0
MAX_DRAWS = 28


def up_sample(df: DataFrame, label: str, key: str, weight: float, seed: int = 42) -> DataFrame:
    """Sample with replacement of about as many rows as ``df``, positives ``weight`` times as likely.

    Each row is drawn a Poisson number of times, which is what N independent weighted draws give per
    row as N grows; the count is a function of the key, so the sample is reproducible anywhere.
    """
    total_weight = F.sum(F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    row = df.agg(F.count(F.lit(1)).alias("n"), total_weight.alias("w")).first()
    scale = row["n"] / row["w"] if row["w"] else 0.0
    rates = (weight * scale, scale)
    hashes = [f"u{part}__" for part in range(max(map(_poisson_parts, rates)))]
    hashed = df.withColumns({name: C.hash_unit(key, f"up{seed}/{name}") for name in hashes})
    draws = F.when(F.col(label) == 1, poisson_draws(hashes, rates[0])).otherwise(poisson_draws(hashes, rates[1]))
    counted = hashed.withColumn("draws__", draws).where(F.col("draws__") > 0)
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws__"))))
    return repeated.drop("draws__", *hashes)


def _poisson_parts(rate: float) -> int:
    return max(1, math.ceil(rate / PART_RATE))


def poisson_draws(hashes: Sequence[str], rate: float) -> Column:
    """Poisson count with the given rate, by inverting the distribution at uniform columns."""
    parts = _poisson_parts(rate)
    draws = F.lit(0)
    for u in hashes[:parts]:
        cumulative, term = 0.0, math.exp(-rate / parts)
        for k in range(MAX_DRAWS):
            cumulative += term
            term *= rate / parts / (k + 1)
            draws = draws + F.when(F.col(u) >= F.lit(cumulative), 1).otherwise(0)
    return draws
