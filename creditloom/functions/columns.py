"""Column expressions for derived features. All are built-in expressions, none a UDF."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
DAYS_SENTINEL = 365243
OVERDUE_STATUSES = ("1", "2", "3", "4", "5")
WORST_STATUS = "5"
DPD_LIMIT = 120


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def diff(left: Column | str, right: Column | str) -> Column:
    return _col(left) - _col(right)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is null on a zero denominator, where plain ``/`` raises under ANSI."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def smoothed_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    return safe_ratio(_col(numerator) + F.lit(1.0), _col(denominator) + F.lit(1.0))


def implied_rate(annuity: Column | str, periods: Column | str, credit: Column | str) -> Column:
    """Interest per period implied by paying ``annuity`` for ``periods`` on ``credit``."""
    repaid = safe_ratio(_col(annuity) * _col(periods), credit)
    return safe_ratio(repaid - F.lit(1.0), periods)


def _present(columns: Sequence[Column]) -> Column:
    return reduce(add, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])


def _total(columns: Sequence[Column]) -> Column:
    return reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean over the non-null values of a row; null when there are none."""
    cols = [_col(c) for c in columns]
    return safe_ratio(_total(cols), _present(cols))


def row_std(columns: Sequence[Column | str], ddof: int = 1) -> Column:
    """Standard deviation over the non-null values of a row; null when too few."""
    cols = [_col(c) for c in columns]
    n = _present(cols)
    total = _total(cols)
    squares = _total([c * c for c in cols])
    spread = F.greatest(squares - safe_ratio(total * total, n), F.lit(0.0))
    return F.when(n > ddof, F.sqrt(safe_ratio(spread, n - ddof)))


def sentinel_to_null(column: Column | str, sentinel: int = DAYS_SENTINEL) -> Column:
    return F.nullif(_col(column), F.lit(sentinel))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def dpd_flags(days_late: Column, prefix: str) -> dict[str, Column]:
    """The three delinquency flags of a days-past-due value."""
    return {
        f"{prefix}is_dpd": flag(days_late > 0),
        f"{prefix}is_dpd_under_120": flag((days_late > 0) & (days_late < DPD_LIMIT)),
        f"{prefix}is_dpd_over_120": flag(days_late >= DPD_LIMIT),
    }


def member_flag(column: Column | str, values: Sequence[str]) -> Column:
    return flag(_col(column).isin(*values))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within the limits; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def gaussian_kernel(similarity: Column, width: float = 0.1) -> Column:
    return F.exp(-F.pow(F.lit(1.0) - similarity, 2) / F.lit(width))


def smooth_threshold(similarity: Column, slope: float = 5.0) -> Column:
    return sigmoid(similarity * F.lit(slope))


def key_hash(key: Column | str, seed: str | int) -> Column:
    """Deterministic integer in [0, 2^32) per key and seed."""
    digest = F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


HASH_RANGE = 1 << 32


def hash_below(key: Column | str, seed: str | int, share: float) -> Column:
    """True for the given share of keys, independent of order and partitioning."""
    return key_hash(key, seed) < F.lit(int(share * HASH_RANGE))


def hash_unit(key: Column | str, seed: str | int) -> Column:
    return key_hash(key, seed).cast("double") / F.lit(float(HASH_RANGE))
