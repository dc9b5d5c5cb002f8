"""Expressions on ``array<float>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.columns import safe_ratio


def _vec(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("array<double>")


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(_vec(left), _vec(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column | str) -> Column:
    squares = F.aggregate(_vec(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def normalise(vector: Column | str) -> Column:
    """Unit vector; every element is null for a zero vector."""
    length = norm(vector)
    return F.transform(_vec(vector), lambda x: F.try_divide(x, length))


def cosine(left: Column | str, right: Column | str) -> Column:
    """Null when either side is a zero vector."""
    return safe_ratio(dot(left, right), norm(left) * norm(right))


def blend(own: Column | str, other: Column | str, alpha: float = 0.5) -> Column:
    """``alpha * own + (1 - alpha) * other`` element by element."""
    return F.zip_with(_vec(own), _vec(other), lambda a, b: a * F.lit(alpha) + b * F.lit(1.0 - alpha))


def mean_over(values: Column | str) -> Column:
    """Mean of an array; null for an empty one."""
    v = _vec(values)
    return safe_ratio(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v))


def pad_to(values: Column, length: Column | int, fill: Column) -> Column:
    """Array extended with ``fill`` up to ``length``; longer arrays stay as they are."""
    missing = F.greatest(F.lit(length) - F.size(values) if isinstance(length, int) else length - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(fill, missing))

