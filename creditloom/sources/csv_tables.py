"""CSV sources: declared types, known types by header, the set of seven tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.sources.schemas import DECLARED, FILES, KNOWN_TYPES, NAME_RULES

BYTE_ORDER_MARK = "﻿"


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """CSV with a header and declared types.

    Strict reading fails on a value that does not fit its type; otherwise the value becomes null.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", mode)
    return reader.schema(schema).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, without the byte order mark some writers put first."""
    names = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    return [name.removeprefix(BYTE_ORDER_MARK) for name in names]


def declared_types(
    names: Sequence[str], known: Mapping[str, list[str]], rules: Sequence[tuple[str, str]] = (), other: str | None = None
) -> dict[str, str]:
    """Type of every column: as listed in ``known``, else by the first of the ``rules`` (pattern, type), else ``other``.

    A column that nothing declares is an error unless ``other`` is given: a number taken for text would
    be coded as a category later on.
    """
    listed = {name.upper(): kind for kind, columns in known.items() for name in columns}

    def kind(name: str) -> str | None:
        by_rule = (kind for pattern, kind in rules if re.fullmatch(pattern, name.upper()))
        return listed.get(name.upper()) or next(by_rule, other)

    types = {name: kind(name) for name in names}
    if missing := [name for name, found in types.items() if found is None]:
        raise ValueError(f"no type is declared for the columns {missing}")
    return types


def read_known(
    spark: SparkSession, path: str, known: Mapping[str, list[str]], rules: Sequence[tuple[str, str]] = (), other: str | None = None
) -> DataFrame:
    """CSV whose types are looked up by column name, see :func:`declared_types`.

    The types come from a declaration, not from the data, so no extra pass is needed and a file of
    rare values cannot change them.
    """
    types = declared_types(header(spark, path), known, rules, other)
    return read_typed(spark, path, ", ".join(f"`{name}` {kind}" for name, kind in types.items()))


def infer(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types, for looking at an unknown file; costs a pass over it."""
    df = spark.read.option("header", True).option("inferSchema", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[name.removeprefix(BYTE_ORDER_MARK) for name in df.columns])


def range_report(df: DataFrame, bounds: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Rows outside the given inclusive bounds, per column."""
    row = df.agg(*[F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(c) for c, (low, high) in bounds.items()])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("out_of_range")) for c in bounds]
    return row.select(F.inline(F.array(*entries)))


def load_tables(
    spark: SparkSession, folder: str, views: bool = False, more: Mapping[str, Mapping[str, list[str]]] | None = None
) -> dict[str, DataFrame]:
    """The seven tables by name, columns in lower case; optionally also as temporary views.

    ``more`` declares columns that a user's files have besides the known ones: table -> type -> names.
    """
    tables = {}
    for name, file in FILES.items():
        path = f"{folder}/{file}"
        if name in DECLARED:
            raw = read_typed(spark, path, DECLARED[name])
        else:
            known = {kind: list(names) for kind, names in KNOWN_TYPES[name].items()}
            for kind, names in (more or {}).get(name, {}).items():
                known[kind] = [*known.get(kind, []), *names]
            raw = read_known(spark, path, known, NAME_RULES)
        tables[name] = raw.toDF(*[c.lower() for c in raw.columns])
        if views:
            tables[name].createOrReplaceTempView(name)
    return tables
