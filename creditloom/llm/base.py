"""What the operators share: table access, stored intermediate tables, and row identity."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import checkpointed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing names any more deleted.

    Spark deletes them when the driver collects the objects that name them; asking for it between the steps of a
    long job keeps its disk need near that of its largest step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; what earlier steps left is freed before and after."""
    free(df.sparkSession)
    done = checkpointed(df)
    free(df.sparkSession)
    return done


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_key(text: Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, so that joins can't mix up names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(True)]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``like`` from its packed form; with a new ``text``, ``n_chars`` follows it if there."""
    text = F.col("text") if text is None else text
    out = []
    for c in like.columns:
        value = F.col("doc_id") if c == "doc_id" else F.col(f"row.`{c}`")
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(text.eqNullSafe(F.col("text")), value).otherwise(F.length(text).cast(like.schema[c].dataType))
        out.append(value.alias(c))
    return df.select(*out)
