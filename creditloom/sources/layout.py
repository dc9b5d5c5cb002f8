"""Feature families stored by applicant, so that the star join moves nothing.

Every family is written as a table bucketed and sorted by the key, one file a bucket, all with one number of buckets.
Joining them is then a merge of equal buckets: neither side is exchanged, however many families there are and however
often they are read. A family can be written again alone; the join reads the version that its layout row names, and
readers of an older version are left in peace.

The number of buckets follows the rows of the first family stored (``ROWS_PER_BUCKET``), and later families take it over.
Layout rows and data lie in one folder that all executors share; another session opens the same folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET = 500_000
LAYOUT = "family string, path string, key string, buckets int, columns string"


def _layout(spark: SparkSession, folder: str) -> dict:
    """Layout rows by family: as many as there are families."""
    try:
        return {row.family: row for row in spark.read.schema(LAYOUT).parquet(f"{folder}/layout/*.parquet").collect()}
    except AnalysisException:
        return {}


def _table_name(path: str) -> str:
    return f"family_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def store_family(df: DataFrame, folder: str, family: str, key: str, buckets: int | None = None) -> None:
    """Write ``df`` as the current version of a family.

    ``buckets`` is only for the first one: with another number than the folder has, the families could not be merged.
    """
    spark = df.sparkSession
    known = {row.buckets for row in _layout(spark, folder).values()}
    if known and buckets not in (None, *known):
        raise ValueError(f"the families of {folder} have {known.pop()} buckets, not {buckets}")
    buckets = known.pop() if known else buckets or max(1, -(-df.count() // ROWS_PER_BUCKET))
    path = f"{folder}/data/{family}/{uuid.uuid4().hex}"
    # Bucketing hashes as repartition does, so each task writes the one file of its bucket.
    placed = df.repartition(buckets, key)
    placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_table_name(path))
    columns = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    row = spark.createDataFrame([(family, path, key, buckets, columns)], LAYOUT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout/{family}.parquet")


def families(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The current version of every family, by name."""
    tables = {}
    for family, row in _layout(spark, folder).items():
        name = _table_name(row.path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({row.columns}) USING parquet "
            f"CLUSTERED BY (`{row.key}`) SORTED BY (`{row.key}`) INTO {row.buckets} BUCKETS LOCATION '{row.path}'"
        )
        tables[family] = spark.table(name)
    return tables


def store_families(tables: Mapping[str, DataFrame], folder: str, key: str, buckets: int | None = None) -> None:
    """Write several families; the first one sets the number of buckets."""
    for family, df in tables.items():
        store_family(df, folder, family, key, buckets)


def merged(spark: SparkSession, folder: str, base: str, key: str, others: list[str] | None = None) -> DataFrame:
    """``base`` with the other families (all, by name) joined on from the left, bucket by bucket."""
    tables = families(spark, folder)
    result = tables[base]
    for family in others if others is not None else sorted(set(tables) - {base}):
        result = result.join(tables[family].hint("merge"), key, "left")
    return result
