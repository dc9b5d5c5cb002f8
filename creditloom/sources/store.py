"""Stored results: the outputs of a run per epoch, and cluster assignments that can be reused."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Parts of a run. Only the embeddings must be there.
PARTS = {
    "embeddings": "sk_id BIGINT, embedding ARRAY<FLOAT>, cluster INT",
    "risk_levels": "sk_id BIGINT, risk_level INT",
    "attributions": "sk_id BIGINT, cluster INT, risk_level INT, feature STRING, value DOUBLE",
}


def save_run(parts: Mapping[str, DataFrame], folder: str, run: str, epoch: int) -> None:
    """Write the given parts under (run, epoch); every row carries its key, so order is irrelevant."""
    unknown = set(parts) - set(PARTS)
    if unknown or "embeddings" not in parts:
        raise ValueError(f"parts must include embeddings and be among {sorted(PARTS)}")
    for name, df in parts.items():
        columns = [field.name for field in _schema(name)]
        df.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/run={run}/epoch={epoch}")


def _schema(name: str) -> StructType:
    return StructType.fromDDL(PARTS[name])


def load_run(spark: SparkSession, folder: str, run: str, epoch: int) -> dict[str, DataFrame]:
    """All parts of an epoch; an optional part that was not saved is an empty table."""
    loaded = {}
    for name in PARTS:
        schema = _schema(name)
        try:
            df = spark.read.schema(schema).parquet(f"{folder}/{name}/run={run}/epoch={epoch}")
        except AnalysisException:
            if name == "embeddings":
                raise
            df = spark.createDataFrame([], schema)
        loaded[name] = df
    return loaded


def load_epochs(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """One part over all runs and epochs, with ``run`` and ``epoch`` as partition columns."""
    return spark.read.parquet(f"{folder}/{part}")


def assignment_id(features: Sequence[str], clusters: int, seed: int) -> str:
    """Name of a cluster assignment: it is only reused for the same columns, size and seed."""
    text = json.dumps([sorted(features), clusters, seed])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def stored_clusters(
    rows: DataFrame, key: str, folder: str, name: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """``rows`` with their cluster, computed once and joined by key afterwards.

    A row the stored assignment does not know has a null cluster.
    """
    spark, path = rows.sparkSession, f"{folder}/clusters/{name}"
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        compute().select(key, F.col("cluster").cast("int")).write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return rows.join(stored, key, "left")
