"""Windows of a table: every route and both formulations agree."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators import grouped as G
from creditloom.plans import families as fam
from tests.conftest import rows

SPEC = {"k": ["count"], "x": ["min", "max", "mean", "sum"], "v": ["nunique"]}


def windows():
    return [G.Window("a_"), G.Window("r_", F.col("d") > -10)]


def plain(v):
    return None if v is None else round(v, 9) if isinstance(v, float) else v


def as_dicts(df):
    return {r["k"]: {c: plain(r[c]) for c in df.columns} for r in df.collect()}


def sample(spark):
    # A third of the rows belong to key 0; nulls in the key, the value and the counted column.
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 64) / 8).cast("double").alias("x"),
        F.when(F.col("id") % 13 == 0, None).otherwise(F.col("id") % 5).alias("v"),
        (-(F.col("id") * 7 % 60)).alias("d"),
    )
    return df


@pytest.fixture
def every_route(monkeypatch):
    """Makes small tables take the uncombined route with a split for hot keys."""
    monkeypatch.setattr(G, "LOOK", G.Look(share=1.0, min_rows=1, hot_share=0.1))


def test_windows_equal_joined_windows(spark):
    df = sample(spark)
    assert as_dicts(G.window_features(df, "k", SPEC, windows())) == as_dicts(G.joined_windows(df, "k", SPEC, windows()))


def test_hot_route_equals_plain_route(spark, every_route):
    df = sample(spark)
    hot, uncombined = G._routes(df.where("k is not null"), "k", G.LOOK)
    assert hot == [0] and uncombined
    routed = as_dicts(G.window_features(df, "k", SPEC, windows()))
    assert routed == as_dicts(G._aggregate(df.where("k is not null"), "k", SPEC, windows()))
    assert None not in routed


def test_families_on_the_uncombined_route(views, every_route):
    spec, key = fam.INST_SPEC, fam.KEY
    routed = G.window_features(views.inst, key, spec, fam.inst_windows(), fam.derive_inst)
    joined = G.joined_windows(views.inst, key, spec, fam.inst_windows(), fam.derive_inst)
    columns = [c for c in routed.columns if "ratio" not in c]
    assert rows(routed, *columns) == rows(joined, *columns)


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0)], "k long, x double")
    spec = {"x": ["sum", "mean", "min", "max", "count", "std"]}
    found = {r.k: tuple(r)[1:] for r in G.grouped_features(df, "k", spec).collect()}
    assert found == {1: (0.0, None, None, None, 0, None), 2: (5.0, 5.0, 5.0, 5.0, 1, None)}


def test_empty_window_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 0, -50), (2, 1.0, 0, 0)], "k long, x double, v int, d int")
    found = as_dicts(G.window_features(df, "k", SPEC, windows()))
    assert all(found[1][c] is None for c in G.feature_names(SPEC, "r_"))
    assert found[2]["r_k_count"] == 1


def test_std_in_windows(spark):
    spec = {"x": ["std", "mean"], "v": ["nunique"]}
    df = sample(spark)
    assert as_dicts(G.window_features(df, "k", spec, windows())) == as_dicts(G.joined_windows(df, "k", spec, windows()))
