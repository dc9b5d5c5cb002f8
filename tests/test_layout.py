"""Stored feature families: the join's plan, refreshing one family, opening them in another session."""

import pytest
from pyspark.sql import functions as F

from creditloom.plans import families as fam
from creditloom.session import fresh_path
from creditloom.sources import layout
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark):
    keys = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("a"))
    return {"base": keys.unionByName(spark.createDataFrame([(None, 1)], "k long, a long")),
            "left": keys.where("k % 3 = 0").select("k", (F.col("a") * 2).alias("b")),
            "right": keys.where("k % 5 = 0").select("k", F.concat(F.lit("t"), "a").alias("c"))}


def test_join_without_exchange(spark):
    folder, tables = fresh_path(spark, "layout"), sides(spark)
    layout.store_families(tables, folder, "k", 6)
    got = layout.merged(spark, folder, "base", "k")
    plan = plan_of(got)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    want = tables["base"].join(tables["left"], "k", "left").join(tables["right"], "k", "left")
    assert rows(got) == rows(want) and got.rdd.getNumPartitions() == 6


def test_feature_table_without_exchange(spark, views):
    folder = fresh_path(spark, "layout")
    fam.store_features({n: getattr(views, n) for n in ("app", "prev", "bureau", "bureau_bal", "pos", "inst", "card")}, folder)
    plan = plan_of(fam.stored_feature_table(spark, folder))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 5


def test_one_family_again(spark):
    folder, tables = fresh_path(spark, "layout"), sides(spark)
    layout.store_families(tables, folder, "k", 4)
    before = layout.families(spark, folder)["left"]
    layout.store_family(tables["left"].withColumn("b", F.col("b") + 1), folder, "left", "k")
    assert rows(layout.families(spark, folder)["left"], "b") == rows(tables["left"].select(F.col("b") + 1))
    assert rows(before) == rows(tables["left"])  # who reads the old version goes on
    assert "Exchange" not in plan_of(layout.merged(spark, folder, "base", "k"))
    with pytest.raises(ValueError):
        layout.store_family(tables["left"], folder, "left", "k", 5)


def test_another_session(spark):
    folder, tables = fresh_path(spark, "layout"), sides(spark)
    layout.store_families(tables, folder, "k")
    name = layout._table_name(layout._layout(spark, folder)["left"].path)
    spark.sql(f"DROP TABLE {name}")  # what another session's catalog doesn't know
    got = layout.families(spark, folder)["left"]
    assert rows(got) == rows(tables["left"]) and "Exchange" not in plan_of(layout.merged(spark, folder, "base", "k"))
