"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.operators.grouped import window_features
from creditloom.plans import families as fam
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


FEATURE_QUERIES = [n for n in entry.queries() if n[0] in "pa" or n.startswith(("j1", "j2", "j3", "g2", "g7", "t10", "t11"))]


@pytest.mark.parametrize("name", FEATURE_QUERIES)
def test_no_python_and_no_cross_product(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    for word in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_windows_scan_their_table_once(views):
    text = plan(window_features(views.prev, fam.KEY, fam.PREV_SPEC, fam.prev_windows(), fam.derive_prev))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_is_needed(spark):
    text = plan(entry.queries()["s4_deferred_scan"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_star_join_adds_no_exchange_for_the_features(spark, views):
    """Features are already placed by applicant: only the applicants themselves are exchanged for the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features = window_features(views.prev, fam.KEY, fam.PREV_SPEC, fam.prev_windows(), fam.derive_prev)
        more = window_features(views.card, fam.KEY, fam.CARD_SPEC, fam.card_windows(), fam.derive_card)
        text = plan(fam.assemble(views.app, [features, more]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(sk_id_curr") == 3


def test_top_values_are_trimmed_before_the_exchange(views):
    from creditloom.plans import explain as X

    assert "WindowGroupLimit" in plan(X.top_per_node(views.attr))


def test_windows_over_everything_only_on_partition_totals(views):
    """Without keys the only unpartitioned window is the one over one row per partition."""
    from creditloom.operators.ordered import running_totals

    df = views.scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    text = plan(running_totals(df, ["score"], ["n"]))
    assert text.count("Exchange SinglePartition") == 1
