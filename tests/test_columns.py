"""Null, zero and edge rules of the derived columns."""

import math

from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.functions import vectors as V
from creditloom.plans import families as fam


def one(spark, values, schema, *expressions):
    return tuple(spark.createDataFrame([values], schema).select(*expressions).first())


def test_zero_denominators_give_null(spark):
    got = one(spark, (1.0, 0.0, 0.0), "a double, b double, c double",
              C.safe_ratio("a", "b"), C.safe_ratio("b", "c"), C.implied_rate("a", "b", "a"))
    assert got == (None, None, None)


def test_row_statistics_skip_nulls(spark):
    mean, std, sample_of_one = one(
        spark, (1.0, None, 3.0), "a double, b double, c double",
        C.row_mean(["a", "b", "c"]), C.row_std(["a", "b", "c"]), C.row_std(["a", "b"]))
    assert mean == 2.0 and math.isclose(std, math.sqrt(2)) and sample_of_one is None
    assert one(spark, (None, None), "a double, b double", C.row_mean(["a", "b"]), C.row_std(["a", "b"])) == (None, None)


def test_flags_are_zero_on_null(spark):
    flags = C.dpd_flags(F.col("d"), "")
    assert one(spark, (None,), "d int", *flags.values()) == (0, 0, 0)
    assert one(spark, (120,), "d int", *flags.values()) == (1, 0, 1)
    assert one(spark, (119,), "d int", *flags.values()) == (1, 1, 0)


def test_fill_with_mean(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k int, x double")
    assert sorted(r.x for r in fam.fill_with_mean(df, "x").collect()) == [2.0, 3.0, 4.0]


def test_zero_vector_has_no_cosine(spark):
    assert one(spark, ([0.0, 0.0], [1.0, 0.0]), "a array<double>, b array<double>", V.cosine("a", "b")) == (None,)


def test_status_pivot_keeps_both_columns(spark):
    prev = spark.createDataFrame([(1, "Approved"), (1, "Approved"), (2, "Canceled")], "sk_id_curr long, name_contract_status string")
    assert [tuple(r) for r in fam.status_counts(prev).collect()] == [(1, 2, 0)]
    shares = {r.sk_id_curr: (r.prev_refused_ratio, r.prev_approved_ratio) for r in fam.status_ratios(prev).collect()}
    assert shares == {1: (0.0, 1.0), 2: (None, None)}


def test_orphan_months_are_dropped(spark):
    bureau = spark.createDataFrame([(1, 10)], "sk_id_curr long, sk_id_bureau long")
    months = spark.createDataFrame([(10, -1, "5"), (10, -2, "C"), (99, -1, "1")], "sk_id_bureau long, months_balance int, status string")
    found = fam.bureau_balance_features(bureau, months).collect()
    assert len(found) == 1
    assert found[0].bureau_bal_sk_id_curr_count == 2 and found[0].bureau_bal_bureau_bal_is_dpd_over120_sum == 1


def test_family_sizes():
    from creditloom.operators.grouped import feature_names

    sizes = [len(feature_names(s, "")) for s in (
        fam.PREV_SPEC, fam.BUREAU_SPEC, fam.BUREAU_BAL_SPEC, fam.POS_SPEC, fam.INST_SPEC, fam.CARD_SPEC)]
    assert sizes == [39, 46, 8, 22, 29, 34]


def test_feature_table_width(views):
    tables = {n: getattr(views, n) for n in ("app", "prev", "bureau", "bureau_bal", "pos", "inst", "card")}
    wide = fam.feature_table(tables)
    assert len(wide.columns) - len(views.app.columns) == 13 + 398
    assert len(set(wide.columns)) == len(wide.columns)


def test_nulls_stay_null_under_limits_and_out_of_the_loss(spark):
    from creditloom.plans import evaluate as E

    df = spark.createDataFrame([(1, 0.25), (0, 0.5), (None, 0.5), (1, None)], "target int, score double")
    clamped = df.select(C.clamp(F.col("score"), 0.3, 0.4).alias("x"))
    assert sorted(r.x for r in clamped.collect() if r.x is not None) == [0.3, 0.4, 0.4]
    loss = E.log_loss(df, "score", "target").first()[0]
    assert abs(loss - (-math.log(0.25) - math.log(0.5)) / 2) < 1e-9
