"""Properties of codes, scaling, sampling, fitting and stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import joins as J
from creditloom.plans import evaluate as E
from creditloom.plans import explain as X
from creditloom.plans import learn as L
from creditloom.plans import prepare as P
from creditloom.plans import profile as R
from creditloom.sources import csv_tables as CSV
from creditloom.sources import schemas, store
from creditloom.session import fresh_path
from tests.conftest import rows

FEATURES = ["amt_income_total", "amt_credit", "amt_annuity", "days_birth"]


def test_factorise_null_and_unknown(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    book = P.factorise(df, ["c"])
    other = spark.createDataFrame([("a",), ("b",), (None,), ("new",)], "c string")
    assert [r[0] for r in book.apply(other).collect()] == [0, 1, -1, None]


CODED = "k int, c string, n double, `n=` string"


def coded_rows(n=60):
    values = [0.0, -0.0, float("nan"), 1.5, None]
    return [(i, "ab"[i % 2] if i % 5 else None, values[i % 5], f"v{i % 7}" if i % 3 else "=") for i in range(n)]


def joins_in(plan):
    """Join nodes of a plan, those of its subqueries left out."""
    children = plan.children()
    return (plan.nodeName() == "Join") + sum(joins_in(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("most", [0, 3, 100], ids=["melted", "both", "mapped"])
def test_code_books_by_any_route(spark, monkeypatch, most):
    monkeypatch.setattr(P, "MAP_CODES", most)
    # Repeated rows stay, and rows the book doesn't know get null.
    df = spark.createDataFrame(coded_rows() + coded_rows(10), CODED)
    other = df.unionByName(spark.createDataFrame([(99, "zz", 7.0, "")], CODED))
    book = P.offset_codes(df, ["c", "n", "n="]) if most else P.factorise(df, ["c", "n", "n="])
    assert len(book.small) == {0: 0, 3: 1, 100: 3}[most]
    labels = [sorted({x for _, x, _, _ in coded_rows() if x is not None}), ["0.0", "1.5", "nan"], sorted({x for *_, x in coded_rows()})]
    nulls, starts, start = [True, True, False], [], 0
    for part, has in zip(labels, nulls):
        starts.append(start if most else 0)
        start += len(part) + has

    def code(at, x):
        if x is None:
            return starts[at] + len(labels[at]) if most else -1
        text = str(abs(x)) if isinstance(x, float) else x
        return starts[at] + labels[at].index(text) if text in labels[at] else None

    want = [(k, code(0, c), code(1, n), code(2, v)) for k, c, n, v in coded_rows() + coded_rows(10) + [(99, "zz", 7.0, "")]]
    plain = lambda found: sorted((tuple(r) for r in found), key=str)
    applied = book.apply(other)
    assert applied.columns == df.columns and plain(applied.collect()) == plain(want)
    assert (joins_in(applied._jdf.queryExecution().optimizedPlan()) == 0) == (most == 100)


def test_one_join_for_any_number_of_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "MAP_CODES", 0)
    wide = spark.range(300).select("id", *[(F.col("id") * (i + 3) % 150).cast("string").alias(f"c{i}") for i in range(8)])
    joins = {}
    for n in (1, 8):
        columns = [f"c{i}" for i in range(n)]
        joins[n] = joins_in(P.factorise(wide, columns).apply(wide)._jdf.queryExecution().optimizedPlan())
    assert joins[1] == joins[8] > 0


def test_roles(spark):
    df = spark.range(200).select(
        F.col("id").alias("sk_id_curr"), F.lit(0).alias("target"), (F.col("id") % 50).alias("fifty"),
        F.when(F.col("id") % 60 != 0, F.col("id") % 50).alias("fifty_and_null"), F.lit(1).alias("x_ratio"),
        F.lit(1).alias("amt_credit"), F.col("id").cast("string").alias("many"))
    roles = P.choose_roles(df)
    assert roles.numeric == ["fifty_and_null", "x_ratio", "amt_credit", "many"] and roles.categorical == ["fifty"]


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (2.0, 3.0)], "x double, c double")
    assert rows(P.fit_minmax(df, ["x", "c"]).apply(df)) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    train, valid = P.split(df, "k")
    again = P.split(df.orderBy(F.col("k").desc()).repartition(5), "k")[1]
    assert train.count() + valid.count() == 20000 and train.join(valid, "k").count() == 0
    assert abs(valid.count() / 20000 - 0.1) < 0.01 and rows(valid) == rows(again)


@pytest.mark.parametrize("weight", [1.0, 3.0, 30.0])
def test_up_sample_rates(spark, weight):
    df = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    out = P.up_sample(df, "y", "k", weight)
    scale = 20000 / (19000 + 1000 * weight)
    assert abs(out.count() / 20000 - 1) < 0.06
    assert abs(out.where("y = 1").count() / (1000 * weight * scale) - 1) < 0.15


def test_down_sample_keeps_positives(views):
    out = P.down_sample(views.app, "target", "sk_id_curr", 0.3)
    assert out.where("target = 1").count() == views.app.where("target = 1").count()


def test_cluster_columns(spark):
    df = spark.createDataFrame([(0, i % 5 + 1, i) for i in range(100)], "zeros int, few int, many int")
    assert P.cluster_columns(df) == ["few"]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (0, 1.0, 0)], "target int, c double, x int")
    assert dict(R.label_correlations(df, "target").collect()) == {"c": None, "x": 1.0}


def test_key_overlap(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(J.key_overlap(left, right, "k").first()) == (2, 2, 1, 1, 1)


def test_synthetic_rows_lie_on_segments(views):
    app = views.app.withColumn("cluster", F.col("region") % 3)
    made = L.synthesise(app, "sk_id_curr", "target", FEATURES, "cluster", copied=["region"]).collect()
    sizes = dict(app.groupBy("target").count().collect())
    assert len(made) == round(0.429 * sizes[0]) - sizes[1]
    points = {r.sk_id_curr: r for r in app.collect()}
    for r in made:
        a, b = points[r.base], points[r.partner]
        assert a.target == b.target == 1 and a.cluster == b.cluster and r.region == a.region
        shares = {round((r[f] - a[f]) / (b[f] - a[f]), 6) for f in FEATURES if b[f] != a[f]}
        assert len(shares) <= 1 and all(0 <= s <= 1 for s in shares)
    assert len({r.sk_id_curr for r in made}) == len(made)
    both = L.rebalance(app, "sk_id_curr", "target", FEATURES, "cluster", copied=["region"])
    assert both.count() == sum(sizes.values()) + len(made)


def test_leaked_feature_scores_one_and_noise_a_half(spark):
    df = spark.range(4000).select(
        F.col("id").alias("k"), (F.hash("id") % 2 == 0).cast("int").alias("y"),
        (F.hash("id", F.lit(9)) % 1000).cast("double").alias("noise"))
    leaked = df.withColumn("leak", F.col("y") * 2.0)
    assert L.train_and_evaluate("logistic", leaked, "k", "y", ["leak"]).first().auc == 1.0
    assert abs(L.train_and_evaluate("logistic", df, "k", "y", ["noise"]).first().auc - 0.5) < 0.1


def test_linear_attributions_add_up(views):
    app = views.app
    fitted = L.train("logistic", app, "sk_id_curr", "target", FEATURES)
    weights, means = L.linear_parts(fitted, app)
    scaled = fitted.scaler.apply(app)
    sums = {r.sk_id: r.s for r in X.linear_attributions(scaled, "sk_id_curr", weights, means).groupBy("sk_id").agg(
        F.sum("value").alias("s")).collect()}
    logits = {r.sk_id_curr: np.log(r.score / (1 - r.score)) for r in fitted.score(app).collect()}
    centre = np.mean(list(logits.values()))
    assert all(abs(sums[k] - (logits[k] - centre)) < 1e-6 for k in sums)


def test_projection_and_reconstruction(views):
    table = L.assemble_vector(views.app, FEATURES).select("sk_id_curr", "features")
    full = L.fit_projection(table, "features", len(FEATURES)).apply(table)
    assert L.reconstruction_error(full).agg(F.max("error")).first()[0] < 1e-3
    x = np.array([r.features.toArray() for r in table.orderBy("sk_id_curr").collect()])
    part = L.fit_projection(table, "features", len(FEATURES), 2).apply(table)
    error = L.reconstruction_error(part).agg(F.avg("error")).first()[0]
    lost = np.linalg.svd(x - x.mean(0), compute_uv=False)[2:]
    assert error == pytest.approx((lost**2).sum() / x.size, rel=1e-6)


def test_more_clusters_cost_less(views):
    table = L.assemble_vector(P.fit_minmax(views.app, FEATURES).apply(views.app), FEATURES).select("features")
    costs = [L.fit_clusters(table, "features", k, 2).summary.trainingCost for k in (2, 6, 20)]
    assert costs[0] >= costs[1] >= costs[2]


def test_class_reduction(spark):
    df = spark.createDataFrame([(1, "a", 0, -2.0), (1, "a", 1, 2.0)], "sk_id long, feature string, class int, value double")
    assert rows(X.reduce_classes(df, 2), "value") == [(2.0,)] and rows(X.reduce_classes(df, 3), "value") == [(0.0,)]


def test_store_round_trip(spark, views):
    folder = fresh_path(spark, "store")
    store.save_run({"embeddings": views.nodes}, folder, "r", 5)
    parts = store.load_run(spark, folder, "r", 5)
    assert parts["embeddings"].count() == views.nodes.count() and parts["attributions"].count() == 0
    store.save_run({"embeddings": views.nodes.limit(3)}, folder, "r", 10)
    one = store.load_epochs(spark, folder, "embeddings").where("epoch = 10")
    assert one.count() == 3 and "PartitionFilters: [isnotnull(epoch" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        store.save_run({"risk_levels": views.nodes}, folder, "r", 1)


def test_clusters_are_computed_once(spark, views):
    folder, calls = fresh_path(spark, "reuse"), []

    def compute():
        calls.append(1)
        return views.app.select("sk_id_curr", (F.col("sk_id_curr") % 4).alias("cluster"))

    first = store.stored_clusters(views.app, "sk_id_curr", folder, "x", compute)
    second = store.stored_clusters(views.app, "sk_id_curr", folder, "x", compute)
    assert len(calls) == 1 and rows(first, "sk_id_curr", "cluster") == rows(second, "sk_id_curr", "cluster")
    assert store.assignment_id(["a", "b"], 8, 1) == store.assignment_id(["b", "a"], 8, 1) != store.assignment_id(["a"], 8, 1)


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "POS.csv"
    path.write_text("﻿SK_ID_PREV,SK_ID_CURR,NAME\n1,2,x\n3,-4,y\n", encoding="utf-8")
    with pytest.raises(ValueError, match="NAME"):
        CSV.read_known(spark, str(path), {"BIGINT": ["SK_ID_PREV", "SK_ID_CURR"]})
    df = CSV.read_known(spark, str(path), {"BIGINT": ["SK_ID_PREV", "SK_ID_CURR"]}, other="STRING")
    assert df.dtypes == [("SK_ID_PREV", "bigint"), ("SK_ID_CURR", "bigint"), ("NAME", "string")]
    assert CSV.infer(spark, str(path)).columns == df.columns
    assert rows(CSV.range_report(df, {"SK_ID_PREV": schemas.UINT32, "SK_ID_CURR": schemas.UINT32})) == [
        ("SK_ID_CURR", 1), ("SK_ID_PREV", 0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("A\n1\nabc\n")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("A INT")
    assert rows(CSV.read_typed(spark, str(bad), schema, strict=False).where("A is not null")) == [(1,)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        CSV.read_typed(spark, str(bad), schema).collect()


def test_tier_shares(views):
    shares = {r.risk_level: r.percent for r in E.tier_distribution(E.risk_tiers(views.scores, "score")).collect()}
    assert abs(shares[0] - 40) < 3 and abs(shares[1] - 40) < 3 and abs(shares[2] - 20) < 3
