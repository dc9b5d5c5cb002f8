"""Running totals, quantiles and joins with one key owning a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.operators import joins as J
from creditloom.operators import ordered as O
from creditloom.plans import evaluate as E
from creditloom.plans import sequences as S
from tests.conftest import rows


def skewed(spark, n=900):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"),
        ((F.col("id") * 37) % 101).alias("o"),
    )


def test_running_totals_equal_a_window(spark):
    df = skewed(spark)
    got = O.running_totals(df, ["o", "id"], ["o"], ["k"])
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("o_before", F.coalesce(F.sum("o").over(w), F.lit(0)))
    assert rows(got, "id", "o_before") == rows(want, "id", "o_before")


def test_positions_without_keys(spark):
    got = O.positions(skewed(spark), ["o", "id"]).orderBy("o", "id").select("position").collect()
    assert [r[0] for r in got] == list(range(900))


@pytest.mark.parametrize("p", [0.0, 0.1, 0.4, 0.5, 0.8, 1.0])
def test_quantiles_equal_numpy(spark, p):
    df = skewed(spark)
    values = np.array([r.o for r in df.collect()])
    assert O.quantiles(df, "o", {"q": p}).first().q == pytest.approx(np.percentile(values, p * 100))


@pytest.mark.parametrize("accuracy", [20, 60])
def test_quantiles_from_brackets(spark, accuracy):
    """Groups large enough for brackets of their own, ties on the ranks, extreme values, and a small and an empty group."""
    rng = np.random.default_rng(accuracy)
    groups = {"wide": rng.normal(size=4000), "ties": rng.integers(0, 3, 3000) * 1.0, "one": np.full(2500, 7.0),
              "few": rng.normal(size=5), "far": np.concatenate([rng.normal(size=1500), [1e300, -1e300]])}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    probs = {"low": 0.0, "q10": 0.1, "q50": 0.5, "q77": 0.77, "high": 1.0}
    got = {r.g: [r[n] for n in probs] for r in O.quantiles(df, "v", probs, ["g"], accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, list(probs.values())), rel=1e-12)
    wide = df.where("g = 'wide'")
    assert O.quantiles(wide, "v", {"q": 0.3}, accuracy=accuracy).first().q == pytest.approx(np.quantile(groups["wide"], 0.3))
    assert O.quantiles(df.where("v is null"), "v", {"q": 0.3}).collect() == [(None,)]


def test_only_bracket_members_are_ordered(spark, monkeypatch):
    seen = []
    whole = O.running_totals
    monkeypatch.setattr(O, "running_totals", lambda df, *more: seen.append(df.count()) or whole(df, *more))
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("v"))
    assert O.quantiles(df, "v", {"q": 0.5}, accuracy=500).first().q == 24999.5
    assert seen[0] < 50_000 * 2 * (O.BRACKET + 2) / 500


def test_lookup_join_equals_plain_join(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("id") % 10 != 1, F.col("k")))
    lookup = spark.range(0, 12).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    for how in ("inner", "left"):
        assert rows(J.lookup_join(df, lookup, "k", how), "id", "k", "twice") == rows(
            df.join(lookup, "k", how), "id", "k", "twice")


def test_sized_join_beyond_the_limit(spark, monkeypatch):
    df, lookup = skewed(spark), spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    small = rows(J.sized_join(df, lookup, "k"), "id", "t")
    monkeypatch.setattr(J, "BROADCAST_ROWS", 3)
    assert not J._is_small(lookup) and rows(J.sized_join(df, lookup, "k"), "id", "t") == small


@pytest.mark.parametrize("kind", ["long", "string"])
def test_no_hot_key_is_missed(spark, kind):
    """Keys of falling frequency over many cold ones, in unfavourable order; keys are not exchanged to be counted."""
    rng = np.random.default_rng(12)
    keys = np.concatenate([np.repeat(np.arange(60), 4000 // np.arange(1, 61)), np.arange(1000, 40000)])
    shuffled = np.concatenate([keys[keys >= 1000], rng.permutation(keys)])
    df = spark.createDataFrame([(int(k),) for k in shuffled] + [(None,)] * 3000, "k long").select(F.col("k").cast(kind)).repartition(9)
    n, share = len(shuffled) + 3000, 0.002
    counts = dict(zip(*np.unique(shuffled, return_counts=True)))
    found = J.key_counts(df, ["k"], share)
    got = {int(r.k): r.n__ for r in found.collect()}
    for k, count in counts.items():
        if count > share * n:
            assert abs(got[k] - count) < share * n / 2
    assert all(abs(count - counts[k]) < share * n / 2 for k, count in got.items())
    assert "hashpartitioning(k" not in found._jdf.queryExecution().executedPlan().toString()
    salted = {int(r.k) for r in J.salted_keys(df, ["k"]).collect()}
    assert salted >= {k for k, count in counts.items() if count > share * n}
    assert salted <= {k for k, count in counts.items() if count > share * n / 4}


def test_keys_of_other_types_are_counted(spark):
    df = spark.range(300).select(F.array((F.col("id") % 3)).alias("k"), (F.col("id") % 2).alias("l"))
    assert {tuple(r.k): (r.n__, r.total__) for r in J.key_counts(df, ["k"], 0.1).collect()} == {(i,): (100, 300) for i in range(3)}
    assert {(tuple(r.k), r.l): r.n__ for r in J.key_counts(df, ["k", "l"], 0.1).collect()} == {((i,), j): 50 for i in range(3) for j in range(2)}


def test_hot_keys_are_few(spark):
    assert rows(J.hot_keys(skewed(spark), ["k"], 0.3)) == [(0,)]


def test_auc_ties_count_one_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert E.roc_auc(df, "s", "y").first().auc == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert E.roc_auc(df.where("y = 1"), "s", "y").first().auc is None


def test_auc_equals_pairwise(views):
    data = views.scores.collect()
    pos = np.array([r.score for r in data if r.target == 1])
    neg = np.array([r.score for r in data if r.target == 0])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert E.roc_auc(views.scores, "score", "target").first().auc == pytest.approx(want)


def test_tiers_are_strict_and_sized(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("s"))
    tiers = {r.s: r.risk_level for r in E.risk_tiers(df, "s").collect()}
    assert tiers[40.0] == 0 and tiers[41.0] == 1 and tiers[80.0] == 1 and tiers[81.0] == 2


def test_sequences_chunk_and_pad(spark):
    df = spark.createDataFrame([(1, 3, 30.0), (1, 1, 10.0), (1, 2, 20.0), (2, 9, 90.0)], "k long, t long, x double")
    found = {(r.k, r.chunk): (r.n_steps, r.length, r.padding, [s.x for s in r.steps])
             for r in S.sequences(df, "k", ["t"], ["x"], 2).collect()}
    assert found == {(1, 0): (2, 3, 0, [10.0, 20.0]), (1, 1): (1, 3, 0, [30.0]), (2, 0): (1, 3, 2, [90.0])}


@pytest.mark.parametrize("bound", [1, 60, 10_000])
def test_sequences_on_either_side_of_the_bound(spark, bound):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 4 != 0, F.col("id"))).unionByName(
        spark.createDataFrame([(901, None, 3, 1)], "id long, k long, o long, v long"))
    labels = df.where("k is not null").select("k").distinct().where("k <> 5").withColumn("name", F.concat(F.lit("n"), "k"))
    got = S.sequences(df, "k", ["o", "id"], ["v", "id"], 7, labels, bound).collect()
    whole = {}
    for r in df.where("k is not null and k <> 5").orderBy("o", "id").collect():
        whole.setdefault(r.k, []).append((r.v, r.id))
    most = max(map(len, whole.values()))
    want = {(k, c): (f"n{k}", [(c * 7 + i, *x) for i, x in enumerate(rows_[c * 7:c * 7 + 7])], most, most - len(rows_) if (c + 1) * 7 >= len(rows_) else 0)
            for k, rows_ in whole.items() for c in range(-(-len(rows_) // 7))}
    assert {(r.k, r.chunk): (r.name, [tuple(s) for s in r.steps], r.length, r.padding) for r in got} == want
    assert all(r.n_steps == len(r.steps) for r in got)
    none = S.sequences(df.where("id < 0"), "k", ["o"], ["v"], 7, bound=bound)
    assert none.collect() == [] and dict(none.dtypes)["n_steps"] == "bigint"
