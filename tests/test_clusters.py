"""K-means with joint starts against direct computations."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from creditloom.plans import clusters as K


def table(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a array<double>").repartition(5)
    return df.select("k", array_to_vector("a").alias("v"))


def blobs(seed, n=40, groups=6, width=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, width)) * 0.05 + 5 * rng.normal(size=width) for _ in range(groups)])


def test_far_groups_are_found(spark):
    x = blobs(1)
    df = table(spark, x)
    found = K.fit_starts(df, "v", 6, 4, 7)
    got = {r.k: r.cluster for r in found.assign(df, "k").collect()}
    assert [len({got[g * 40 + i] for i in range(40)}) for g in range(6)] == [1] * 6 and len(set(got.values())) == 6
    cost = sum(((x[g * 40:g * 40 + 40] - x[g * 40:g * 40 + 40].mean(0)) ** 2).sum() for g in range(6))
    assert found.trainingCost == pytest.approx(cost)


def test_centres_are_means_and_starts_are_independent(spark):
    x = np.random.default_rng(2).normal(size=(500, 4))
    df = table(spark, x)
    found = K.fit_starts(df, "v", 9, 3, 11, max_iterations=200)
    own = np.array([r.cluster for r in found.assign(df, "k").orderBy("k").collect()])
    far = ((x[:, None, :] - found.centres[None]) ** 2).sum(2)
    assert (own == far.argmin(1)).all() and found.trainingCost == pytest.approx(far.min(1).sum())
    for c in range(9):
        assert x[own == c].mean(0) == pytest.approx(found.centres[c], abs=1e-3)
    alone = [K.fit_starts(df, "v", 9, 1, 11 + i, max_iterations=200).trainingCost for i in range(3)]
    assert list(found.costs) == pytest.approx(alone) and found.trainingCost == min(found.costs)
    again = K.fit_starts(df.repartition(3), "v", 9, 3, 11, max_iterations=200)
    assert again.costs == pytest.approx(found.costs)


def test_few_rows_and_copies(spark):
    copies = table(spark, [[1.0, 2.0]] * 50 + [[3.0, 4.0]] * 30)
    found = K.fit_starts(copies, "v", 5, 2, 1)
    assert found.trainingCost == pytest.approx(0.0, abs=1e-12)
    assert len({r.cluster for r in found.assign(copies, "k").collect()}) == 2
    same = table(spark, [[1.0, 2.0]] * 3)
    assert {r.cluster for r in K.fit_starts(same, "v", 5, 2, 1).assign(same, "k").collect()} == {0}
    with pytest.raises(ValueError):
        K.fit_starts(same.where("k < 0"), "v", 5, 2, 1)


def test_a_pass_is_one_stage_and_large_sums_are_added_in_tasks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 3))
    rows = [([float(v) for v in row], 1 + i % 3) for i, row in enumerate(x)]
    points = spark.createDataFrame(rows, "x array<double>, n long").cache()
    points.count()
    centres = {0: x[:4], 2: x[7:9]}
    context = spark.sparkContext

    def stages(name, found):
        context.setJobGroup(name, name)
        out = found()
        jobs = context.statusTracker().getJobIdsForGroup(name)
        context.setLocalProperty("spark.jobGroup.id", None)
        return out, sum(len(context.statusTracker().getJobInfo(j).stageIds) for j in jobs)

    direct, few = stages("direct", lambda: K._partial_sums(points, centres, 8))
    monkeypatch.setattr(K, "DIRECT_BYTES", 0)
    added, more = stages("added", lambda: K._partial_sums(points, centres, 8))
    times = np.array([n for _, n in rows], dtype=float)
    for i, c in centres.items():
        assert (direct[i] == added[i]).all()
        far = ((x[:, None, :] - c[None]) ** 2).sum(2)
        for k in range(len(c)):
            own = far.argmin(1) == k
            assert direct[i][k, :3] == pytest.approx((x[own] * times[own, None]).sum(0))
            assert direct[i][k, 3] == times[own].sum() and direct[i][k, 4] == pytest.approx((far[own, k] * times[own]).sum())
    # Before, each pass had an exchange and a second stage.
    assert few == 1 < more
