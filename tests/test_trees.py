"""Tree tables, exact Shapley values and certificates, on models of a few features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from creditloom.plans import learn as L
from creditloom.plans import trees as TR

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=400) > 0.2).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double, y int").repartition(5).persist()


def fitted(table, name, **settings):
    return L.train(name, table, "k", "y", FEATURES, **settings)


def worth(tree, node, x, known):
    """Expected value of a tree when only some features are known, by walking it."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return worth(tree, left if x[f] <= tree.threshold[node] else right, x, known)
    return sum(tree.rows[c] / tree.rows[node] * worth(tree, c, x, known) for c in (left, right))


@pytest.mark.parametrize("name", ["tree", "forest", "boosted"])
def test_shapley_values_by_all_subsets(table, name):
    settings = {} if name == "tree" else {"numTrees": 4} if name == "forest" else {"maxIter": 4}
    model = fitted(table, name, **settings)
    forest = TR.read_forest(model, table)
    few = table.where("k < 12")
    got = {}
    for r in TR.attributions(forest, few).collect():
        got.setdefault(r.sk_id, {})[r.feature] = r.value
    x = {r.key: np.array(r.x) for r in TR.prepared(model, few).collect()}
    for key, row in x.items():
        v = {s: sum(t.weight * worth(t, 0, row, s) for t in forest.trees) for m in range(6) for s in map(frozenset, combinations(range(5), m))}
        for f, feature in enumerate(FEATURES):
            want = sum(factorial(len(s)) * factorial(4 - len(s)) / factorial(5) * (v[s | {f}] - v[s]) for s in v if f not in s)
            assert got[key].get(feature, 0.0) == pytest.approx(want, abs=1e-12)
        assert sum(got[key].values()) + forest.base == pytest.approx(forest.margin(row[None, :])[0])
        assert forest.base == pytest.approx(v[frozenset()])


@pytest.mark.parametrize("name", ["tree", "forest", "boosted"])
def test_scores_and_certificate(table, name):
    model = fitted(table, name)
    forest = TR.read_forest(model, table)
    theirs = {r.k: r.score for r in model.score(table).collect()}
    ours = {r.k: r.score for r in TR.margins(forest, table).collect()}
    assert ours == pytest.approx(theirs, abs=1e-12)
    assert max(TR.tree_certificate(forest, table).values()) < 1e-9


@pytest.mark.parametrize("name", ["tree", "boosted"])
def test_certificate_sees_other_rows_and_other_trees(table, name):
    forest = TR.read_forest(fitted(table, name), table)
    assert TR.tree_certificate(forest, table.where("k < 390"))["statistics"] > 1e-3
    first = forest.trees[0]
    worse = first.threshold.copy()
    worse[0] = np.nanmin(first.threshold) - 1e-3 if first.threshold[0] > np.nanmin(first.threshold) else worse[0] + 0.2
    moved = TR.Tree(**{**first.__dict__, "threshold": worse})
    found = TR.tree_certificate(TR.Forest([moved], forest.logit, forest.fitted), table)
    assert found["statistics"] > 1e-3 and found["gain"] > 1e-6


def test_logistic_certificate(table):
    done = TR.logistic_certificate(fitted(table, "logistic", maxIter=500, tol=1e-13), table)
    assert done["gradient"] < 1e-6 and done["excess"] < 1e-8
    begun = TR.logistic_certificate(fitted(table, "logistic", maxIter=1), table)
    assert begun["gradient"] > 1e-3


def test_network_scores(table):
    model = fitted(table, "network")
    theirs = {r.k: r.score for r in model.score(table).collect()}
    assert {r.k: r.score for r in TR.network_scores(model, table).collect()} == pytest.approx(theirs, abs=1e-9)


def test_long_paths_are_an_error(table, monkeypatch):
    forest = TR.read_forest(fitted(table, "tree"), table)
    monkeypatch.setattr(TR, "MAX_PATH_FEATURES", 1)
    with pytest.raises(ValueError):
        TR.attributions(forest, table)
