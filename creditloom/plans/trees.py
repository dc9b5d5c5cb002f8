"""Fitted tree models as tables of nodes and leaf paths: routing, scores, certificates and exact Shapley values.

A model is read from the node table that MLlib stores, so all of this works on the model alone, and is bounded by its size.
Rows are routed in their partitions; what leaves a partition is one number per row and tree, or sums per leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.plans.learn import Fitted
from creditloom.session import fresh_path

# A path's contributions are tabulated for every pattern of met conditions: 2 ** features of them.
MAX_PATH_FEATURES = 14


@dataclass(frozen=True)
class Path:
    """The way to one leaf: per feature an interval (low, high] and the share of training rows that met its conditions."""

    leaf: int
    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    cover: tuple[float, ...]

    @cached_property
    def contributions(self) -> np.ndarray:
        """[pattern, feature]: Shapley values of the game this leaf is, for every pattern of met conditions.

        A coalition's worth is the leaf's value if all its features' conditions are met, times the cover of the
        others. Coalitions of one size without feature f sum to a coefficient of the product of (cover + met t).
        """
        m = len(self.features)
        out = np.zeros((1 << m, m))
        sizes = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]) if m else np.zeros(0)
        for pattern in range(1 << m):
            met = [(pattern >> i) & 1 for i in range(m)]
            for f in range(m):
                sums = np.ones(1)
                for s in range(m):
                    if s != f:
                        sums = np.convolve(sums, [self.cover[s], met[s]])
                out[pattern, f] = self.value * (met[f] - self.cover[f]) * (sums * sizes).sum()
        return out


@dataclass(frozen=True)
class Tree:
    """Nodes by number; leaves have feature -1. ``stats`` are class counts, or count, sum and sum of squares."""

    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.feature < 0)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of a feature matrix."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return at

    def paths(self) -> list[Path]:
        found = []

        def walk(node: int, seen: dict[int, tuple[float, float, float]]) -> None:
            if self.feature[node] < 0:
                if len(seen) > MAX_PATH_FEATURES:
                    raise ValueError(f"a path with {len(seen)} features; {MAX_PATH_FEATURES} are supported")
                bounds = list(zip(*seen.values())) if seen else [(), (), ()]
                found.append(Path(node, float(self.value[node]), tuple(seen), *map(tuple, bounds)))
                return
            f, t = int(self.feature[node]), float(self.threshold[node])
            low, high, cover = seen.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((self.left[node], (low, min(high, t))), (self.right[node], (max(low, t), high))):
                walk(int(child), {**seen, f: (*interval, cover * float(self.rows[child] / self.rows[node]))})

        walk(0, {})
        return found

    def gathered(self, per_leaf: np.ndarray) -> np.ndarray:
        """Sums per node of what lies in the leaves below it; children have greater numbers than their parents."""
        total = per_leaf.copy()
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0:
                total[node] = total[self.left[node]] + total[self.right[node]]
        return total


@dataclass(frozen=True)
class Forest:
    """Trees whose weighted values add up to ``margin``: a probability, or half the log odds if ``logit``."""

    trees: list[Tree]
    logit: bool
    fitted: Fitted = field(repr=False)

    @property
    def base(self) -> float:
        """The expected margin over the training rows."""
        return float(sum(t.weight * (t.value[t.leaves] * t.rows[t.leaves]).sum() / t.rows[0] for t in self.trees))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t.weight * t.value[t.route(x)] for t in self.trees), np.zeros(len(x)))


def read_forest(fitted: Fitted, df: DataFrame) -> Forest:
    """The trees of a fitted tree, forest or boosted model; ``df`` names the session."""
    spark, kind = df.sparkSession, type(fitted.model).__name__
    path = fresh_path(spark, "model")
    fitted.model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    single = kind == "DecisionTreeClassificationModel"
    nodes = rows.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData")) if single else rows
    by_tree: dict[int, list] = {}
    for r in nodes.collect():  # a model's nodes
        by_tree.setdefault(r["treeID"], []).append(r["nodeData"])
    boosted = kind == "GBTClassificationModel"
    weights = fitted.model.treeWeights if boosted else [1.0 / len(by_tree)] * len(by_tree)
    trees = []
    for tree in sorted(by_tree):
        table = sorted(by_tree[tree], key=lambda n: n["id"])
        inner = [n["leftChild"] >= 0 for n in table]
        stats = np.array([n["impurityStats"] for n in table])
        trees.append(Tree(
            float(weights[tree]), np.array([n["split"]["featureIndex"] if i else -1 for n, i in zip(table, inner)]),
            np.array([n["split"]["leftCategoriesOrThreshold"][0] if i else np.nan for n, i in zip(table, inner)]),
            np.array([n["leftChild"] for n in table]), np.array([n["rightChild"] for n in table]),
            np.array([n["prediction"] for n in table]) if boosted else stats[:, 1] / stats.sum(1),
            np.array([n["rawCount"] for n in table], dtype=float), np.array([n["gain"] for n in table]), stats,
        ))
    return Forest(trees, boosted, fitted)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def prepared(fitted: Fitted, df: DataFrame) -> DataFrame:
    """key, y (label as a double), x (the scaled features)."""
    return fitted.prepare(df).select(
        F.col(fitted.key).alias("key"), F.col("label__").alias("y"), vector_to_array("features").alias("x"))


def margins(forest: Forest, df: DataFrame) -> DataFrame:
    """(key, label, margin, score) of every row, from the trees' own tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = forest_margin(trees, matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(margin)], ["key", "y", "margin"])

    trees, key, label = forest.trees, forest.fitted.key, forest.fitted.label
    rows = prepared(forest.fitted, df)
    schema = T.StructType([rows.schema["key"], rows.schema["y"], T.StructField("margin", T.DoubleType())])
    score = 1 / (1 + F.exp(-2 * F.col("margin"))) if forest.logit else F.col("margin")
    return rows.mapInArrow(work, schema).select(
        F.col("key").alias(key), F.col("y").cast(df.schema[label].dataType).alias(label), "margin", score.alias("score"))


def forest_margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.weight * t.value[t.route(x)] for t in trees), np.zeros(len(x)))


def attributions(forest: Forest, df: DataFrame) -> DataFrame:
    """(sk_id, feature, value): exact Shapley values of the margin, for every feature that the trees use.

    A coalition's worth is the margin expected when only its features are known: conditions on other features are
    met in the share in which training rows met them. Values of a row add up to its margin less ``forest.base``.
    """
    used = sorted({int(f) for t in forest.trees for f in t.feature if f >= 0})
    place = {f: i for i, f in enumerate(used)}
    paths = [(t.weight, p, [place[f] for f in p.features]) for t in forest.trees for p in t.paths() if p.features]
    tables = [(weight * p.contributions, p.features, np.array(p.low), np.array(p.high), spots) for weight, p, spots in paths]
    names = [forest.fitted.features[f] for f in used]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            phi = np.zeros((len(x), len(used)))
            for table, features, low, high, spots in tables:
                part = x[:, features]
                pattern = (((part > low) & (part <= high)) << np.arange(len(spots))).sum(1)
                phi[:, spots] += table[pattern]
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(x)), len(used))))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(names * len(x), pa.string()), pa.array(phi.ravel())], ["sk_id", "feature", "value"])

    rows = prepared(forest.fitted, df).drop("y")
    schema = T.StructType([T.StructField("sk_id", rows.schema["key"].dataType), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    return rows.mapInArrow(work, schema)


# ---------------------------------------------------------------- certificates
def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over partitions of ``part(x, y)``, ``size`` numbers each; rows as from :func:`prepared`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch), batch.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["values"])

    parts = rows.select("y", "x").mapInArrow(work, "values array<double>").select(F.posexplode("values").alias("at", "value"))
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # ``size`` rows
        out[r["at"]] = r["value"]
    return out


def _impurity(stats: np.ndarray, classes: bool) -> np.ndarray:
    """Gini impurity of class counts, or variance from count, sum and sum of squares; along the last axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            n = stats.sum(-1)
            found = 1 - ((stats / n[..., None]) ** 2).sum(-1)
        else:
            n = stats[..., 0]
            found = (stats[..., 2] - stats[..., 1] ** 2 / n) / n
    return np.where(n > 0, found, 0.0)


def _size(stats: np.ndarray, classes: bool) -> np.ndarray:
    return stats.sum(-1) if classes else stats[..., 0]


def _gain(whole: np.ndarray, left: np.ndarray, classes: bool) -> np.ndarray:
    right = whole - left
    n, a, b = (_size(s, classes) for s in (whole, left, right))
    gain = _impurity(whole, classes) - (a * _impurity(left, classes) + b * _impurity(right, classes)) / np.maximum(n, 1)
    return np.where((a > 0) & (b > 0), gain, -np.inf)


def tree_certificate(forest: Forest, training: DataFrame) -> dict[str, float]:
    """How far a model is from what its training rows say, each at most rounding if it is right.

    ``statistics``: of every node, recomputed from the rows routed to it, against the stored ones. ``gain``: of every split,
    recomputed, against the stored one. ``better``: by how much another split that the tree uses somewhere would have been
    better at a node, from histograms of the rows of each leaf at those splits. For a boosted model the target of a tree
    are the pseudo-residuals of the trees before it. Trees of bagged forests were fitted on drawn rows, which nobody stores: for them only
    gains are recomputed, from the stored statistics.
    """
    classes, worst = not forest.logit, {"statistics": 0.0, "gain": 0.0, "better": 0.0}
    bagged = classes and len(forest.trees) > 1
    rows = prepared(forest.fitted, training)
    for number, tree in enumerate(forest.trees):
        inner = np.flatnonzero(tree.feature >= 0)
        if bagged:
            gains = _gain(tree.stats[inner], tree.stats[tree.left[inner]], classes)
            worst["gain"] = max(worst["gain"], float(np.abs(gains - tree.gain[inner]).max(initial=0)))
            whole = tree.stats[tree.left[inner]] + tree.stats[tree.right[inner]]
            worst["statistics"] = max(worst["statistics"], float(np.abs(whole - tree.stats[inner]).max(initial=0)))
            continue
        splits = sorted({(int(f), float(t)) for f, t in zip(tree.feature[inner], tree.threshold[inner])})
        earlier, width = forest.trees[:number], tree.stats.shape[1]

        def part(x, y, tree=tree, earlier=earlier, splits=splits, width=width):
            if classes:
                target = np.stack([y == 0, y == 1], axis=1).astype(float)
            else:
                sign = 2 * y - 1
                r = 4 * sign / (1 + np.exp(2 * sign * forest_margin(earlier, x))) if earlier else sign
                target = np.stack([np.ones(len(y)), r, r * r], axis=1)
            leaf, out = tree.route(x), np.zeros((1 + len(splits), len(tree.feature), width))
            for i, inside in enumerate([np.ones(len(x), dtype=bool), *[x[:, f] <= t for f, t in splits]]):
                for c in range(width):
                    out[i, :, c] = np.bincount(leaf[inside], target[inside, c], len(tree.feature))
            return out.ravel()

        found = summed(rows, part, (1 + len(splits)) * len(tree.feature) * width).reshape(1 + len(splits), -1, width)
        found = np.stack([tree.gathered(table) for table in found])
        scale = np.maximum(np.abs(tree.stats), 1)
        worst["statistics"] = max(worst["statistics"], float((np.abs(found[0] - tree.stats) / scale).max()))
        if len(inner):
            chosen = _gain(found[0][inner], found[0][tree.left[inner]], classes)
            worst["gain"] = max(worst["gain"], float(np.abs(chosen - tree.gain[inner]).max()))
            others = _gain(np.broadcast_to(found[0][inner], found[1:][:, inner].shape), found[1:][:, inner], classes)
            with np.errstate(invalid="ignore"):  # a split without rows on one side has no gain, and is reported above
                worst["better"] = max(worst["better"], float(np.nan_to_num(others - chosen, nan=0.0).max()))
    return worst


def logistic_certificate(fitted: Fitted, training: DataFrame) -> dict[str, float]:
    """Greatest entry of the gradient of the penalised loss, in the scaled space in which MLlib penalises weights.

    The loss is strongly convex there with the penalty as constant, so its excess over the least one is at most
    the squared length of the gradient over twice the penalty; that is ``excess``.
    """
    weights, intercept = np.array(fitted.model.coefficients), float(fitted.model.intercept)
    penalty, width = float(fitted.model.getRegParam()), len(fitted.features)

    def part(x, y):
        error = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
        return np.concatenate([[len(y), error.sum()], error @ x, x.sum(0)])

    rows = prepared(fitted, training)
    found = summed(rows, part, 2 + 2 * width)
    n, means = found[0], found[2 + width:] / found[0]
    spread = summed(rows, lambda x, y: ((x - means) ** 2).sum(0), width)
    deviation = np.sqrt(spread / max(n - 1, 1))
    live = deviation > 0
    slope = np.where(live, found[2:2 + width] / n / np.where(live, deviation, 1) + penalty * weights * deviation, 0.0)
    gradient = np.append(slope, found[1] / n)
    return {"gradient": float(np.abs(gradient).max()), "excess": float((gradient ** 2).sum() / (2 * penalty))}


def network_scores(fitted: Fitted, df: DataFrame) -> DataFrame:
    """(key, score) of a network from its weights: sigmoid layers, softmax at the end."""
    sizes, flat = list(fitted.model.getLayers()), np.array(fitted.model.weights)
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = matrix(batch)
                for i, (weight, bias) in enumerate(layers):
                    h = h @ weight + bias
                    h = 1 / (1 + np.exp(-h)) if i < len(layers) - 1 else h
                score = 1 / (1 + np.exp(h[:, 0] - h[:, 1]))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score)], ["key", "score"])

    rows = prepared(fitted, df).select("key", "x")
    schema = T.StructType([rows.schema["key"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(work, schema).select(F.col("key").alias(fitted.key), "score")
