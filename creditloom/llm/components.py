"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.base import settled


def _both(one: tuple[Column, ...], other: tuple[Column, ...], names: tuple[str, ...]) -> Column:
    """Two rows out of one, in the pass that reads it."""
    row = lambda columns: F.struct(*[c.alias(n) for c, n in zip(columns, names)])
    return F.inline(F.array(row(one), row(other)))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of ``edges`` (u > v) has one edge and is no v: then v is the least node of its component."""
    ends = edges.select(_both((F.col("u"), F.lit(1), F.lit(0)), (F.col("v"), F.lit(0), F.lit(1)), ("node", "above", "below")))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return nodes.agg(F.count_if((F.col("above") > 1) | (F.col("above") + F.col("below") > 1))).first()[0] == 0


def _least(edges: DataFrame) -> DataFrame:
    """k and m: the least v of every u; a node with very many neighbours is combined before the exchange."""
    return edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for the nodes of ``edges`` (a, b).

    Edges are kept as u > v, so the least neighbour of a v is the least v of its own edges as a u. Edges that are
    stars around their least nodes take no step; labels of earlier edges, passed as edges, are such stars.
    """
    current = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _are_stars(current):
        large = current.join(_least(current), F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.join(_least(large), F.col("u") == F.col("k"))
        u, v, m = F.col("u"), F.col("v"), F.col("m")
        current = settled(small.select(_both((v, m), (u, m), ("u", "v"))).where("u <> v").distinct())
    return current.select(_both((F.col("u"), F.col("v")), (F.col("v"), F.col("v")), ("node", "label"))).distinct()
