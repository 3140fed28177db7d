"""Graphs as two DataFrames, ``nodes(id)`` and ``edges(src, dst, w)``, and what needs no iteration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions import synth_weight  # noqa: F401  part of this module's interface


@dataclass(frozen=True)
class Graph:
    """Isolated nodes are in ``nodes`` alone."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, nonnegative: bool = False) -> Graph:
        """Build from an edge list ``(src, dst[, w])``; an undirected edge goes in both ways.

        Parallel edges are kept.  With ``nonnegative`` a negative weight raises ``ValueError``.
        """
        if "w" not in edges.columns:
            edges = edges.withColumn("w", F.lit(1).cast("long"))
        edges = edges.select("src", "dst", "w")
        if nonnegative and not edges.filter("w < 0").isEmpty():
            raise ValueError("negative edge weight")
        if not directed:
            edges = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
        every = ends if nodes is None else ends.union(nodes.select("id"))
        return Graph(every.distinct(), edges)


def symmetric(edges: DataFrame) -> DataFrame:
    """``(u, v, w)`` in both directions as ``(src, dst, w)``."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(
        edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w")
    )


def normalise(edges: DataFrame) -> DataFrame:
    """Canonical undirected edges ``(u, v, w)``: ``u < v``, no loops, the least weight of parallels."""
    return (
        edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
        .groupBy("u", "v").agg(F.min("w").alias("w"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree ``(id, degree)`` of the nodes with out-edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` nodes of largest out-degree, ties to the smaller id."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, neighbours)`` with neighbours ``(dst, w)`` in order."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))
