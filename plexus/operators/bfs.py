"""Breadth-first search as rounds of joins, with a policy for the direction of each round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.components import connected_components
from plexus.plans.loops import Levels
from plexus.plans.tables import materialize


#: Edges up to which components are labelled in one task.
ONE_TASK = 1 << 18


@dataclass
class Direction:
    """When a round looks from the unvisited side (pull) instead of the frontier's (push).

    ``enter`` and ``leave`` compare the frontier's out-edges with the unvisited nodes; ``smooth``
    averages that ratio over rounds; ``hold`` keeps a choice for some rounds.  All policies give
    the same distances and differ in the work of a round alone.
    """

    enter: float = float("inf")
    leave: float = 0.0
    smooth: float = 1.0
    hold: int = 0
    edge_share: float | None = None
    node_share: float | None = None
    _mean: float = 0.0
    _pull: bool = False
    _rest: int = 0

    def pull(self, frontier_edges: int, unvisited: int, edges: int, nodes: int) -> bool:
        ratio = frontier_edges / max(1, unvisited)
        self._mean = self.smooth * ratio + (1 - self.smooth) * self._mean
        if self._rest:
            self._rest -= 1
            return self._pull
        if self.edge_share:
            now = frontier_edges > edges / self.edge_share and unvisited < nodes / self.node_share
        else:
            now = self._mean > (self.leave if self._pull else self.enter)
        if now != self._pull:
            self._rest = self.hold
        self._pull = now
        return now


# The switching constants of the known policies.
STRATEGIES = {
    "push": lambda: Direction(),
    "direction": lambda: Direction(edge_share=14.0, node_share=24.0),
    "surf": lambda: Direction(enter=1.0, leave=0.5, smooth=0.6, hold=2),
    "bitmap": lambda: Direction(enter=1.2, leave=1.2),
    "adaptive": lambda: Direction(enter=1.0, leave=0.5, hold=8),
    "pull": lambda: Direction(enter=-1.0, leave=-1.0),
}


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, strategy: str = "push") -> DataFrame:
    """``(v, dist, parent)`` of the nodes that ``sources(id)`` reach over ``edges(src, dst)``.

    Unreached nodes have no row, a source has distance 0 and a null parent, and any other node's
    parent is its smallest predecessor one level nearer.  Without sources ``ValueError`` is raised.
    """
    pairs = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    links, out = pairs.repartition("src").persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        first = sources.select(F.col("id").alias("v")).distinct().withColumn("dist", F.lit(0)).withColumn("parent", F.lit(None).cast("long"))
        levels = Levels(first, "bfs")
        frontier = levels.append(first)
        if frontier.isEmpty():
            raise ValueError("no source")
        policy, depth = STRATEGIES[strategy](), 0
        track = strategy not in ("push", "pull")
        out = links.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree")).persist() if track else None
        m, n = (pairs.count(), pairs.select("src").union(pairs.select("dst")).distinct().count()) if track else (0, 0)
        while max_depth is None or depth < max_depth:
            pull = strategy == "pull"
            if track:
                work = frontier.join(out, "v").agg(F.sum("degree")).first()[0] or 0
                pull = policy.pull(work, n - levels.all().count(), m, n)
            visited, here = levels.all().select("v"), frontier.select(F.col("v").alias("src"))
            if pull:
                waiting = links.join(visited.withColumnRenamed("v", "dst"), "dst", "left_anti")
                met = waiting.join(here, "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
            else:
                met = links.join(here, "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent")).join(visited, "v", "left_anti")
            depth += 1
            frontier = levels.append(met.withColumn("dist", F.lit(depth)).withColumn("parent", F.col("parent").cast("long")))
            if frontier.isEmpty():
                break
        return levels.all()
    finally:
        links.unpersist()
        if out is not None:
            out.unpersist()


def frontier_work(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``(dist, frontier, edge_checks)``: a level's nodes and the out-edges that it scans."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return found.join(out, "v", "left").groupBy("dist").agg(
        F.count("*").alias("frontier"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edge_checks")
    )


def visit_order(found: DataFrame) -> DataFrame:
    """``found`` with ``visit_rank``: level by level, smaller ids first."""
    from pyspark.sql.window import Window

    sizes = found.groupBy("dist").agg(F.count("*").alias("n"))
    before = sizes.select("dist", F.coalesce(F.sum("n").over(Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("dist").orderBy("v")) - 1 + F.col("at")
    return found.join(F.broadcast(before), "dist").select("v", "dist", "parent", rank.alias("visit_rank"))


def trace(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target, step, v)``: the way from the source to each target along ``tree(v, parent)``.

    Steps count from 0 at the source; a target that the tree lacks has no rows.
    """
    hops = tree.select(F.col("v").alias("at"), F.col("parent").alias("up"))
    here = targets.select(F.col("id").alias("target")).distinct().join(tree.select(F.col("v").alias("target")), "target", "left_semi")
    first = here.select("target", F.lit(0).alias("back"), F.col("target").cast("long").alias("v"))
    levels = Levels(first, "trace")
    now, k = levels.append(first), 0
    while not now.isEmpty():
        k += 1
        now = levels.append(now.join(hops, F.col("v") == F.col("at")).filter("up is not null").select("target", F.lit(k).alias("back"), F.col("up").alias("v")))
    every = levels.all()
    length = every.groupBy("target").agg(F.max("back").alias("n"))
    return every.join(length, "target").select("target", (F.col("n") - F.col("back")).alias("step"), "v")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(v, component)`` of an undirected graph; a component is named by its smallest node."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), one_task=ONE_TASK).select(
        F.col("node").alias("v"), F.col("root").alias("component")
    )
    if nodes is None:
        return found
    return nodes.select(F.col("id").alias("v")).distinct().join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def two_colouring(edges: DataFrame) -> DataFrame:
    """``(v, component, colour, bipartite)`` of a symmetric graph.

    Colour is the parity of the distance from the component's smallest node; ``bipartite`` is
    false for all nodes of a component with an edge inside a colour.
    """
    named = materialize(components(edges), "components")
    found = bfs(edges, named.select(F.col("component").alias("id")).distinct())
    coloured = found.join(named, "v").select("v", "component", (F.col("dist") % 2).alias("colour"))
    a = coloured.select(F.col("v").alias("src"), F.col("colour").alias("ca"), F.col("component").alias("c"))
    b = coloured.select(F.col("v").alias("dst"), F.col("colour").alias("cb"))
    odd = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("ca = cb").select(F.col("c").alias("component")).distinct()
    flagged = coloured.join(odd.withColumn("odd", F.lit(True)), "component", "left")
    return flagged.select("v", "component", "colour", F.col("odd").isNull().alias("bipartite"))
