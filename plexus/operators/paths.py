"""Shortest paths: single-source by relaxation rounds or a bounded kernel, and all pairs."""

from __future__ import annotations

import heapq
import time

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.bfs import trace
from plexus.plans.loops import Levels, iterate
from plexus.plans.tables import materialize, maybe_broadcast
from plexus.plans.workers import tidy

#: Edges that a single task may hold for a kernel strategy.
KERNEL_EDGES = 5_000_000
#: Edges of the block of lightest ones that the task takes where the graph has more than that.
BLOCK_EDGES = 3_000_000
#: Bytes of a node's row in a broadcast, and rounds between merges of the distances' levels.
NODE_BYTES, MERGE_ROUNDS = 48, 8
#: Strategies that relax in rounds.
ROUNDS = ("full", "frontier", "adaptive", "learned", "shuffled", "potential")


class NegativeCycle(ValueError):
    """Distances are not defined: a cycle of negative weight is reachable."""


def _least_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))


def sssp(edges: DataFrame, source: int, strategy: str = "frontier", nodes: DataFrame | None = None) -> DataFrame:
    """``(v, dist, prev)`` of the nodes that ``source`` reaches over ``edges(src, dst, w)``.

    ``prev`` is the smallest predecessor on a shortest path (null for the source).  Strategies:
    ``full`` relaxes every edge in each round, ``frontier`` those of the nodes that changed,
    ``adaptive`` chooses by the share of edges that changed nodes have, ``learned`` sets that share
    by the measured cost of an edge in either kind of round, ``shuffled`` relaxes changed nodes in
    an order drawn by a hash, ``potential`` those first that gained most since they were last
    relaxed, ``kernel`` runs Dijkstra's algorithm in one task over at most ``KERNEL_EDGES`` edges, or over the
    lightest of more and then relaxes the others, and needs weights that are not negative.  Negative weights
    are allowed otherwise; a reachable negative cycle raises ``NegativeCycle``.  A source that
    neither ``nodes`` nor the edges hold raises ``KeyError``.
    """
    if strategy == "kernel":
        return _with_prev(materialize(kernel(edges, source, nodes), "sssp"), _least_edges(edges), source)
    least = materialize(_least_edges(edges), "edges")
    known = least.filter((F.col("src") == source) | (F.col("dst") == source))
    if known.isEmpty() and (nodes is None or nodes.filter(F.col("id") == source).isEmpty()):
        raise KeyError(source)
    start = edges.sparkSession.createDataFrame([(source,)], "id long")
    return _with_prev(_rounds(least, start, strategy).select("v", "dist"), least, source)


def _with_prev(found: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    a = found.select(F.col("v").alias("src"), F.col("dist").alias("da"))
    b = found.select(F.col("v").alias("dst"), F.col("dist").alias("db"))
    tight = edges.join(a, "src").join(b, "dst").filter("da + w = db and src <> dst").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("prev"))
    return found.join(tight, "v", "left").select("v", "dist", F.when(F.col("v") != source, F.col("prev")).alias("prev"))


def sssp_many(edges: DataFrame, sources: DataFrame, strategy: str = "frontier") -> DataFrame:
    """``(source, v, dist)`` from every one of ``sources(id)``, all in the same rounds."""
    return _rounds(materialize(_least_edges(edges), "edges"), sources.select("id").distinct(), strategy)


#: Levels of changed rows that are read before they are merged into one.
MERGE_AT = 8


def _rounds(edges: DataFrame, sources: DataFrame, strategy: str) -> DataFrame:
    """Relaxation in rounds; a round writes the rows that it changed and no others.

    ``here`` are the rows that a round relaxes, out of those that changed and have not been relaxed
    since; with ``shuffled`` and ``potential`` the others wait for the next round at most.
    """
    if strategy not in ROUNDS:
        raise ValueError(f"unknown strategy {strategy}")
    kind = "bigint" if edges.schema["w"].dataType.simpleString() in ("int", "bigint") else "double"
    links = edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    switches = strategy in ("adaptive", "learned")
    m = edges.count() * sources.count() if switches else 0
    n = edges.select("src").union(edges.select("dst")).distinct().count()
    # n - 1 rounds settle every distance, and twice as many where rows wait; a later change proves a cycle
    most = (2 if strategy in ("shuffled", "potential") else 1) * (n + 1)
    eta, spent = 2.0, {True: [0.0, 0.0], False: [0.0, 0.0]}
    at = F.col("id").cast("long")
    start = sources.select(at.alias("source"), at.alias("v"), F.lit(0).cast(kind).alias("dist"))
    known = Levels(start, "sssp")
    try:
        pending = known.append(start).withColumn("gain", F.lit(None).cast(kind))
        for k in range(1, most + 1):
            state = known.all().groupBy("source", "v").agg(F.min("dist").alias("dist"))
            here, wait, full, active, began = pending, None, strategy == "full", m, time.perf_counter()
            if switches:
                active = pending.join(links, F.col("v") == F.col("src")).count()
                full = eta * active >= m
            if strategy == "shuffled":
                now = F.pmod(F.xxhash64("v") + k, F.lit(2)) == 0
                here, wait = pending.filter(now), pending.filter(~now)
            elif strategy == "potential" and k % 2:
                # rows that gained most since they were last relaxed go first, new ones before all
                mean = pending.agg(F.avg("gain")).first()[0]
                late = F.col("gain") < F.lit(mean) if mean is not None else F.lit(False)
                here, wait = pending.filter(~F.coalesce(late, F.lit(False))), pending.filter(F.coalesce(late, F.lit(False)))
            here = (state if full else here).select("source", F.col("v").alias("src"), F.col("dist").alias("d"))
            offers = links.join(here, "src").groupBy("source", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).cast(kind).alias("offer"))
            better = offers.join(state, ["source", "v"], "left").filter("offer is not null and (dist is null or offer < dist)")
            changed = materialize(better.select("source", "v", F.col("offer").alias("dist"), (F.col("dist") - F.col("offer")).alias("gain")), "changed")
            if switches:
                spent[full] = [spent[full][0] + time.perf_counter() - began, spent[full][1] + (m if full else active)]
                if strategy == "learned" and min(spent[True][1], spent[False][1]) > 0:
                    cost = {side: t / arcs for side, (t, arcs) in spent.items()}
                    eta = min(8.0, max(1.0, cost[False] / cost[True]))
            after = changed
            if wait is not None:
                after = materialize(changed.union(wait.join(changed.select("source", "v"), ["source", "v"], "left_anti")), "pending")
            if after.isEmpty():
                break
            known.append(changed.select("source", "v", "dist"))
            if known.n >= MERGE_AT:
                known = known.merged(lambda rows: rows.groupBy("source", "v").agg(F.min("dist").alias("dist")))
            pending = after
        else:
            raise NegativeCycle("a negative cycle is reachable from the source")
    finally:
        links.unpersist()
    return known.all().groupBy("source", "v").agg(F.min("dist").alias("dist"))


def dijkstra(arcs: dict, source, target=None, known: dict | None = None) -> dict:
    """Distances by the binary heap; with a target it stops there, and others are upper bounds.

    ``known`` distances are started from instead of the source.
    """
    dist = {source: 0} if known is None else dict(known)
    heap, settled = [(d, u) for u, d in dist.items()], set()
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u in settled:
            continue
        settled.add(u)
        if u == target:
            break
        for v, w in arcs.get(u, ()):
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def _settle(src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and distances that Dijkstra's algorithm finds or shortens from the known ones ``start``
    at distances ``at``; arcs stay in arrays, by source."""
    names, code = np.unique(np.concatenate([src, dst, start]), return_inverse=True)
    m = len(src)
    order = np.argsort(code[:m], kind="stable")
    first = np.searchsorted(code[:m][order], np.arange(len(names) + 1)).tolist()
    to, weight = code[m : 2 * m][order], w[order]
    dist: list = [None] * len(names)
    for u, d in zip(code[2 * m :].tolist(), at.tolist(), strict=True):
        dist[u] = d if dist[u] is None else min(d, dist[u])
    was, done = list(dist), bytearray(len(names))
    heap = [(d, u) for u, d in enumerate(dist) if d is not None]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = 1
        i, j = first[u], first[u + 1]
        for v, x in zip(to[i:j].tolist(), weight[i:j].tolist(), strict=True):
            if dist[v] is None or d + x < dist[v]:
                dist[v] = d + x
                heapq.heappush(heap, (d + x, v))
    new = [u for u, d in enumerate(dist) if d is not None and (was[u] is None or d < was[u])]
    return names[np.array(new, dtype=np.int64)], np.array([dist[u] for u in new], dtype=w.dtype)


def _in_one_task(arcs: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """``(v, dist)`` that Dijkstra's algorithm adds to or shortens of ``known``, in one task."""

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        src, dst, w, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        v, dist = _settle(src[~start], dst[~start], w[~start], dst[start], w[start])
        for i in range(0, len(v), 100_000):
            yield pa.record_batch({"v": v[i : i + 100_000], "dist": dist[i : i + 100_000]})

    rows = arcs.select("src", "dst", "w", F.lit(False)).union(known.select("v", "v", "dist", F.lit(True)))
    # a coalesce would read and filter all edges in that one task
    return rows.repartition(1).mapInArrow(tidy(run), f"v long, dist {kind}")


def kernel(edges: DataFrame, source: int, nodes: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """``(v, dist)`` as ``sssp`` has them, by Dijkstra's algorithm in one task.

    ``edges`` are read several times, and written first unless they are ``stored``.

    Of more than ``KERNEL_EDGES`` edges the task takes the lightest, which hold most of the shortest
    paths.  Its distances are upper bounds, so all edges are then relaxed, and those of changed nodes
    again, until nothing changes.  Where a round changes more rows than the one before, the task
    goes on from there.
    """
    spark = edges.sparkSession
    kept = edges if stored else materialize(edges.select("src", "dst", "w"), "arcs")
    kind = "bigint" if kept.schema["w"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    here = (F.col("src") == source) | (F.col("dst") == source)
    arcs = kept.filter("src is not null and dst is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast(kind))
    size, at, below = arcs.agg(F.count("w"), F.count_if(here), F.count_if(F.col("w") < 0)).first()
    if not at and (nodes is None or nodes.filter(F.col("id") == source).isEmpty()):
        raise KeyError(source)
    if below:
        raise ValueError("negative edge weight")
    arcs = arcs.filter("w is not null")
    first = spark.createDataFrame([(source,)], "v long").select("v", F.lit(0).cast(kind).alias("dist"))
    least = lambda rows: rows.groupBy("v").agg(F.min("dist").alias("dist"))
    if size <= KERNEL_EDGES:
        return least(first.union(_in_one_task(arcs, first, kind)))
    # any weight gives the same distances, so that of some million edges by a hash will do
    some = arcs.filter(F.pmod(F.xxhash64("src", "dst", "w"), F.lit(max(1, size // 1_000_000))) == 0)
    cut = some.agg(F.percentile_approx("w", F.lit(BLOCK_EDGES / size), F.lit(1000))).first()[0]
    lighter, equal = arcs.agg(F.count_if(F.col("w") < cut), F.count_if(F.col("w") == cut)).first()
    # of equal weights a share drawn by a hash, else a graph of one weight would all be taken
    share = F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 20)) < int((1 << 20) * max(0, BLOCK_EDGES - lighter) / max(1, equal))
    light = arcs.filter((F.col("w") < cut) | ((F.col("w") == cut) & share) | (here if at <= BLOCK_EDGES else F.lit(False)))
    known = Levels(first, "sssp")
    known.append(first)
    known.append(_in_one_task(light, first, kind))
    changed = least(known.all())
    before = moved = changed.count()
    held = moved
    while moved:
        state = least(known.all())
        offers = arcs.join(maybe_broadcast(changed.select(F.col("v").alias("src"), F.col("dist").alias("d")), moved, NODE_BYTES), "src")
        best = maybe_broadcast(state.select(F.col("v").alias("dst"), F.col("dist").alias("best")), held, NODE_BYTES)
        better = offers.join(best, "dst", "left").filter("best is null or d + w < best").select(F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("dist"))
        changed = known.append(least(better))
        moved = changed.count()
        if moved > before:
            more = known.append(_in_one_task(light, least(known.all()), kind))
            changed = materialize(least(changed.union(more)), "changed")
            moved = changed.count()
        before = moved
        held += moved
        if known.n >= MERGE_ROUNDS:
            known = known.merged(least)
            held = known.all().count()
    return least(known.all())


def has_negative_cycle(edges: DataFrame, source: int) -> bool:
    """Whether a negative cycle is reachable; exact, by one round more than a path can have edges."""
    try:
        sssp(edges, source, "frontier")
    except NegativeCycle:
        return True
    return False


def shortest_path(edges: DataFrame, source: int, target: int, nodes: DataFrame | None = None) -> tuple[float | None, list[int] | None]:
    """Distance and nodes of a shortest path; ``(None, None)`` if there is none."""
    if source == target:
        return 0, [source]
    found = materialize(sssp(edges, source, nodes=nodes), "sssp")
    at = found.filter(F.col("v") == target).first()
    if at is None:
        return None, None
    goal = found.sparkSession.createDataFrame([(target,)], "id long")
    way = trace(found.select("v", F.col("prev").alias("parent")), goal).orderBy("step").collect()
    return at["dist"], [r["v"] for r in way]


def all_pairs(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(a, b, dist, next)`` for all pairs with a path, by squaring in the (min, +) sense.

    A node has distance 0 to itself unless it lies on a negative cycle, where the entry is negative.
    ``next`` is the smallest first hop on a shortest path, null for a node to itself.
    """
    least = materialize(_least_edges(edges), "edges")
    ends = least.select(F.col("src").alias("id")).union(least.select(F.col("dst").alias("id")))
    every = materialize((ends if nodes is None else ends.union(nodes.select("id"))).distinct(), "nodes")
    n = every.count()
    own = every.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast(least.schema["w"].dataType).alias("dist"))
    start = least.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("dist")).union(own).groupBy("a", "b").agg(F.min("dist").alias("dist"))

    def square(state: DataFrame, _: int) -> DataFrame:
        left = state.select("a", F.col("b").alias("mid"), F.col("dist").alias("d1"))
        right = state.select(F.col("a").alias("mid"), "b", F.col("dist").alias("d2"))
        return left.join(right, "mid").groupBy("a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"))

    rounds = max(1, (max(2, n) - 1).bit_length())
    found, _, _ = iterate(start, square, lambda s, k: k == rounds, rounds, "apsp")
    hop = least.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("hop"), "w")
    rest = found.select(F.col("a").alias("hop"), "b", F.col("dist").alias("d2"))
    total = found.select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("dist").alias("best"))
    first = hop.join(rest, "hop").join(total, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).filter("w + d2 = best and a <> b")
    tight = first.groupBy("a", "b").agg(F.min("hop").alias("next"))
    return found.join(tight, ["a", "b"], "left").select("a", "b", "dist", "next")


def on_negative_cycle(pairs: DataFrame) -> DataFrame:
    """Nodes whose distance to themselves is negative."""
    return pairs.filter("a = b and dist < 0").select(F.col("a").alias("v"))


def pair_path(pairs: DataFrame, a: int, b: int) -> list[int] | None:
    """Nodes from ``a`` to ``b`` by next hops; ``ValueError`` if one comes twice."""
    towards = {r["a"]: r["next"] for r in pairs.filter((F.col("b") == b) & F.col("next").isNotNull()).select("a", "next").collect()}
    if pairs.filter((F.col("a") == a) & (F.col("b") == b)).isEmpty():
        return None
    way = [a]
    while way[-1] != b:
        way.append(towards[way[-1]])
        if way[-1] in way[:-1]:
            raise ValueError("a node repeats: there is a negative cycle")
    return way


def matrix(pairs: DataFrame) -> DataFrame:
    """Distances as a matrix, one row per ``a`` and one column per ``b``."""
    return pairs.groupBy("a").pivot("b").agg(F.first("dist"))
