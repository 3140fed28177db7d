"""Point-to-point search: landmark tables and bounds as joins, best-first search as a kernel.

Landmark distances are single-source runs; the bound of a pair is one join.  A search with its
counters runs in a task per batch of queries over a broadcast graph, whose size is checked; larger
graphs answer queries by ``paths.sssp``.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.operators.paths import KERNEL_EDGES, dijkstra, sssp, sssp_many
from plexus.plans.loops import Levels
from plexus.plans.tables import materialize

# Landmarks, those active for a query, sampled pairs of the covering choice.
LANDMARKS, ACTIVE, SAMPLED_PAIRS = 16, 6, 16
TIE_SCALE = 1e5


def farthest_landmarks(edges: DataFrame, k: int = LANDMARKS) -> DataFrame:
    """``(landmark, nth, v, dist)``: the first landmark is the smallest node, each next one the node
    farthest from all before it (ties to the smaller id); fewer if the reached nodes run out."""
    pairs = materialize(edges.select("src", "dst", "w"), "edges")
    first = pairs.agg(F.min(F.least("src", "dst"))).first()[0]
    if _in_one_task(pairs):
        return _landmark_kernel(pairs, [first], k)
    out, at = None, first
    for nth in range(k):
        found = sssp(pairs, at).select(F.lit(at).cast("long").alias("landmark"), F.lit(nth).alias("nth"), "v", "dist")
        if out is None:
            out = Levels(found, "landmarks")
        out.append(found)
        far = out.all().groupBy("v").agg(F.min("dist").alias("d"), F.max((F.col("v") == F.col("landmark")).cast("int")).alias("used"))
        best = far.filter("used = 0").orderBy(F.desc("d"), "v").first()
        if best is None:
            break
        at = best["v"]
    return out.all()


def covering_landmarks(edges: DataFrame, k: int = LANDMARKS, seed: int = 1) -> DataFrame:
    """``(landmark, nth, v, dist)``: nodes that separate sampled pairs best, then farthest ones.

    A node's score adds ``|d(s, x) - d(t, x)|`` over ``SAMPLED_PAIRS`` pairs drawn by a hash of the
    seed; half of the landmarks are taken by score, the others as the farthest ones are.
    """
    pairs = materialize(edges.select("src", "dst", "w"), "edges")
    nodes = pairs.select(F.col("src").alias("v")).distinct()
    mixed = F.pmod(F.pmod(F.col("v"), F.lit(1 << 31)) * 2654435761 + seed * 40503, F.lit(1 << 32))
    drawn = [r["v"] for r in nodes.orderBy(mixed, "v").limit(2 * SAMPLED_PAIRS).collect()]
    spark = edges.sparkSession
    ends = spark.createDataFrame([(n, s, t) for n, (s, t) in enumerate(zip(drawn[::2], drawn[1::2], strict=False))], "n long, s long, t long")
    far = materialize(sssp_many(pairs, ends.select(F.col("s").alias("id")).union(ends.select("t"))), "ends")
    a, b = (far.select(F.col("source").alias(x), "v", F.col("dist").alias(f"d{x}")) for x in ("s", "t"))
    gain = ends.join(a, "s").join(b, ["t", "v"]).groupBy("v").agg(F.sum(F.abs(F.col("ds") - F.col("dt"))).alias("gain"))
    chosen = [r["v"] for r in gain.orderBy(F.desc("gain"), "v").limit(max(1, k // 2)).collect()]
    if _in_one_task(pairs):
        return _landmark_kernel(pairs, chosen, k)
    out = None
    for nth in range(k):
        if nth >= len(chosen):
            far = out.all().groupBy("v").agg(F.min("dist").alias("d"), F.max((F.col("v") == F.col("landmark")).cast("int")).alias("used"))
            best = far.filter("used = 0").orderBy(F.desc("d"), "v").first()
            if best is None:
                break
            chosen.append(best["v"])
        found = sssp(pairs, chosen[nth]).select(F.lit(chosen[nth]).cast("long").alias("landmark"), F.lit(nth).alias("nth"), "v", "dist")
        if out is None:
            out = Levels(found, "landmarks")
        out.append(found)
    return out.all()


def _in_one_task(edges: DataFrame) -> bool:
    return edges.count() <= KERNEL_EDGES and edges.filter("w < 0").isEmpty()


def _landmark_kernel(edges: DataFrame, chosen: list, k: int) -> DataFrame:
    """``(landmark, nth, v, dist)``: the chosen nodes, then the farthest ones, in one task."""
    kind = edges.schema["w"].dataType.simpleString()

    def run(frames):
        arcs = defaultdict(list)
        for f in frames:
            for u, v, w in zip(f.src.tolist(), f.dst.tolist(), f.w.tolist(), strict=True):
                arcs[u].append((v, w))
        near: dict = {}
        for nth in range(k):
            if nth < len(chosen):
                at = chosen[nth]
            else:
                rest = [(-d, v) for v, d in near.items() if v not in used]
                if not rest:
                    break
                at = min(rest)[1]
            used = {at} if not nth else used | {at}
            found = dijkstra(arcs, at)
            for v, d in found.items():
                near[v] = min(d, near.get(v, d))
            yield pd.DataFrame({"landmark": at, "nth": nth, "v": list(found), "dist": list(found.values())})

    return materialize(edges.coalesce(1).mapInPandas(run, f"landmark long, nth int, v long, dist {kind}"), "landmarks")


def landmark_bounds(landmarks: DataFrame, queries: DataFrame, active: int | None = None) -> DataFrame:
    """``(src, dst, bound)``: the largest ``|d(L, src) - d(L, dst)|``, a lower bound of the distance
    in a symmetric graph; with ``active`` over that many best landmarks, which is the same."""
    gains = landmark_gains(landmarks, queries)
    if active:
        gains = gains.withColumn("nth", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("gain"), "landmark"))).filter(F.col("nth") <= active)
    return gains.groupBy("src", "dst").agg(F.max("gain").alias("bound"))


def landmark_gains(landmarks: DataFrame, queries: DataFrame) -> DataFrame:
    """``(src, dst, landmark, gain)`` for every query and landmark that reaches both ends."""
    a = landmarks.select("landmark", F.col("v").alias("src"), F.col("dist").alias("da"))
    b = landmarks.select("landmark", F.col("v").alias("dst"), F.col("dist").alias("db"))
    return queries.select("src", "dst").join(a, "src").join(b, ["landmark", "dst"]).select("src", "dst", "landmark", F.abs(F.col("da") - F.col("db")).alias("gain"))


# --- kernels ----------------------------------------------------------------------------------


def best_first(arcs: dict, source, target, h, weight: float = 1.0, tie: bool = False) -> tuple[float | None, int, int]:
    """Cost (null without a path), expanded and generated nodes of weighted A*.

    ``tie`` prefers the deeper of equal keys by ``f * 1e5 - g``.  Nodes reopen when a shorter way
    turns up, so cost is optimal at weight 1 for any lower bound ``h``.
    """
    if source == target:
        return 0, 0, 0
    key = (lambda g, f: f * TIE_SCALE - g) if tie else (lambda g, f: f)
    best, heap, expanded, generated = {source: 0}, [(key(0, weight * h(source)), 0, source)], 0, 1
    while heap:
        _, g, u = heapq.heappop(heap)
        if g > best[u]:
            continue
        if u == target:
            return g, expanded, generated
        expanded += 1
        for v, w in arcs.get(u, ()):
            if g + w < best.get(v, math.inf):
                best[v] = g + w
                generated += 1
                heapq.heappush(heap, (key(g + w, g + w + weight * h(v)), g + w, v))
    return None, expanded, generated


def two_sided(arcs: dict, back: dict, source, target, hf, hb, weight: float = 1.0) -> tuple[float | None, int, int]:
    """Bidirectional search with the consistent pair potential ``(hf - hb) / 2``.

    Stops when the two smallest keys add up to at least the best meeting cost over ``weight``, which
    is optimal at weight 1 and within the factor otherwise.
    """
    if source == target:
        return 0, 0, 0
    pull = {0: lambda v: (hf(v) - hb(v)) / 2, 1: lambda v: (hb(v) - hf(v)) / 2}
    ways, best = {0: arcs, 1: back}, {0: {source: 0}, 1: {target: 0}}
    heaps = {0: [(pull[0](source), 0, source)], 1: [(pull[1](target), 0, target)]}
    done, meet, expanded, generated = {0: set(), 1: set()}, math.inf, 0, 2
    while heaps[0] and heaps[1]:
        if heaps[0][0][0] + heaps[1][0][0] >= meet / weight - 1e-12:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, g, u = heapq.heappop(heaps[side])
        if u in done[side] or g > best[side][u]:
            continue
        done[side].add(u)
        expanded += 1
        for v, w in ways[side].get(u, ()):
            if g + w < best[side].get(v, math.inf):
                best[side][v] = g + w
                generated += 1
                heapq.heappush(heaps[side], (g + w + pull[side](v), g + w, v))
                if v in best[1 - side]:
                    meet = min(meet, g + w + best[1 - side][v])
    return (None if math.isinf(meet) else meet), expanded, generated


#: Strategy: heuristic, weight, tie rule, two-sided.
STRATEGIES = {
    "astar": ("plane", 1.0, False, False),
    "weighted_1.5": ("plane", 1.5, False, False),
    "weighted_2.0": ("plane", 2.0, False, False),
    "tie_break": ("plane", 1.0, True, False),
    "two_sided": ("plane", 1.0, False, True),
    "landmark": ("landmark", 1.0, False, False),
    "landmark_two_sided": ("landmark", 1.0, False, True),
    "landmark_two_sided_1.1": ("landmark", 1.1, False, True),
    "landmark_two_sided_1.5": ("landmark", 1.5, False, True),
}


def search(edges: DataFrame, queries: DataFrame, strategy: str = "astar", points: DataFrame | None = None, landmarks: DataFrame | None = None) -> DataFrame:
    """``(src, dst, cost, expanded, generated)`` for each of ``queries(src, dst)``.

    ``points(id, x, y)`` give the straight-line bound (zero without them, which is a plain search);
    ``landmarks`` as made above serve the landmark strategies, ``ACTIVE`` of them for each query.
    The graph, the points and the landmarks' distances may have at most ``KERNEL_EDGES`` rows each.
    """
    kind, weight, tie, both = STRATEGIES[strategy]
    shared = edges.sparkSession.sparkContext.broadcast((
        _columns(edges, "src", "dst", "w"), _columns(points, "id", "x", "y") if points is not None else None,
        _columns(landmarks, "landmark", "v", "dist") if kind == "landmark" else None,
    ))

    def run(frames):
        links, spots, marked = shared.value
        arcs, back, table = defaultdict(list), defaultdict(list), defaultdict(dict)
        for s, t, w in zip(*(c.tolist() for c in links), strict=True):
            arcs[s].append((t, w))
            back[t].append((s, w))
        place = {i: (x, y) for i, x, y in zip(*(c.tolist() for c in spots), strict=True)} if spots else {}
        for name, v, d in zip(*(c.tolist() for c in marked), strict=True) if marked else ():
            table[name][v] = d

        def plane(goal):
            gx, gy = place.get(goal, (0.0, 0.0))
            return lambda v: math.hypot(place[v][0] - gx, place[v][1] - gy) if v in place else 0.0

        def marks(goal, other):
            gain = lambda d: abs(d.get(other, 0) - d.get(goal, 0)) if other in d and goal in d else -1
            active = [d for d in sorted(table.values(), key=gain, reverse=True)[:ACTIVE] if goal in d]
            return lambda v: max((abs(d[v] - d[goal]) for d in active if v in d), default=0)

        for f in frames:
            out = []
            for s, t in zip(f.src.tolist(), f.dst.tolist(), strict=True):
                hf, hb = (plane(t), plane(s)) if kind == "plane" else (marks(t, s), marks(s, t))
                out.append(two_sided(arcs, back, s, t, hf, hb, weight) if both else best_first(arcs, s, t, hf, weight, tie))
            costs = pd.Series([None if c is None else float(c) for c, _, _ in out], dtype="object")
            yield pd.DataFrame({"src": f.src, "dst": f.dst, "cost": costs, "expanded": [e for _, e, _ in out], "generated": [g for _, _, g in out]})

    return queries.select("src", "dst").mapInPandas(run, "src long, dst long, cost double, expanded long, generated long")


def _columns(rows: DataFrame, *names: str) -> list:
    """Columns as arrays, their number of rows checked before they come to the driver."""
    if rows.count() > KERNEL_EDGES:
        raise ValueError("too many rows for a task; use paths.sssp")
    table = rows.select(*names).toArrow()
    return [table[c].to_numpy() for c in names]


def batch_summary(edges: DataFrame, queries: DataFrame, strategies: list[str], points: DataFrame | None = None,
                  landmarks: DataFrame | None = None, covering: DataFrame | None = None) -> DataFrame:
    """``(strategy, pairs, mean_cost, mean_expanded, mean_generated, worst_ratio, optimal)`` over a batch of queries.

    A name that ends in ``@covering`` runs its strategy on the landmarks chosen by cover.
    """
    best, out = None, None
    for name in ["astar", *[s for s in strategies if s != "astar"]]:
        plain, _, other = name.partition("@")
        found = materialize(search(edges, queries, plain, points, covering if other else landmarks), "batch")
        if best is None:
            best = found.select("src", "dst", F.col("cost").alias("best"))
        ratio = F.coalesce(F.col("cost") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(1.0))
        one = found.join(best, ["src", "dst"]).agg(
            F.count("*").alias("pairs"), F.round(F.avg("cost"), 6).alias("mean_cost"), F.round(F.avg("expanded"), 6).alias("mean_expanded"),
            F.round(F.avg("generated"), 6).alias("mean_generated"), F.round(F.max(ratio), 6).alias("worst_ratio"), F.sum((ratio <= 1.001).cast("long")).alias("optimal"),
        ).select(F.lit(name).alias("strategy"), "*")
        if name in strategies:
            out = one if out is None else out.union(one)
    return out


def suboptimality(results: DataFrame, optimum: DataFrame) -> DataFrame:
    """``(src, dst, ratio, optimal)`` against ``optimum(src, dst, best)``; optimal up to 0.1 %."""
    both = results.join(optimum, ["src", "dst"])
    ratio = F.col("cost") / F.nullif(F.col("best"), F.lit(0))
    return both.select("src", "dst", F.round(ratio, 6).alias("ratio"), (F.coalesce(ratio, F.lit(1.0)) <= 1.001).alias("optimal"))
