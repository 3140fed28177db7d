"""Graph and sequence operators at sizes beyond one task, one number type or one expression."""

import contextlib
import io
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexus.operators import metrics, paths, spanning
from plexus.sources import generators


def test_geometric_meets_cells_once_without_broadcast(spark):
    spots = generators.points(spark, 300, 5).select("id", (F.col("x") - 0.5).alias("x"), (F.col("y") - 0.5).alias("y"))
    found = generators.geometric(spots, 0.15)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        found.explain()
    assert "Broadcast" not in said.getvalue()
    at = [tuple(r) for r in spots.collect()]
    want = {(u, v) for u, ux, uy in at for v, vx, vy in at if u < v and ((ux - vx) ** 2 + (uy - vy) ** 2) ** 0.5 <= 0.15}
    rows = [(r["u"], r["v"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_geometric_takes_tasks_by_pairs_and_cuts_full_cells(spark, monkeypatch):
    """200 points in one cell and some outside: few bytes, so no plan gives them tasks by itself."""
    monkeypatch.setattr(generators, "SLICE_POINTS", 40, raising=False)
    monkeypatch.setattr(generators, "TASK_PAIRS", 10_000, raising=False)
    near = generators.points(spark, 200, 5).select("id", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))
    spots = near.union(generators.points(spark, 60, 6).select(F.col("id") + 200, "x", "y"))
    found = generators.geometric(spots, 0.15)
    at = [tuple(r) for r in spots.collect()]
    want = {(u, v) for u, ux, uy in at for v, vx, vy in at if u < v and ((ux - vx) ** 2 + (uy - vy) ** 2) ** 0.5 <= 0.15}
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    rows = [(r["u"], r["v"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert found.rdd.getNumPartitions() >= 18 and max(sizes) < len(rows) / 2


@pytest.mark.parametrize("strategy", ["kruskal", "heap", "prim", "prim_fibonacci"])
@pytest.mark.parametrize("nodes, most", [(40, 100), (400, 100)])
def test_forests_of_more_edges_than_a_task_holds(spark, monkeypatch, strategy, nodes, most):
    """Parts alone suffice for 40 nodes; 400 have a forest that is larger than a task's edges itself."""
    monkeypatch.setattr(spanning, "KERNEL_EDGES", most)
    edges = generators.random_graph(spark, nodes, 900, 3, "clustered", False)
    edges = edges.union(edges.select(F.col("u") + 1000, F.col("v") + 1000, F.col("w") % 7))
    found = spanning.spanning_forest(edges, strategy)
    assert found.columns == ["u", "v", "w"]
    rows = [(r["w"], min(r["u"], r["v"]), max(r["u"], r["v"])) for r in edges.collect()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(spanning._kruskal(rows))


def test_prim_with_a_fibonacci_heap_holds_few_bytes_an_edge():
    """Two graphs side by side, with parallel edges and equal weights."""
    rng = np.random.default_rng(3)
    u = rng.integers(0, 3000, 40_000)
    v = u // 1500 * 1000 + rng.integers(10_000, 11_000, 40_000)
    w = rng.integers(0, 5000, 40_000)
    table = pa.table({"a": u, "b": v, "w": w, "u": u, "v": v})
    tracemalloc.start()
    found = spanning._forest_of(table, "prim_fibonacci")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * table.num_rows
    got = sorted(zip(*(found[c].to_pylist() for c in "uvw"), strict=True))
    assert got == sorted(spanning._kruskal(list(zip(w.tolist(), u.tolist(), v.tolist(), strict=True))))


def test_forests_past_their_own_bound_go_by_parts(spark, monkeypatch):
    monkeypatch.setattr(spanning, "FOREST_EDGES", 300, raising=False)
    parts, one = [], spanning._kernel_parts
    monkeypatch.setattr(spanning, "_kernel_parts", lambda e, s, n: parts.append(n) or one(e, s, n))
    edges = generators.random_graph(spark, 60, 900, 3, "clustered", False)
    rows = [(r["w"], min(r["u"], r["v"]), max(r["u"], r["v"])) for r in edges.collect()]
    assert sorted(tuple(r) for r in spanning.spanning_forest(edges, "prim_fibonacci").collect()) == sorted(spanning._kruskal(rows))
    assert parts[0] > 1 and parts[-1] == 1


@pytest.mark.parametrize("most", [700, 50])
def test_kernel_of_more_edges_than_a_task_holds(spark, monkeypatch, most):
    """Two graphs side by side: what the source reaches fits a task, or is cut into blocks."""
    monkeypatch.setattr(paths, "KERNEL_EDGES", most)
    monkeypatch.setattr(paths, "BLOCK_EDGES", 100)
    one = generators.random_graph(spark, 60, 250, 3)
    e = one.union(one.select(F.col("u") + 100, F.col("v") + 100, "w"))
    both = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(e.select("v", "u", "w"))
    assert sorted(paths.sssp(both, 0, "kernel").collect()) == sorted(paths.sssp(both, 0, "frontier").collect())


def test_kernel_settles_long_ways_of_light_edges_in_one_task(spark, monkeypatch):
    """A chain of light edges among heavy ones: as many hops as nodes, but few rounds over all edges."""
    monkeypatch.setattr(paths, "KERNEL_EDGES", 50)
    monkeypatch.setattr(paths, "BLOCK_EDGES", 100)
    levels, one = [], paths.Levels.append
    monkeypatch.setattr(paths.Levels, "append", lambda self, rows: levels.append(1) or one(self, rows))
    light = [(i, i + 1, 1) for i in range(40)]
    heavy = [(i, (7 * i + k) % 41, 1000 + i) for i in range(41) for k in (3, 11)]
    e = spark.createDataFrame([(u, v, w) for a, b, w in light + heavy for u, v in ((a, b), (b, a))], "src long, dst long, w long")
    assert sorted(tuple(r)[:2] for r in paths.sssp(e, 0, "kernel").collect()) == [(i, i) for i in range(41)]
    assert len(levels) < 8


def test_wilcoxon_of_millions_of_differences(spark):
    rows = spark.range(1_800_000).select(F.lit(0).cast("long").alias("a"), (F.col("id") % 7 - 2).alias("b"))
    got = metrics.wilcoxon(rows, "a", "b").first()
    n = rows.filter("b <> 0").count()
    up, down = {1: 257143, 2: 257143, 3: 257143, 4: 257142}, {1: 257143, 2: 257143}
    up = {k: rows.filter(F.col("b") == k).count() for k in up}
    down = {k: rows.filter(F.col("b") == -k).count() for k in down}
    below = plus = minus = 0
    for k in sorted(up):
        rank = below + (up[k] + down.get(k, 0) + 1) / 2
        plus, minus, below = plus + up[k] * rank, minus + down.get(k, 0) * rank, below + up[k] + down.get(k, 0)
    z = (abs(plus - minus) / 2 - 0.5) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
    assert (got["n"], got["w_plus"], got["w_minus"]) == (n, plus, minus) and got["z"] == pytest.approx(z, abs=1e-6)


def test_hundreds_of_strata(spark):
    edges = generators.random_graph(spark, 300, 4000, 3).withColumn("w", (F.xxhash64("u", "v") % 100_000).cast("long"))
    edges = edges.union(spark.createDataFrame([(1, 2, None)], edges.schema))
    cuts = [float(c) for c in range(-99_000, 99_000, 330)]
    got = spanning._numbered(edges, cuts).collect()
    assert all(r["stratum"] == (None if r["w"] is None else sum(r["w"] > c for c in cuts)) for r in got)


def test_strata_come_in_doubling_rounds(spark, monkeypatch):
    """A graph of two components never spans, so every stratum is looked at."""
    edges = generators.random_graph(spark, 100, 2000, 3, "power", False)
    edges = edges.union(edges.select(F.col("u") + 1000, F.col("v") + 1000, F.col("w")))
    rounds, one = [], spanning._boruvka
    monkeypatch.setattr(spanning, "strata", lambda e: (spanning._numbered(e, [float(c) for c in range(10, 50)]), 41))
    monkeypatch.setattr(spanning, "_boruvka", lambda *a: rounds.append(1) or one(*a))
    found = sorted(tuple(r) for r in spanning.spanning_forest(edges, "strata").collect())
    rows = [(r["w"], min(r["u"], r["v"]), max(r["u"], r["v"])) for r in edges.collect()]
    assert found == sorted(spanning._kruskal(rows)) and len(rounds) == 3
