import math
import random

import pytest
from pyspark.sql import functions as F

from plexus.operators import bfs, graph, paths, search, spanning


def edges(spark, rows, directed=True):
    df = spark.createDataFrame([(u, v, w) for u, v, w in rows], "src long, dst long, w long")
    return df if directed else df.union(df.select("dst", "src", "w"))


def links(spark, rows, directed=False):
    return edges(spark, [(u, v, 1) for u, v in rows], directed)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def levels(df):
    return {r["v"]: r["dist"] for r in df.collect()}


CHAIN = [(0, 1), (1, 2), (2, 3)]


def test_bfs_chain_parent_and_path(spark):
    found = bfs.bfs(links(spark, CHAIN), ids(spark, 0))
    assert levels(found) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r["v"]: r["parent"] for r in found.collect()} == {0: None, 1: 0, 2: 1, 3: 2}
    way = bfs.trace(found, ids(spark, 3)).orderBy("step").collect()
    assert [r["v"] for r in way] == [0, 1, 2, 3]
    assert [r["v"] for r in bfs.visit_order(found).orderBy("visit_rank").collect()] == [0, 1, 2, 3]


def test_bfs_multi_source_depth_direction_and_errors(spark):
    chain = links(spark, [(i, i + 1) for i in range(6)])
    assert [levels(bfs.bfs(chain, ids(spark, 0, 6)))[v] for v in range(7)] == [0, 1, 2, 3, 2, 1, 0]
    assert set(levels(bfs.bfs(chain, ids(spark, 0), max_depth=2))) == {0, 1, 2}
    one_way = links(spark, [(0, 1), (1, 2), (0, 3)], directed=True)
    assert levels(bfs.bfs(one_way, ids(spark, 2))) == {2: 0}
    with pytest.raises(ValueError):
        bfs.bfs(chain, ids(spark))


@pytest.mark.parametrize("strategy", sorted(bfs.STRATEGIES))
def test_bfs_strategies_agree_on_a_grid_with_diagonals(spark, strategy):
    at = lambda r, c: r * 8 + c
    rows = [(at(r, c), at(r + a, c + b)) for r in range(8) for c in range(8) for a, b in ((0, 1), (1, 0), (1, 1)) if r + a < 8 and c + b < 8]
    found = levels(bfs.bfs(links(spark, rows), ids(spark, 0), strategy=strategy))
    assert found == {at(r, c): max(r, c) for r in range(8) for c in range(8)}


def test_components_and_colouring(spark):
    two = links(spark, [(0, 1), (1, 2), (3, 4), (4, 5)])
    named = {r["v"]: r["component"] for r in bfs.components(two, ids(spark, 9)).collect()}
    assert named == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 9: 9} or named == {9: 9}
    six = bfs.two_colouring(links(spark, [(i, (i + 1) % 6) for i in range(6)])).collect()
    assert all(r["bipartite"] and r["colour"] == r["v"] % 2 for r in six)
    assert not any(r["bipartite"] for r in bfs.two_colouring(links(spark, [(0, 1), (1, 2), (2, 0)])).collect())


def test_components_of_random_graphs_match_union_find(spark):
    from plexus.operators.components import connected_components

    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    sets = spanning.UnionFind()
    for a, b in rows:
        sets.union(a, b)
    members = {}
    for x in {x for r in rows for x in r}:
        members.setdefault(sets.find(x), []).append(x)
    want = {x: min(m) for m in members.values() for x in m if len(m) > 1}
    df = spark.createDataFrame(rows, "a long, b long")
    for one_task in (0, 10_000):
        got = {r["node"]: r["root"] for r in connected_components(df, one_task=one_task).collect()}
        assert got == want
    assert connected_components(df.limit(0)).count() == 0


CLRS = [(0, 1, 3), (0, 2, 8), (0, 4, -4), (1, 3, 1), (1, 4, 7), (2, 1, 4), (3, 0, 2), (3, 2, -5), (4, 3, 6)]


def test_all_pairs_golden(spark):
    pairs = paths.all_pairs(edges(spark, CLRS)).cache()
    d = {(r["a"], r["b"]): r["dist"] for r in pairs.collect()}
    assert d[0, 2] == -3 and d[0, 3] == 2 and d[3, 4] == -2
    assert paths.on_negative_cycle(pairs).isEmpty()
    way = paths.pair_path(pairs, 3, 4)
    assert way[0] == 3 and way[-1] == 4
    assert paths.pair_path(paths.all_pairs(edges(spark, [(0, 1, 5)])), 1, 0) is None
    assert paths.matrix(pairs).count() == 5
    cycle = paths.all_pairs(edges(spark, [(0, 1, 1), (1, 2, -2), (2, 0, -2)]))
    assert not paths.on_negative_cycle(cycle).isEmpty()


CITY = [(1, 2, 466), (1, 3, 579), (2, 4, 315), (3, 5, 244), (5, 4, 405), (2, 5, 535)]


def test_shortest_paths_golden(spark):
    letters = edges(spark, [(1, 2, 1), (2, 3, 2), (1, 4, 4), (2, 5, 3), (3, 6, 1), (4, 5, 5), (5, 6, 1)], False)
    assert paths.shortest_path(letters, 1, 6) == (4, [1, 2, 3, 6])
    assert paths.shortest_path(letters, 1, 1) == (0, [1])
    assert paths.shortest_path(edges(spark, CITY, False), 1, 4) == (781, [1, 2, 4])
    assert paths.shortest_path(edges(spark, [(1, 2, 5)]), 2, 1) == (None, None)
    with pytest.raises(KeyError):
        paths.sssp(letters, 99)
    with pytest.raises(ValueError):
        graph.Graph.of(edges(spark, [(0, 1, -1)]), nonnegative=True)
    assert paths.sssp(edges(spark, [(1, 2, 5)]), 3, nodes=ids(spark, 3)).count() == 1


@pytest.mark.parametrize("strategy", ["full", "frontier", "adaptive", "kernel"])
def test_sssp_strategies_agree(spark, strategy):
    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 50)) for _ in range(240)]
    arcs = {}
    for u, v, w in rows:
        arcs.setdefault(u, []).append((v, w))
    got = {r["v"]: r["dist"] for r in paths.sssp(edges(spark, rows), rows[0][0], strategy).collect()}
    assert got == paths.dijkstra(arcs, rows[0][0])


def test_negative_weights_and_cycles(spark):
    assert {r["v"]: r["dist"] for r in paths.sssp(edges(spark, CLRS), 0).collect()} == {0: 0, 1: 1, 2: -3, 3: 2, 4: -4}
    assert not paths.has_negative_cycle(edges(spark, CLRS), 0)
    assert paths.has_negative_cycle(edges(spark, [(0, 1, 1), (1, 2, -2), (2, 0, -2)]), 0)
    with pytest.raises(ValueError):
        paths.sssp(edges(spark, CLRS), 0, "kernel")
    star = edges(spark, [(0, i, i) for i in range(1, 1001)])
    got = {r["v"]: r["dist"] for r in paths.sssp(star, 0).collect()}
    assert got[500] == 500 and got[1000] == 1000


def undirected(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w long")


MST = [(0, 1, 4), (0, 7, 8), (1, 2, 8), (1, 7, 11), (2, 3, 7), (2, 5, 4), (2, 8, 2), (3, 4, 9), (3, 5, 14), (4, 5, 10), (5, 6, 2), (6, 7, 1), (6, 8, 6), (7, 8, 7)]
FORESTS = [
    (MST, 9, 37, 1), ([(0, 1, 1), (1, 2, 2), (0, 2, 3)], 3, 3, 1), ([(0, 1, 5), (2, 3, 3)], 4, 8, 2), ([(0, 1, 10), (0, 1, 2), (1, 0, 5)], 2, 2, 1),
    ([(0, 1, -3), (1, 2, -1), (0, 2, -5)], 3, -8, 1), ([(i, i + 1, i + 1) for i in range(4)], 5, 10, 1),
    ([(a, b, 1) for a in range(5) for b in range(a + 1, 5)], 5, 4, 1), ([], 1, 0, 1),
]


@pytest.mark.parametrize("strategy", spanning.STRATEGIES)
def test_spanning_forests(spark, strategy):
    same = {}
    for k, (rows, n, total, parts) in enumerate(FORESTS):
        found = spanning.spanning_forest(undirected(spark, rows), strategy)
        got = spanning.summary(found, n).first()
        assert (got["total"], got["n_components"], got["spanning"]) == (total, parts, parts == 1)
        same[k] = sorted(map(tuple, found.select("u", "v", "w").collect()))
        assert same[k] == sorted(spanning._kruskal([(w, min(u, v), max(u, v)) for u, v, w in rows if u != v]))


def test_strata_cover_all_edges_and_join_to_the_same_tree(spark):
    from plexus.sources import generators

    e = generators.random_graph(spark, 120, 900, seed=4).cache()
    cut, n = spanning.strata(e)
    assert n > 1 and cut.count() == e.count()
    trees = [sorted(map(tuple, spanning.spanning_forest(e, s).select("u", "v", "w").collect())) for s in ("strata", "kruskal", "contract")]
    assert trees[0] == trees[1] == trees[2] and len(trees[0]) == 119
    profile = spanning.strata_profile(e, spanning.spanning_forest(e, "prim")).agg(F.sum("edges"), F.sum("tree_edges")).first()
    assert tuple(profile) == (e.count(), 119)


def test_union_find():
    sets = spanning.UnionFind(range(5))
    assert sets.union(0, 1) and sets.union(1, 2) and not sets.union(0, 2)
    assert sets.connected(0, 2) and not sets.connected(0, 3) and sets.n_components == 3


def test_search_strategies_on_a_grid(spark):
    from plexus.sources import generators

    g = generators.grid(spark, 9, 9, seed=2).cache()
    sym = graph.symmetric(g).cache()
    points = spark.range(81).select("id", (F.col("id") % 9).cast("double").alias("x"), F.floor(F.col("id") / 9).cast("double").alias("y"))
    asked = spark.createDataFrame([(0, 80), (3, 70), (44, 44), (8, 72), (10, 61)], "src long, dst long")
    marks = search.farthest_landmarks(sym, 4)
    assert marks.select("landmark").distinct().count() == 4
    arcs = {}
    for r in sym.collect():
        arcs.setdefault(r["src"], []).append((r["dst"], r["w"]))
    want = {(r["src"], r["dst"]): paths.dijkstra(arcs, r["src"])[r["dst"]] for r in asked.collect()}
    for strategy, (_, weight, _, _) in search.STRATEGIES.items():
        for r in search.search(sym, asked, strategy, points, marks).collect():
            best = want[r["src"], r["dst"]]
            assert best - 1e-9 <= r["cost"] <= weight * best + 1e-9
    bounds = search.landmark_bounds(marks, asked).collect()
    assert all(r["bound"] <= want[r["src"], r["dst"]] for r in bounds)
    less = {(r["src"], r["dst"]): r["bound"] for r in search.landmark_bounds(marks, asked, 1).collect()}
    assert less == {(r["src"], r["dst"]): r["bound"] for r in bounds}
    assert search.covering_landmarks(sym, 4).select("landmark").distinct().count() == 4
    alone = search.search(edges(spark, [(0, 1, 3)]), spark.createDataFrame([(1, 0)], "src long, dst long")).first()
    assert alone["cost"] is None
    best = spark.createDataFrame([(s, t, float(w)) for (s, t), w in want.items()], "src long, dst long, best double")
    assert all(r["optimal"] for r in search.suboptimality(search.search(sym, asked, "astar", points), best).collect())


def test_graph_containers(spark):
    g = graph.Graph.of(edges(spark, [(0, 1, 2), (0, 2, 3)]), ids(spark, 9), directed=False)
    assert g.nodes.count() == 4 and g.edges.count() == 4
    assert [tuple(r) for r in graph.hubs(g.edges).collect()] == [(0, 2)]
    assert math.isclose(spark.range(1).select(graph.synth_weight(F.lit(3), F.lit(5)).alias("w")).first()["w"], _weight(3, 5))


def _weight(u, v):
    m = 0xFFFFFFFF
    h = ((u * 2654435761) & m) ^ ((v * 2246822519) & m)
    h ^= h >> 16
    return (h % 9901 + 100) / 100
