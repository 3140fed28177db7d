import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.operators import keyed, markov, paths, search, sequences, sorting, spanning
from plexus.plans.loops import Levels
from plexus.sources import generators, graphs


def test_fibonacci_heap_against_binary_heap():
    rng = random.Random(3)
    heap, best = spanning.FibonacciHeap(), {}
    for _ in range(4000):
        if best and rng.random() < 0.4:
            key, item = heap.pop()
            assert key == min(best.values()) and best.pop(item) == key
        else:
            item, key = rng.randrange(300), rng.random()
            heap.push(item, key)
            best[item] = min(best.get(item, key), key)
    assert sorted(best.values()) == [heap.pop()[0] for _ in range(len(best))] and not heap


def dijkstra(arcs, source):
    dist, todo = {source: 0}, [(0, source)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > dist[u]:
            continue
        for v, w in arcs.get(u, ()):
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return dist


@pytest.mark.parametrize("strategy", paths.ROUNDS)
def test_rounds_against_dijkstra(spark, strategy):
    rng = random.Random(4)
    arcs = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 60)) for _ in range(300)] + [(k, k + 1, 3) for k in range(60, 66)] + [(0, 60, 5)]
    of = {}
    for u, v, w in arcs:
        of.setdefault(u, []).append((v, w))
    edges = spark.createDataFrame(arcs, "src long, dst long, w long")
    assert {r["v"]: r["dist"] for r in paths.sssp(edges, 0, strategy).collect()} == dijkstra(of, 0)
    looped = spark.createDataFrame([(1, 2, -4), (2, 1, 3), (0, 1, 1)], "src long, dst long, w long")
    with pytest.raises(paths.NegativeCycle):
        paths.sssp(looped, 0, strategy)


def test_merged_levels(spark):
    levels = Levels(spark.range(1), "t")
    for k in range(3):
        levels.append(spark.range(k, k + 2))
    merged = levels.merged(lambda rows: rows.distinct())
    assert merged.n == 1 and sorted(r["id"] for r in merged.all().collect()) == [0, 1, 2, 3]


def test_nearest_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(300, 5)), np.ones((40, 5))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for block in (None, 3):
        got = {}
        for r in sorting.knn(df, df.filter("id % 30 = 0"), 7, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        for q, found in got.items():
            far = ((x - x[q]) ** 2).sum(axis=1)
            assert found == [i for i in np.lexsort((np.arange(len(x)), far)).tolist() if i != q][:7]
    assert sorting.knn(df, df.limit(0), 3).count() == 0


def probes(keys, capacity):
    """Robin Hood insertion, one key after the other."""
    table = {}
    for k in keys:
        home = k * keyed.HASH_MULTIPLIER % capacity
        at, far = home, 0
        while at in table:
            if (table[at][1], -table[at][0]) < (far, -k):
                table[at], (k, far) = (k, far), table[at]
            at, far = (at + 1) % capacity, far + 1
        table[at] = (k, far)
    return table


def test_probe_lengths_against_insertion(spark):
    rng = random.Random(6)
    for size, capacity in ((0, 8), (5, 8), (44, 64), (700, 1024)):
        keys = rng.sample(range(10**6), size)
        store = spark.createDataFrame([(k, 0) for k in keys], "k long, v long")
        got = [r["probe"] for r in keyed.probes(store, capacity).collect()]
        want = [far for _, far in probes(keys, capacity).values()]
        assert sum(got) == sum(want) and max(got, default=0) == max(want, default=0)
    assert keyed.shrunk(spark.createDataFrame([(1, 1)], "k long, v long"), 1024) == 8


def test_nearest_roads_and_planar_roads(spark):
    spots = generators.points(spark, 200, 3)
    rows = {r["id"]: (r["x"], r["y"]) for r in spots.collect()}
    want = set()
    for i, (x, y) in rows.items():
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, (a, b) in rows.items() if j != i)[:4]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    assert {(r["u"], r["v"]) for r in generators.nearest(spots).collect()} == want
    assert generators.nearest(spots.limit(1)).count() == 0
    places, edges = generators.planar_road(spark, 8)
    at = {r["id"]: (r["x"], r["y"]) for r in places.collect()}
    for r in edges.collect():
        (a, b), (c, d) = at[r["u"]], at[r["v"]]
        assert abs(r["w"] - ((a - c) ** 2 + (b - d) ** 2) ** 0.5) < 1e-12 and abs(r["u"] % 8 - r["v"] % 8) <= 1


def test_load_tells_of_a_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        graphs.load(spark, str(tmp_path / "none.mtx"))


def test_decoding_in_place(spark):
    texts = spark.createDataFrame([("a", "hello"), ("a", "help"), ("b", "zzz"), ("b", None), ("c", "")], "g string, t string")
    book = sequences.huffman(sequences.symbol_counts(texts, "g", "t"), "g")
    back = sequences.decode(sequences.encode(texts, book, "g", "t"), book, "g")
    assert sorted((r["g"], r["t"] or "", r["decoded"] or "") for r in back.collect()) == [("a", "hello", "hello"), ("a", "help", "help"), ("b", "", ""), ("b", "zzz", "zzz"), ("c", "", "")]


def test_field_over_two_hops(spark):
    chain = spark.createDataFrame([(i, j, p) for i, row in enumerate([[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]]) for j, p in enumerate(row)], "i long, j long, p double")
    emit = spark.createDataFrame([(i, s, p) for i, row in enumerate([[0.8, 0.2], [0.3, 0.7], [0.5, 0.5]]) for s, p in enumerate(row)], "state long, symbol long, p double")
    prior = spark.createDataFrame([(i, 1 / 3) for i in range(3)], "state long, p double")
    m = markov.model(chain, emit, prior)
    seqs = spark.createDataFrame([(1, t, int(t * 7 % 3 == 0)) for t in range(12)], "seq long, t long, symbol long")
    one, two = (markov.decode(seqs, m, "field", 0.2, -0.5, hops=h).orderBy("t").collect() for h in (1, 2))
    assert len(one) == len(two) == 12 and [r["signal"] for r in one] != [r["signal"] for r in two]
    along = markov.decode(seqs, m, "field", 0.2, -0.5, own_path=False).orderBy("t").collect()
    assert [r["state"] for r in along] == [r["state"] for r in one] and along[0]["signal"] == 0
    squared = {(r["i"], r["j"]): r["p"] for r in markov.power(chain, 2).collect()}
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]])
    assert all(abs(v - (p @ p)[k]) < 1e-12 for k, v in squared.items())
    assert abs(markov.hop_bound(chain, 1) - markov.curvature_bound(chain)) < 1e-12


def test_searches_expand_no_more_with_a_bound(spark):
    places, edges = generators.planar_road(spark, 12)
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(edges.select("v", "u", "w"))
    pairs = spark.createDataFrame([(0, 143), (5, 130), (77, 12), (3, 3)], "src long, dst long")
    plain = {(r["src"], r["dst"]): r for r in search.search(both, pairs, "astar").collect()}
    for name in ("astar", "two_sided", "weighted_1.5", "weighted_2.0"):
        factor = float(name.rpartition("_")[2]) if name.startswith("weighted") else 1.0
        for r in search.search(both, pairs, name, places).collect():
            best = plain[(r["src"], r["dst"])]
            assert best["cost"] - 1e-9 <= r["cost"] <= factor * best["cost"] + 1e-9 and r["expanded"] <= best["expanded"]
