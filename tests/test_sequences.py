import itertools
import random

import pytest
from pyspark.sql import functions as F

from plexus.operators import keyed, markov, metrics, sequences, sorting


def test_sorts(spark):
    words = spark.createDataFrame(list(enumerate(["banana", "apple", "fig", "cherry", "kiwi"])), "seq long, s string")
    up = [r["s"] for r in sorting.sort_by(words, F.length("s"), seq="seq").collect()]
    down = [r["s"] for r in sorting.sort_by(words, F.length("s"), seq="seq", reverse=True).collect()]
    assert up == ["fig", "kiwi", "apple", "banana", "cherry"] and down == ["banana", "cherry", "apple", "kiwi", "fig"]
    rng = random.Random(1)
    rows = [(rng.randrange(6), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, seq long")
    ranked = sorting.rank_all(df, [F.col("k"), F.col("seq")]).orderBy("rank").collect()
    assert [(r["k"], r["seq"]) for r in ranked] == sorted(rows)
    assert sorting.is_sorted(df, "seq", "seq") and not sorting.is_sorted(df, "seq", "k")
    assert sorting.rank_all(df.limit(0), [F.col("k")]).count() == 0
    runs = sorting.running_sums(df, [F.col("seq")], {"total": "k"}).orderBy("seq").collect()
    assert [r["total"] for r in runs] == list(itertools.accumulate(k for k, _ in rows))
    sides = {r["side"]: r["n"] for r in sorting.three_way(df, "k", 2).groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert sides[1] == sum(k == 2 for k, _ in rows)
    assert [r["seq"] for r in sorting.top_k(df, 3, F.desc("k"), F.col("seq")).collect()] == [i for k, i in sorted(rows, key=lambda r: (-r[0], r[1]))][:3]


def test_knn_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(9) * 1.0, rng.randrange(9) * 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {}
    for r in sorting.knn(df, df, 4, block=25).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for i, x in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in rows if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_store_replays_like_a_dict(spark):
    rng, want, log = random.Random(5), {}, []
    for seq in range(3000):
        k = rng.randrange(200)
        if rng.random() < 0.6:
            want[k] = seq
            log.append((seq, "set", k, seq))
        elif k in want:
            del want[k]
            log.append((seq, "del", k, None))
    df = spark.createDataFrame(log, "seq long, op string, k long, v long")
    assert {r["k"]: r["v"] for r in keyed.replay(df).collect()} == want
    assert keyed.missing_deletes(df).isEmpty()
    assert keyed.replay(df.union(spark.createDataFrame([(9999, "clear", None, None)], df.schema))).isEmpty()


def test_store_operations(spark):
    store = spark.createDataFrame([(k, 2 * k) for k in range(20)], "k long, v long")
    keys = spark.createDataFrame([(1,), (99,)], "k long")
    assert {r["k"]: r["v"] for r in keyed.lookup(store, keys, -1).collect()} == {1: 2, 99: -1}
    assert [r["k"] for r in keyed.contains(store, keys).collect()] == [1]
    with pytest.raises(KeyError):
        keyed.remove(store, keys)
    with pytest.raises(KeyError):
        keyed.get_item(store, 99)
    value, rest = keyed.pop(store, 3)
    assert value == 6 and rest.count() == 19 and keyed.pop(store, 99, None)[0] is None
    assert keyed.get_item(keyed.put(store, spark.createDataFrame([(3, 7)], "k long, v long")), 3) == 7
    s = keyed.stats(store).first()
    assert (s["size"], s["capacity"]) == (20, 32) and 0.15 <= s["load_factor"] <= 0.70
    assert keyed.probe_lengths(store, 32).agg(F.sum("n")).first()[0] == 20 and keyed.clear(store).isEmpty()


def test_knapsack_and_lcs(spark):
    one = spark.createDataFrame([([(2, 3), (3, 4), (4, 5)],)], "items array<struct<w:int,v:long>>")
    assert one.select(sequences.knapsack(F.col("items"), 5).alias("b")).first()["b"] == 7
    rng = random.Random(9)
    words = [("ABCDGH", "AEDFHR"), ("", "AB"), ("AB", "")] + [("".join(rng.choices("abc", k=8)), "".join(rng.choices("abc", k=7))) for _ in range(12)]
    got = spark.createDataFrame(words, "x string, y string").select("x", "y", sequences.lcs_length(F.col("x"), F.col("y")).alias("n")).collect()

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0, *itertools.accumulate(range(1, len(y) + 1), lambda last, j, r=row, a=a: r[j - 1] + 1 if y[j - 1] == a else max(r[j], last), initial=0)][1:]
        return row[-1]

    assert got[0]["n"] == 3 and all(r["n"] == lcs(r["x"], r["y"]) for r in got)


def test_huffman(spark):
    texts = spark.createDataFrame([(1, "MISSISSIPPI"), (2, "aaaa"), (3, "")], "g long, text string")
    book = sequences.huffman(sequences.symbol_counts(texts, "g", "text"), "g").cache()
    size = {r["g"]: r for r in sequences.sizes(book, "g").collect()}
    assert size[1]["coded_bits"] == 21 and size[1]["kraft"] == 1.0 and size[2]["coded_bits"] == 4
    back = sequences.decode(sequences.encode(texts, book, "g", "text"), book, "g").collect()
    assert {r["g"]: r["decoded"] for r in back} == {1: "MISSISSIPPI", 2: "aaaa", 3: ""}


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1)], "s double, y int")
    assert metrics.auroc(rows, "s", "y").first()[0] == round((2 + 1.5 + 0) / 6, 6)
    assert metrics.auroc(rows.filter("y = 1"), "s", "y").first()[0] == 0.5
    assert metrics.best_f1(rows, "s", "y").first()["best_f1"] == 0.75
    assert metrics.confusion(rows.withColumn("p", F.col("y")), "p", "y").first()["f1"] == 1.0
    steps = spark.createDataFrame([(1, t, s, y) for t, (s, y) in enumerate([(0, 0), (0, 1), (9, 1), (0, 0), (9, 1), (0, 0), (0, 1)])], "g long, t long, s long, y int")
    got = metrics.detection_delay(steps, "g", "t", "s", "y", 5).first()
    assert (got["bursts"], got["detected"], got["mean_delay"]) == (3, 2, 0.5)
    pairs = spark.createDataFrame([(0, d) for d in (1, 2, -3, 4, 5, 0)], "a long, b long")
    w = metrics.wilcoxon(pairs, "a", "b").first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (5, 12.0, 3.0) and w["z"] > 0
    assert metrics.bootstrap_auroc(rows.withColumn("k", F.monotonically_increasing_id()), "k", "s", "y", 2, 5).count() == 2
    a = spark.createDataFrame([(1, 1.0)], "k long, v double")
    assert metrics.equivalent(a, a, ["k"], "v") and not metrics.equivalent(a, a.withColumn("v", F.lit(2.0)), ["k"], "v")
    res = spark.createDataFrame([("g1", "a", 1.0), ("g1", "b", 2.0), ("g2", "b", 1.0)], "c string, m string, t double")
    assert {r["contender"]: r["wins"] for r in metrics.wins(res, "c", "m", "t").collect()} == {"a": 1, "b": 1}


def _paths(m, obs):
    return max(
        (sum([m.lpi[p[0]] + m.lb[p[0], obs[0]]] + [m.lw[a, b] + m.lb[b, o] for a, b, o in zip(p, p[1:], obs[1:], strict=False)]), [-x for x in p])
        for p in itertools.product(range(len(m.states)), repeat=len(obs))
    )


def test_chains_and_decoding(spark):
    from plexus.sources import generators

    chain = generators.block_chain(spark, 12, 3, 3, seed=2).cache()
    for r in chain.groupBy("i").agg(F.sum("p").alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9
    for r in markov.power(chain, 3).groupBy("i").agg(F.sum("p").alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9
    for r in markov.ricci_flow(chain, 2).groupBy("i").agg(F.sum("w").alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9
    assert all(-1 - 1e-9 <= r["orc"] <= 1 + 1e-9 for r in markov.transport_curvature(chain).collect())
    bound = markov.curvature_bound(chain, 3)
    f = markov.test_function(chain.select(F.col("i").alias("x")).distinct(), 0)
    assert markov.residual(chain, f, bound).filter("residual < 0").isEmpty()
    emit = generators.emissions(spark, 12, 4, 3).cache()
    prior = spark.range(12).select(F.col("id").alias("state"), F.lit(1 / 12).alias("p"))
    m = markov.model(chain, emit, prior)
    marked = generators.bridges(markov.overlap_curvature(chain))
    walked = generators.walks(chain, emit, 6, 5, marked).cache()
    assert walked.count() == 30 and walked.filter("label = 1").count() > 0
    plain = markov.decode(walked.select("seq", "t", "symbol"), m).cache()
    for seq in range(3):
        obs = [m.symbols[r["symbol"]] for r in walked.filter(F.col("seq") == seq).orderBy("t").collect()]
        score, _ = _paths(m, obs)
        assert abs(plain.filter(F.col("seq") == seq).first()["score"] - score) < 1e-9
    free = markov.decode(walked, m, "field", 1e-9, bound)
    assert metrics.agreement(plain, free, ["seq", "t"], "state").first()["share"] == 1.0
    edge = markov.decode(walked, m, "edge", 0.2, edges={None: 0.5})
    assert markov.path_penalty(edge).count() == 6
    assert spark.range(1).select(markov.sequence_threshold(10, 0.2, 0.05, F.lit(100.0)).alias("t")).first()["t"] > 0
    assert abs(markov.crossover_length(8.0, 1.0) - 4.0) < 1e-9
