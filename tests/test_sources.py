import pytest
from pyspark.sql import functions as F

from plexus.sources import generators, graphs


def save(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_lists(spark, tmp_path):
    path = save(tmp_path, "g.txt", "# head\n1\t2\n2 3\n3 3\nbad line\n1 2\n")
    assert graphs.snap(spark, path).count() == 6
    assert rows(graphs.snap_weighted(spark, save(tmp_path, "w.txt", "% x\n2 1 -5 99\n1 2 3\n4 5 0\n"))) == [(1, 2, 3.0), (4, 5, _weight(4, 5))]


def _weight(u, v):
    h = ((u * 2654435761) & 0xFFFFFFFF) ^ ((v * 2246822519) & 0xFFFFFFFF)
    h ^= h >> 16
    return (h % 9901 + 100) / 100


def test_matrix_trust_and_dispatch(spark, tmp_path):
    mtx = save(tmp_path, "m.mtx", "%%MatrixMarket matrix coordinate real general\n% c\n3 3 3\n1 2 4.5\n2 2 1\n3 1 2\n")
    assert rows(graphs.load(spark, mtx)) == [(0, 1, 4.5), (2, 0, 2.0)]
    csv = save(tmp_path, "t.csv", "1,2,10,100\n2,1,-3,101\n3,3,1,1\n")
    assert rows(graphs.load(spark, csv)) == [(1, 2, 1)]
    assert rows(graphs.signed_trust(spark, csv, undirected=False)) == [(1, 2, 10), (2, 1, -3)]
    with pytest.raises(ValueError):
        graphs.load(spark, csv, "nothing")


def test_transfers(spark, tmp_path):
    line = "1,x,y,0xA,0xB,z,{}\n"
    path = save(tmp_path, "e.csv", "block,a,b,c,d,e,f\n" + line.format(1000) + line.format(-1) + "1,x,y,0xC,0xD,z,5\n" + line.format(1e-30))
    assert rows(graphs.transfers(spark, path, hubs=2)) == [("0xa", "0xb", -3), ("0xa", "0xb", 20), ("0xa", "0xb", 20)]
    assert rows(graphs.exchange_transfers(spark, save(tmp_path, "x.csv", "src,dst,amount\na,b,1234.5\na,a,1\n"))) == [("a", "b", 4)]


def test_grids(spark, tmp_path):
    path = save(tmp_path, "a.map", "type octile\nheight 2\nwidth 3\nmap\n.S@\n...\n")
    cells, edges = graphs.grid_map(spark, path)
    assert cells.count() == 5
    w = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert w[0, 1] == 1.5 and abs(w[0, 4] - 2 ** 0.5 * 1) < 1e-6 and (1, 5) not in w and w[4, 5] == 1.0
    scen = save(tmp_path, "a.scen", "version 1\n" + "".join(f"0\ta.map\t3\t2\t0\t0\t2\t1\t{k}.5\n" for k in range(10)))
    assert graphs.scenarios(spark, scen).count() == 10 and graphs.scenarios(spark, scen, 3).count() == 3


def test_transactions(spark, tmp_path):
    features = save(tmp_path, "f.csv", "".join(f"{i},{1 + i % 3},{i / 10},{i / 5}\n" for i in range(1, 21)))
    classes = save(tmp_path, "c.csv", "txId,class\n" + "".join(f"{i},{[1, 2, 'unknown'][i % 3]}\n" for i in range(1, 21)))
    links = save(tmp_path, "l.csv", "txId1,txId2\n1,3\n1,4\n2,3\n3,4\n")
    nodes, edges = graphs.transactions(spark, features, classes, links, buckets=4)
    assert nodes.filter("label is null").isEmpty() and nodes.count() == 13
    assert nodes.agg(F.max("bucket")).first()[0] == 3
    for r in edges.groupBy("src").agg(F.sum("w").alias("w")).collect():
        assert abs(r["w"] - 1) < 1e-9


def test_small_tools(spark, tmp_path):
    e = spark.createDataFrame([(10, 30, 1), (30, 20, 2), (10, 30, 1), (20, 20, 1)], "src long, dst long, w long")
    dense, names = graphs.dense_ids(e)
    assert {r["old"]: r["id"] for r in names.collect()} == {10: 0, 20: 1, 30: 2} and dense.count() == 4
    assert rows(graphs.stochastic(e)) == [(10, 30, 1.0), (30, 20, 1.0)]
    graphs.write_results(e, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4


def test_generators_repeat_and_hold_their_shape(spark):
    made = {
        "random": generators.random_graph(spark, 50, 200), "preferential": generators.preferential(spark, 50, 2), "grid": generators.grid(spark, 5, 4),
        "maze": generators.maze(spark, 5, 4), "path": generators.path(spark, 6), "complete": generators.complete(spark, 6),
        "negative": generators.negative_arcs(spark, 30, 90), "rates": generators.exchange_rates(spark, 4, 3), "trust": generators.trust(spark, 40, 100),
    }
    for df in made.values():
        assert rows(df) == rows(df) and df.count() > 0
    assert made["grid"].count() == 31 and made["maze"].count() == 19 and made["complete"].count() == 15
    from plexus.operators.paths import has_negative_cycle

    assert not has_negative_cycle(made["negative"], 0)
    assert made["trust"].filter("w < 0").count() > 0
    for kind in ("power", "clustered", "normal", "unit"):
        assert generators.random_graph(spark, 20, 40, weights=kind).filter("w < 1").isEmpty()
    places = generators.points(spark, 60)
    near = {(r["u"], r["v"]) for r in generators.geometric(places, 0.3).collect()}
    p = {r["id"]: (r["x"], r["y"]) for r in places.collect()}
    assert near == {(a, b) for a in p for b in p if a < b and (p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2 <= 0.09}


def test_streamed_store(spark, tmp_path):
    from plexus.operators import keyed
    from plexus.streaming import store

    schema = "seq long, op string, k long, v double"
    log = [(s, "del" if s % 7 == 0 else "set", s % 5, float(s)) for s in range(1, 60)]
    for part in range(3):
        spark.createDataFrame(log[part::3], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = store.upserts(stream).writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("changes").groupBy("k").agg(F.max_by(F.struct("live", "v"), "seq").alias("x")).filter("x.live").select("k", "x.v")
    assert rows(last) == rows(keyed.replay(spark.createDataFrame(log, schema)))
