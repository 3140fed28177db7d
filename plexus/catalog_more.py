"""More registered queries: file sources, generators, the keyed store's table, sampled metrics.

File sources read files that are written from the tables first, in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.catalog import (
    _ALL, _NT, _PS, _SCORED, _STATE, _log, _query, _symmetric_nations, _table, nations, part_supplier,
)
from plexus.operators import bfs, graph, keyed, metrics, paths, search, sorting
from plexus.plans.tables import materialize, shared_root
from plexus.sources import generators, graphs


def _written(lines: DataFrame, ending: str = "txt") -> str:
    """A fresh folder of text files that holds the only column's values as lines."""
    path = f"{shared_root(lines.sparkSession)}/plexus-{uuid.uuid4().hex}.{ending}"
    lines.write.text(path)
    return path


def _text(rows: DataFrame, *parts) -> DataFrame:
    return rows.select(F.concat_ws("\t", *parts).alias("value"))


# --- file sources -----------------------------------------------------------------------------


@_query(f"with {_PS} select src, dst, 1::bigint as w from e")
def source_snap(spark, d):
    head = spark.createDataFrame([("# nodes and edges",), ("",), ("7\t7",), ("odd line",)], "value string")
    return graphs.snap(spark, _written(head.union(_text(part_supplier(spark, d), "u", "v"))))


@_query(f"with {_PS} select least(u, v) as u, greatest(u, v) as v, 1::bigint as w from ps")
def source_snap_road(spark, d):
    rows = part_supplier(spark, d)
    return graphs.load(spark, _written(_text(rows, "u", "v").union(_text(rows, "v", "u"))), "snap_road")


_MIXED = """xor((a * 2654435761) & 4294967295, (b * 2246822519) & 4294967295)"""


@_query(f"""with {_PS}, n as (select least(u, v) as a, greatest(u, v) as b, w % 3 as r, w from ps), h as (select *, {_MIXED} as h from n)
select a as u, b as v, case when r = 0 then w::double when r = 1 then (xor(h, h >> 16) % 9901 + 100) / 100.0::double else (xor(h, h >> 16) % 9901 + 100) / 100.0::double end as w from h""")
def source_snap_weighted(spark, d):
    """A third of the lines with a weight, a third with 0, a third without."""
    given = F.when(F.col("w") % 3 == 0, F.col("w").cast("string")).when(F.col("w") % 3 == 1, F.lit("0"))
    return graphs.load(spark, _written(_text(part_supplier(spark, d), F.col("v").cast("string"), F.col("u").cast("string"), given)))


@_query(f"with {_PS} select u, v, w::double as w from ps")
def source_matrix_market(spark, d):
    rows = part_supplier(spark, d)
    n = rows.agg(F.max(F.greatest("u", "v")) + 1, F.count("*")).first()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("% made from the tables",), (f"{n[0]} {n[0]} {n[1]}",), ("3 3 1.5",)], "value string")
    body = rows.select(F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1, "w").alias("value"))
    lines = head.withColumn("k", F.monotonically_increasing_id()).union(body.withColumn("k", F.lit(1 << 60)))
    # the line of sizes has to come before the entries
    return graphs.load(spark, _written(lines.coalesce(1).sortWithinPartitions("k").select("value"), "mtx"))


_RATED = "r as (select c_custkey as src, c_nationkey::bigint as dst, (c_custkey * 7 % 21 - 10)::int as rating from customer where c_custkey <> c_nationkey)"


def _ratings(spark, d) -> str:
    rating = (F.col("c_custkey") * 7 % 21 - 10).cast("int")
    return _written(_table(spark, d, "customer").select(F.concat_ws(",", "c_custkey", "c_nationkey", rating, F.lit("1.5")).alias("value")), "csv")


@_query(f"with {_RATED} select least(src, dst) as u, greatest(src, dst) as v, min(greatest(1, 11 - abs(rating)))::bigint as w from r group by 1, 2")
def source_trust(spark, d):
    return graphs.load(spark, _ratings(spark, d))


@_query(f"with {_RATED} select src, dst, rating::bigint as w from r")
def source_trust_directed(spark, d):
    return graphs.signed_trust(spark, _ratings(spark, d), undirected=False)


@_query("""with t as (select '0x' || c_custkey as a, '0x' || c_nationkey as b, round(c_acctbal * 100) as v from customer join nation on c_nationkey = n_nationkey),
n as (select x, count(*) as n from (select a as x from t union all select b from t) group by 1), busy as (select x from n order by n desc, x limit 300)
select a as src, b as dst, case when v > 0 then greatest(-20, least(20, -round(log10(v))))::bigint else 20 end as w from t where a <> b and a in (select x from busy) and b in (select x from busy)""")
def source_transfers(spark, d):
    rows = _table(spark, d, "customer").select(
        F.concat_ws(",", F.lit("1,2,3,4"), F.concat(F.lit('"0x'), "c_custkey", F.lit('"')), F.concat(F.lit("0x"), "c_nationkey"), F.round(F.col("c_acctbal") * 100).cast("long")).alias("value")
    )
    head = spark.createDataFrame([("block,time,from,to,value",), ("too,short",)], "value string")
    return graphs.transfers(spark, _written(head.union(rows)), 300)


@_query("select 'c' || c_custkey as src, 'n' || c_nationkey as dst, length((abs(round(c_acctbal * 100))::bigint)::varchar) as w from customer")
def source_exchange_transfers(spark, d):
    line = F.concat_ws(",", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.abs(F.round(F.col("c_acctbal") * 100)).cast("long").cast("string"), F.lit(".25")))
    head = spark.createDataFrame([("src,dst,amount",)], "value string")
    return graphs.exchange_transfers(spark, _written(head.coalesce(1).union(_table(spark, d, "customer").select(line.alias("value"))).coalesce(1), "csv"))


_MAP = "cell as (select c_custkey as i, c_custkey % 7 as k, c_custkey % 5 as s from customer where c_custkey < 400), free as (select i % 20 as x, i // 20 as y, i, case when s = 0 then 2.0 else 1.0 end::double as cost from cell where k <> 3)"


def _grid_map(spark, d):
    """A map of 20 by 20 cells made from the first customers."""
    key = F.col("c_custkey")
    mark = F.when(key % 7 == 3, "@").when(key % 5 == 0, "S").otherwise(".")
    rows = _table(spark, d, "customer").filter(key < 400).select(key.alias("i"), mark.alias("c"))
    lines = rows.groupBy(F.floor(F.col("i") / 20).alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "").alias("line"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda x: x["line"]), "\n").alias("b"))
    whole = body.select(F.concat(F.lit("type octile\nheight 20\nwidth 20\nmap\n"), "b").alias("value"))
    path = f"{shared_root(spark)}/plexus-{uuid.uuid4().hex}.map"
    whole.coalesce(1).write.text(path, lineSep="\n")
    return graphs.grid_map(spark, path)


@_query(f"""with {_MAP} select a.y * (select max(x) + 1 from free) + a.x as src, b.y * (select max(x) + 1 from free) + b.x as dst,
case when a.x = b.x or a.y = b.y then (a.cost + b.cost) / 2 else greatest(a.cost, b.cost) * 1.41421356 end as w
from free a join free b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.i <> b.i
where a.x = b.x or a.y = b.y or (exists (select 1 from free f where f.x = b.x and f.y = a.y) and exists (select 1 from free f where f.x = a.x and f.y = b.y))""")
def source_grid_map(spark, d):
    return _grid_map(spark, d)[1]


@_query(f"""with recursive {_MAP}, e as (select a.i as src, b.i as dst, case when a.x = b.x or a.y = b.y then (a.cost + b.cost) / 2 else greatest(a.cost, b.cost) * 1.41421356 end as w
from free a join free b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.i <> b.i
where a.x = b.x or a.y = b.y or (exists (select 1 from free f where f.x = b.x and f.y = a.y) and exists (select 1 from free f where f.x = a.x and f.y = b.y))),
r(v, d) using key (v) as (select min(i), 0.0::double from free union
select e.dst, min(r.d + e.w) from r join e on e.src = r.v left join recurring.r o on o.v = e.dst group by e.dst, o.d having o.d is null or min(r.d + e.w) < o.d - 1e-9)
select v as dst, round(d, 4) as cost from r where d > 0""")
def grid_map_search(spark, d):
    """From the first free cell to every other, by the straight line and without it."""
    cells, edges = _grid_map(spark, d)
    cells, edges = materialize(cells, "cells"), materialize(edges, "edges")
    first = cells.agg(F.min("id")).first()[0]
    places = cells.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pairs = cells.filter(F.col("id") != first).select(F.lit(first).alias("src"), F.col("id").alias("dst"))
    return search.search(edges, pairs, "astar", places).filter("cost is not null").select("dst", F.round("cost", 4).alias("cost"))


@_query("""with s as (select (s_suppkey % 4)::int as bucket, 'm' as map, (s_suppkey % 9)::int as sx, (s_suppkey % 11)::int as sy, (s_suppkey % 13)::int as gx, (s_suppkey % 17)::int as gy, s_suppkey / 2.0::double as opt from supplier),
p as (select *, row_number() over (partition by bucket order by opt, sx, sy, gx, gy) - 1 as i, count(*) over (partition by bucket) as n from s)
select bucket, map, 20 as w, 20 as h, sx, sy, gx, gy, opt from p where i % greatest(1, n // 5) = 0 and i / greatest(1, n // 5) < 5""")
def source_scenarios(spark, d):
    k = F.col("s_suppkey")
    head = spark.createDataFrame([("version 1",)], "value string")
    rows = _text(_table(spark, d, "supplier"), k % 4, F.lit("m"), F.lit(20), F.lit(20), k % 9, k % 11, k % 13, k % 17, k / 2)
    return graphs.scenarios(spark, _written(head.union(rows), "scen"), 5)


def _transactions(spark, d):
    orders, key = _table(spark, d, "orders"), F.col("o_orderkey")
    features = orders.select(F.concat_ws(",", key, (key % 49 + 1).cast("double"), F.col("o_totalprice").cast("double"), F.col("o_totalprice").cast("double") / 2).alias("value"))
    label = F.when(key % 3 == 0, "1").when(key % 3 == 1, "2").otherwise("unknown")
    classes = orders.select(F.concat_ws(",", key, label).alias("value"))
    ends = _table(spark, d, "lineitem").select(F.concat_ws(",", "l_orderkey", F.col("l_partkey")).alias("value"))
    return graphs.transactions(spark, *[_written(x, "csv") for x in (features, classes, ends)], n_features=2)


@_query("select o_orderkey as id, (o_orderkey % 49 + 1)::int as step, round(o_totalprice::double * 0.75, 4) as x, (o_orderkey % 3 = 0)::int as label from orders where o_orderkey % 3 < 2")
def source_transactions(spark, d):
    return _transactions(spark, d)[0].select("id", "step", F.round("x", 4).alias("x"), "label")


@_query("""with k as (select o_orderkey as id from orders where o_orderkey % 3 < 2), e as (select distinct l_orderkey as src, l_partkey as dst from lineitem where l_orderkey <> l_partkey and l_orderkey in (select id from k) and l_partkey in (select id from k)),
n as (select src, count(*) as n from e group by 1)
select e.src, dst, round(0.9::double / n, 9) as w from e join n using (src) union all select id, id, case when n is null then 1.0 else 0.1 end from k left join n on n.src = id""")
def source_transaction_edges(spark, d):
    return _transactions(spark, d)[1].select("src", "dst", F.round("w", 9).alias("w"))


@_query(f"with {_NT}, n as (select src, count(*) as n from nt group by 1) select src as i, dst as j, round(1.0::double / n, 9) as p from nt join n using (src)")
def stochastic_rows(spark, d):
    return graphs.stochastic(nations(spark, d)).select("i", "j", F.round("p", 9).alias("p"))


@_query(f"with {_PS}, o as (select distinct src as old, dense_rank() over (order by src) - 1 as id from e) select a.id as src, b.id as dst, w from e join o a on a.old = src join o b on b.old = dst")
def dense_ids(spark, d):
    return graphs.dense_ids(graph.symmetric(part_supplier(spark, d)))[0]


@_query(f"with {_NT} select src, dst, w from nt")
def results_sink(spark, d):
    path = f"{shared_root(spark)}/plexus-{uuid.uuid4().hex}.csv"
    graphs.write_results(nations(spark, d), path)
    return spark.read.schema("src long, dst long, w long").csv(path, header=True)


# --- generators -------------------------------------------------------------------------------


@_query("""select i as u, i + 1 as v from range(30 * 20) t(i) where i % 30 < 29 union all select i, i + 30 from range(30 * 20) t(i) where i < 30 * 19""")
def generated_grid(spark, d):
    return generators.grid(spark, 30, 20).select("u", "v")


@_query("select i as u, i + 1 as v, i + 1 as w from range(999) t(i)")
def generated_path(spark, d):
    return generators.path(spark, 1000)


@_query("select a.i as u, b.i as v, 1::bigint as w from range(40) a(i) join range(40) b(i) on a.i < b.i")
def generated_complete(spark, d):
    return generators.complete(spark, 40)


@_query("select 600::bigint as cells, 599::bigint as edges, 1::bigint as components")
def generated_maze(spark, d):
    """A perfect maze is a tree over all its cells."""
    e = materialize(generators.maze(spark, 30, 20), "maze")
    found = bfs.components(e.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return found.agg(F.count("*").alias("cells"), F.countDistinct("component").alias("components")).crossJoin(e.agg(F.count("*").alias("edges"))).select("cells", "edges", "components")


#: Places of parts and the road to their four nearest.
_SPOTS = "s as (select p_partkey as id, (p_partkey * 7919 % 10007)::double as x, (p_partkey * 104729 % 10009)::double as y from part)"


def _spots(spark, d):
    key = F.col("p_partkey").cast("long")
    return _table(spark, d, "part").select(key.alias("id"), (key * 7919 % 10007).cast("double").alias("x"), (key * 104729 % 10009).cast("double").alias("y"))


@_query(f"""with {_SPOTS}, n as (select a.id as u, b.id as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as w from s a join s b on a.id <> b.id),
r as (select *, row_number() over (partition by u order by w, v) as k from n) select distinct least(u, v) as u, greatest(u, v) as v, round(w, 6) as w from r where k <= 4""")
def generated_nearest_road(spark, d):
    return generators.nearest(_spots(spark, d), 4).select("u", "v", F.round("w", 6).alias("w"))


@_query(f"with {_SPOTS} select a.id as u, b.id as v, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as w from s a join s b on a.id < b.id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 490000")
def generated_geometric(spark, d):
    # places are whole numbers, so no length is near the middle of two millionths; F.round takes a BigDecimal a row
    return generators.geometric(_spots(spark, d), 700.0).select("u", "v", (F.floor(F.col("w") * 1e6 + 0.5) / 1e6).alias("w"))


@_query("""select 400::bigint as points, 760::bigint as straight, true as planar""")
def generated_planar_road(spark, d):
    """Lattice edges all stand; lengths are those between the points; diagonals are a part of all."""
    spots, edges = generators.planar_road(spark, 20)
    straight = (F.col("v") - F.col("u")).isin(1, 20)
    n = edges.agg(F.sum(straight.cast("long")).alias("straight"), F.sum((~straight).cast("long")).alias("across"))
    return spots.agg(F.count("*").alias("points")).crossJoin(n).select("points", "straight", F.col("across").between(1, 721).alias("planar"))


@_query("select false as negative_cycle, true as negative_arcs")
def generated_negative_arcs(spark, d):
    e = materialize(generators.negative_arcs(spark, 300, 1500), "arcs")
    return spark.createDataFrame([(paths.has_negative_cycle(e, 0), not e.filter("w < 0").isEmpty())], "negative_cycle boolean, negative_arcs boolean")


# --- keyed store ------------------------------------------------------------------------------


@_query(f"""with {_STATE}, n as (select count(*) as size from state), c as (select size, greatest(8, pow(2, ceil(log2(greatest(1, ceil(size / 0.70)))))::bigint)::bigint as cap from n),
h as (select k, ((k % cap) * ({keyed.HASH_MULTIPLIER} % cap::hugeint)::bigint) % cap as home, cap from state, c),
two as (select k, home + lap * cap as place, lap from h, range(2) t(lap)), o as (select *, row_number() over (order by place, k) as nth from two),
q as (select *, nth + max(place - nth) over (order by nth) - place as probe from o)
select size, cap as capacity, round(size / cap, 6) as load_factor, (select max(probe) from q where lap = 1)::bigint as max_probe, (select round(avg(probe), 6) from q where lap = 1) as mean_probe from c""")
def kv_probe_stats(spark, d):
    return keyed.probe_stats(materialize(keyed.replay(_log(spark, d)), "state"))


@_query(f"with {_STATE}, m as (select min(k) as k from state) select state.k, v from state, m where state.k <> m.k")
def kv_pop(spark, d):
    store = materialize(keyed.replay(_log(spark, d)), "state")
    return keyed.pop(store, store.agg(F.min("k")).first()[0])[1]


@_query(f"with {_STATE} select k, v from state where false")
def kv_clear(spark, d):
    return keyed.clear(keyed.replay(_log(spark, d)))


@_query(f"with {_STATE}, n as (select count(*) as size from state) select 16384::bigint as before, greatest(8, least(16384, pow(2, ceil(log2(size / 0.15)) - case when size / 0.15 = pow(2, ceil(log2(size / 0.15))) then 0 else 1 end)))::bigint as after from n")
def kv_shrink(spark, d):
    """Capacity of a table of 16,384 slots from which all but the state was deleted."""
    return spark.createDataFrame([(16384, keyed.shrunk(keyed.replay(_log(spark, d)), 16384))], "before long, after long")


# --- others -----------------------------------------------------------------------------------


@_query("select l_suppkey, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 25")
def top_by_count(spark, d):
    return sorting.top_by_count(_table(spark, d, "lineitem"), "l_suppkey", 25)


@_query(f"""with recursive {_NT}, {_ALL.format(t='sy')}, five as (select distinct src from sy order by 1 limit 5), l as (select a, b, d from m where a in (select src from five) and a <> b union all select src, src, 0 from five),
g as (select x.a, x.b as src, y.b as dst, abs(x.d - y.d) as gain, row_number() over (partition by x.b, y.b order by abs(x.d - y.d) desc, x.a) as nth from l x join l y on x.a = y.a and x.b <> y.b)
select src, dst, max(gain) as bound from g where nth <= 2 group by 1, 2""")
def landmark_bound_active(spark, d):
    e = _symmetric_nations(spark, d)
    five = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(5)
    table = materialize(paths.sssp_many(e, five).withColumnRenamed("source", "landmark"), "landmarks")
    pairs = e.select("src").distinct().crossJoin(F.broadcast(e.select(F.col("src").alias("dst")).distinct())).filter("src <> dst")
    return search.landmark_bounds(table, pairs, 2)


@_query(f"""with {_SCORED.replace('value as s', 'event_id, value as s')}, o as (select draw, s, y, row_number() over (partition by draw order by md5(event_id || ':' || draw), event_id) as nth from x, range(5) t(draw)),
g as (select draw, s, sum(y) as p, sum(1 - y) as n from o where nth <= 400 group by 1, 2), c as (select *, coalesce(sum(n) over (partition by draw order by s rows between unbounded preceding and 1 preceding), 0) as b from g)
select draw::int as draw, round(sum(p * b + p * n / 2) / sum(p) / sum(n), 6) as auroc from c group by 1""")
def auroc_bootstrap(spark, d):
    rows = _table(spark, d, "events").filter("value is not null").select("event_id", F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return metrics.bootstrap_auroc(rows, "event_id", "s", "y", 5, 400)


@_query(f"with {_PS}, t as (select u, v, w, row_number() over (order by u, v) as i from ps), a as (select u as a, min(w) as x from ps group by 1), b as (select u as a, max(w) as x from ps group by 1) select count(*) = 0 as same from a join b using (a) where abs(a.x - b.x) > 1e-9")
def results_equivalent(spark, d):
    rows = part_supplier(spark, d)
    a, b = (rows.groupBy("u").agg(f("w").alias("x")) for f in (F.min, F.max))
    return spark.createDataFrame([(metrics.equivalent(a, b, ["u"], "x"),)], "same boolean")


def _matrix_sql() -> str:
    columns = ", ".join(f'max(case when b = {k} then d end) as "{k}"' for k in range(25))
    return f"with recursive {_NT}, {_ALL.format(t='nt')}, z as (select a, b, d from m where a <> b union all select distinct src, src, 0 from nt union select distinct dst, dst, 0 from nt) select a, {columns} from z group by 1"


@_query(_matrix_sql())
def apsp_matrix(spark, d):
    found = paths.matrix(paths.all_pairs(nations(spark, d)))
    return found.select("a", *[F.col(str(k)) if str(k) in found.columns else F.lit(None).cast("long").alias(str(k)) for k in range(25)])


@_query(f"with {_PS}, g as (select src, dst from e union select dst, src from e) select src as v, (count(*) > 0) as reached from g where src in (select dst from e) group by 1")
def graph_builder(spark, d):
    made = graph.Graph.of(part_supplier(spark, d).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w"), directed=False, nonnegative=True)
    return made.nodes.join(graph.degrees(made.edges), "id").select(F.col("id").alias("v"), (F.col("degree") > 0).alias("reached"))
