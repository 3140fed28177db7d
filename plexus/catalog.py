"""Registered queries of the graph, sequence and statistics operators, each with its SQL oracle.

Graphs: ``PS`` joins parts (even ids) and suppliers (odd ids) by the least line price in cents;
``NT`` has an arc per pair of trading nations; the hierarchy joins customers and suppliers to
nations and nations to regions; the event chain steps between a user's consecutive events.
Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus import functions
from plexus.operators import bfs, graph, keyed, markov, metrics, paths, search, sequences, sorting, spanning
from plexus.plans.tables import materialize

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- graphs -----------------------------------------------------------------------------------

_CENTS = "cast(round(l_extendedprice * 100) as bigint)"
_PS = f"""ps as (select 2 * l_partkey as u, 2 * l_suppkey + 1 as v, min({_CENTS}) as w from lineitem group by 1, 2),
e as (select u as src, v as dst, w from ps union all select v, u, w from ps),
s as (select min(u) as s from ps)"""
_NT = f"""nt as (select c_nationkey::bigint as src, s_nationkey::bigint as dst, min({_CENTS}) as w
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    where c_nationkey <> s_nationkey group by 1, 2),
un as (select least(src, dst) as u, greatest(src, dst) as v, min(w) as w from nt group by 1, 2),
sy as (select u as src, v as dst, w from un union all select v, u, w from un)"""


def part_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Undirected ``(u, v, w)``."""
    return _table(spark, d, "lineitem").groupBy((2 * F.col("l_partkey")).alias("u"), (2 * F.col("l_suppkey") + 1).alias("v")).agg(
        F.min(F.expr(_CENTS)).alias("w")
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Arcs ``(src, dst, w)`` from a customer's nation to a supplier's."""
    rows = (
        _table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.expr(_CENTS).alias("w"))
        .join(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.filter("c_nationkey <> s_nationkey").groupBy(
        F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")
    ).agg(F.min("w").alias("w"))


def nations_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.normalise(nations(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric ``(src, dst)``; ids are ``4 key`` plus 0 to 3 for customer, supplier, nation, region."""
    part = lambda t, a, x, b, y: _table(spark, d, t).select((4 * F.col(a).cast("long") + x).alias("u"), (4 * F.col(b).cast("long") + y).alias("v"))
    rows = part("customer", "c_custkey", 0, "c_nationkey", 2).union(part("supplier", "s_suppkey", 1, "s_nationkey", 2)).union(part("nation", "n_nationkey", 2, "n_regionkey", 3))
    return rows.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(rows.select("v", "u"))


_HIERARCHY = """h as (select 4 * c_custkey as u, 4 * c_nationkey::bigint + 2 as v from customer union all
select 4 * s_suppkey + 1, 4 * s_nationkey::bigint + 2 from supplier union all select 4 * n_nationkey::bigint + 2, 4 * n_regionkey::bigint + 3 from nation),
e as (select u as src, v as dst from h union all select v, u from h)"""


def _ps_edges(spark, d) -> tuple[DataFrame, int]:
    e = materialize(graph.symmetric(part_supplier(spark, d)), "ps")
    return e, e.filter("src % 2 = 0").agg(F.min("src")).first()[0]


def _ids(spark, *ids) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


_LEVELS = """r(v, d) using key (v) as (select src_id, 0 from seed union
select e.dst, min(r.d + 1) from r join e on e.src = r.v left join recurring.r o on o.v = e.dst group by e.dst, o.d having o.d is null or min(r.d + 1) < o.d)"""


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r")
def bfs_levels(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source)).select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r")
def bfs_adaptive(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source), strategy="adaptive").select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r")
def bfs_direction(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source), strategy="direction").select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r")
def bfs_surf(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source), strategy="surf").select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r")
def bfs_bitmap(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source), strategy="bitmap").select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select max(u) as src_id from ps union all select min(v) from ps), {_LEVELS} select v, d::int as dist from r")
def bfs_multi_source(spark, d):
    e, _ = _ps_edges(spark, d)
    ends = e.filter("src % 2 = 0").agg(F.max("src"), F.min("dst")).first()
    return bfs.bfs(e, _ids(spark, *ends)).select("v", "dist")


@_query(f"with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS} select v, d::int as dist from r where d <= 2")
def bfs_depth_limited(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source), max_depth=2).select("v", "dist")


@_query(f"""with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS}
select r.v, r.d::int as dist, min(p.v) as parent from r left join e on e.dst = r.v left join r p on p.v = e.src and p.d = r.d - 1 group by 1, 2""")
def bfs_parent_min(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.bfs(e, _ids(spark, source))


@_query(f"""with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS}, g as (select src, count(*) as n from e group by 1)
select d::int as dist, count(*) as frontier, sum(n)::bigint as edge_checks from r left join g on src = v group by 1""")
def bfs_frontier_work(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.frontier_work(bfs.bfs(e, _ids(spark, source)), e)


@_query(f"""with recursive {_PS}, seed as (select s as src_id from s), {_LEVELS}
select v, d::int as dist, row_number() over (order by d, v) - 1 as visit_rank from r""")
def bfs_visit_order(spark, d):
    e, source = _ps_edges(spark, d)
    return bfs.visit_order(bfs.bfs(e, _ids(spark, source))).select("v", "dist", F.col("visit_rank").cast("long").alias("visit_rank"))


_LABELS = """r(v, c) using key (v) as (select distinct src, src from e union
select e.dst, min(r.c) from r join e on e.src = r.v left join recurring.r o on o.v = e.dst group by e.dst, o.c having min(r.c) < o.c)"""


@_query(f"with recursive {_HIERARCHY}, {_LABELS} select v, c as component from r")
def components(spark, d):
    return bfs.components(hierarchy(spark, d))


@_query(f"""with recursive {_HIERARCHY}, {_LABELS}, seed as (select distinct c as src_id from r),
q(v, d) using key (v) as (select src_id, 0 from seed union
select e.dst, min(q.d + 1) from q join e on e.src = q.v left join recurring.q o on o.v = e.dst group by e.dst, o.d having o.d is null or min(q.d + 1) < o.d),
bad as (select distinct r.c from e join q a on a.v = e.src join q b on b.v = e.dst join r on r.v = e.src where a.d % 2 = b.d % 2)
select r.v, r.c as component, (q.d % 2)::int as colour, r.c not in (select c from bad) as bipartite from r join q on q.v = r.v""")
def bipartite_colour(spark, d):
    return bfs.two_colouring(materialize(hierarchy(spark, d), "hierarchy"))


@_query(f"with {_PS} select src as id, count(*) as degree from e group by 1 order by 2 desc, 1 limit 20")
def topk_hubs(spark, d):
    return graph.hubs(graph.symmetric(part_supplier(spark, d)), 20)


@_query(f"with {_PS} select u, v, w from ps")
def edge_normalise(spark, d):
    raw = _table(spark, d, "lineitem").select((2 * F.col("l_suppkey") + 1).alias("v"), (2 * F.col("l_partkey")).alias("u"), F.expr(_CENTS).alias("w"))
    # u and v come back in order; parts are told by their even ids
    found = graph.normalise(raw)
    even = F.col("u") % 2 == 0
    return found.select(F.when(even, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(even, F.col("v")).otherwise(F.col("u")).alias("v"), "w")


@_query(f"""with {_PS}, p as (select u, v, xor((u * 2654435761) & 4294967295, (v * 2246822519) & 4294967295) as h from ps)
select u, v, (xor(h, h >> 16) % 9901 + 100) / 100.0::double as w from p""")
def synth_weight(spark, d):
    return part_supplier(spark, d).select("u", "v", functions.synth_weight(F.col("u"), F.col("v")).alias("w"))


@_query(f"with {_PS} select src, count(*) as n, min(dst) as first, max(dst) as last, sum(w)::bigint as total from e group by 1")
def adjacency(spark, d):
    rows = graph.adjacency(graph.symmetric(part_supplier(spark, d)))
    return rows.select(
        "src", F.size("neighbours").cast("long").alias("n"), F.get("neighbours", F.lit(0))["dst"].alias("first"), F.element_at("neighbours", -1)["dst"].alias("last"),
        F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("total"),
    )


# --- shortest paths ---------------------------------------------------------------------------

_SSSP = """r(v, d) using key (v) as (select s, 0::bigint from s union
select e.dst, min(r.d + e.w)::bigint from r join e on e.src = r.v left join recurring.r o on o.v = e.dst group by e.dst, o.d having o.d is null or min(r.d + e.w) < o.d)"""
_SSSP_SQL = f"with recursive {_PS}, {_SSSP} select v, d as dist from r"


def _sssp(spark, d, strategy):
    e, source = _ps_edges(spark, d)
    return paths.sssp(e, source, strategy).select("v", "dist")


@_query(_SSSP_SQL)
def sssp_loop(spark, d):
    return _sssp(spark, d, "full")


@_query(_SSSP_SQL)
def sssp_frontier(spark, d):
    return _sssp(spark, d, "frontier")


@_query(_SSSP_SQL)
def sssp_adaptive(spark, d):
    return _sssp(spark, d, "adaptive")


@_query(_SSSP_SQL)
def sssp_learned(spark, d):
    return _sssp(spark, d, "learned")


@_query(_SSSP_SQL)
def sssp_shuffled(spark, d):
    return _sssp(spark, d, "shuffled")


@_query(_SSSP_SQL)
def sssp_potential(spark, d):
    return _sssp(spark, d, "potential")


@_query(_SSSP_SQL)
def sssp_kernel(spark, d):
    ps = materialize(part_supplier(spark, d), "ps")
    return paths.kernel(graph.symmetric(ps), ps.agg(F.min("u")).first()[0], stored=True)


@_query(f"""with recursive {_PS}, {_SSSP},
prev as (select r.v, min(p.v) as up from r join e on e.dst = r.v join r p on p.v = e.src and p.d + e.w = r.d where r.v <> (select s from s) group by 1),
way(target, back, v) as (select v, 0, v from r where v % 2 = 1 union all select target, back + 1, up from way join prev using (v)),
n as (select target, max(back) as n from way group by 1)
select target, (n - back)::int as step, v from way join n using (target)""")
def sssp_path(spark, d):
    e, source = _ps_edges(spark, d)
    found = materialize(paths.sssp(e, source), "sssp")
    return bfs.trace(found.select("v", F.col("prev").alias("parent")), found.filter("v % 2 = 1").select(F.col("v").alias("id")))


_SHIFTED = "e as (select src, dst, w + 100000 * ((src * 7) % 5) - 100000 * ((dst * 7) % 5) as w from nt), s as (select min(src) as s from nt)"


def _shifted(spark, d):
    high = lambda c: 100000 * ((F.col(c) * 7) % 5)
    return nations(spark, d).select("src", "dst", (F.col("w") + high("src") - high("dst")).alias("w"))


@_query(f"with recursive {_NT}, {_SHIFTED}, {_SSSP} select v, d as dist from r")
def sssp_negative(spark, d):
    e = materialize(_shifted(spark, d), "nt")
    return paths.sssp(e, e.agg(F.min("src")).first()[0]).select("v", "dist")


@_query(f"""with recursive {_NT}, {_SHIFTED}, big as (select max(w) as m from nt), g as (select 'shifted' as name, src, dst, w from e
union all select 'reduced', src, dst, w - m from nt, big),
k(name, i, v, d) as (select name, 0, s, 0::hugeint from s, (values ('shifted'), ('reduced')) t(name) union all
select name, i + 1, v, min(d) from (select k.name, k.i, g.dst as v, k.d + g.w as d from k join g on g.name = k.name and g.src = k.v
union all select name, i, v, d from k) group by name, i, v having i < 30)
select a.name, bool_or(a.d < b.d) as negative_cycle from k a join k b on a.name = b.name and a.v = b.v and a.i = 30 and b.i = 29 group by 1""")
def negative_cycle_flag(spark, d):
    shifted, plain = materialize(_shifted(spark, d), "nt"), materialize(nations(spark, d), "nt")
    most = plain.agg(F.max("w")).first()[0]
    reduced = plain.select("src", "dst", (F.col("w") - most).alias("w"))
    source = plain.agg(F.min("src")).first()[0]
    found = [(name, paths.has_negative_cycle(e, source)) for name, e in (("shifted", shifted), ("reduced", reduced))]
    return spark.createDataFrame(found, "name string, negative_cycle boolean")


_ALL = """m(a, b, d) using key (a, b) as (select src, dst, w from {t} union
select m.a, e.dst, min(m.d + e.w)::bigint from m join {t} e on m.b = e.src left join recurring.m o on o.a = m.a and o.b = e.dst
where m.a <> e.dst group by m.a, e.dst, o.d having o.d is null or min(m.d + e.w) < o.d)"""


@_query(f"with recursive {_NT}, {_ALL.format(t='nt')} select a, b, d as dist from m")
def apsp(spark, d):
    return paths.all_pairs(nations(spark, d)).filter("a <> b").select("a", "b", "dist")


@_query(f"""with recursive {_NT}, {_ALL.format(t='nt')}, z as (select a, b, d from m union all select distinct src, src, 0 from nt union select distinct dst, dst, 0 from nt)
select m.a, m.b, min(nt.dst) as next from m join nt on nt.src = m.a join z on z.a = nt.dst and z.b = m.b and nt.w + z.d = m.d group by 1, 2""")
def apsp_next_hop(spark, d):
    return paths.all_pairs(nations(spark, d)).filter("a <> b").select("a", "b", "next")


# --- spanning forests -------------------------------------------------------------------------

_MINIMAX = f"""{_NT}, ranked as (select *, row_number() over (order by w, u, v) as k from un),
g as (select u as src, v as dst, k from ranked union all select v, u, k from ranked),
m(a, b, k) using key (a, b) as (select src, dst, k from g union
select m.a, g.dst, min(greatest(m.k, g.k)) from m join g on m.b = g.src left join recurring.m o on o.a = m.a and o.b = g.dst
where m.a <> g.dst group by m.a, g.dst, o.k having o.k is null or min(greatest(m.k, g.k)) < o.k),
mst as (select r.u, r.v, r.w from ranked r join m on m.a = r.u and m.b = r.v and m.k = r.k)"""
_MST_SQL = f"with recursive {_MINIMAX} select u, v, w from mst"


@_query(_MST_SQL)
def mst_boruvka(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "boruvka")


@_query(_MST_SQL)
def mst_contract(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "contract")


@_query(_MST_SQL)
def mst_kruskal(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "kruskal")


@_query(_MST_SQL)
def mst_prim(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "prim")


@_query(_MST_SQL)
def mst_strata(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "strata")


@_query(f"""with recursive {_MINIMAX} select count(*) as edges, sum(w)::bigint as total, (select count(*) from (select u from un union select v from un)) - count(*) as n_components,
(select count(*) from (select u from un union select v from un)) - count(*) <= 1 as spanning from mst""")
def mst_summary(spark, d):
    e = materialize(nations_undirected(spark, d), "nt")
    n = e.select("u").union(e.select("v")).distinct().count()
    return spanning.summary(spanning.spanning_forest(e), n)


#: Boruvka's rounds: nodes with their label (kind 0) and edges chosen (kind 1).
_PS_FOREST = f"""with recursive {_PS}, ranked as (select least(u, v) as u, greatest(u, v) as v, w, row_number() over (order by w, least(u, v), greatest(u, v)) as k from ps),
r(i, kind, a, b) as (select 0, 0, x, x from (select u as x from ps union select v from ps) union all
(with lab as (select i, a as v, b as c from r where kind = 0),
ends as (select x.c as cx, y.c as cy, k from ranked join lab x on x.v = u join lab y on y.v = ranked.v where x.c <> y.c),
hooks as (select c, min(k) as k, arg_min(d, k) as d from (select cx as c, cy as d, k from ends union all select cy, cx, k from ends) group by c),
low as (select c, min(m) as m from (select c, d as m from hooks union all select d, c from hooks) group by c)
select lab.i + 1, 0, v, least(lab.c, coalesce(m, lab.c)) from lab left join low on low.c = lab.c where exists (select 1 from hooks)
union all select (select max(i) + 1 from lab), 1, k, 0 from (select distinct k from hooks)))"""
_PS_FOREST_SQL = f"{_PS_FOREST} select u, v, w from ranked where k in (select a from r where kind = 1)"


@_query(_PS_FOREST_SQL)
def mst_part_supplier(spark, d):
    return spanning.spanning_forest(part_supplier(spark, d))


@_query(_PS_FOREST_SQL)
def mst_part_supplier_strata(spark, d):
    return spanning.spanning_forest(part_supplier(spark, d), "strata")


@_query(_PS_FOREST_SQL)
def mst_part_supplier_kruskal(spark, d):
    return spanning.spanning_forest(part_supplier(spark, d), "kruskal")


@_query(_PS_FOREST_SQL)
def mst_part_supplier_fibonacci(spark, d):
    return spanning.spanning_forest(part_supplier(spark, d), "prim_fibonacci")


@_query(_MST_SQL)
def mst_heap(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "heap")


@_query(_MST_SQL)
def mst_prim_fibonacci(spark, d):
    return spanning.spanning_forest(nations_undirected(spark, d), "prim_fibonacci")


@_query(f"""with recursive {_MINIMAX}, cuts as (select unnest(quantile_cont(w, [0.25, 0.5, 0.75])) as c from un),
s as (select un.*, (select count(*) from cuts where un.w > c)::int as stratum, mst.w is not null as tree from un left join mst on mst.u = un.u and mst.v = un.v)
select stratum, min(w) as least, max(w) as most, count(*) as edges, count(*) filter (tree) as tree_edges, round(count(*) filter (tree) * 100.0::double / count(*), 4) as share from s group by 1""")
def mst_strata_profile(spark, d):
    e = materialize(nations_undirected(spark, d), "nt")
    cuts = e.agg(F.percentile("w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    return spanning.strata_profile(e, spanning.spanning_forest(e), cuts)


# --- sorting ----------------------------------------------------------------------------------


@_query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders")
def sort_rank(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sorting.rank_all(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


@_query("select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) as place from orders")
def sort_stable_rank(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sorting.rank_all(rows, [F.col("o_orderpriority"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@_query("select p_partkey, row_number() over (order by length(p_name), p_name, p_partkey) as place from part")
def sort_key_len(spark, d):
    rows = _table(spark, d, "part").select("p_partkey", "p_name")
    return sorting.rank_all(rows, [F.length("p_name"), F.col("p_name"), F.col("p_partkey")], "place").select("p_partkey", "place")


@_query("select c_custkey, c_nationkey, rank::int as rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 5")
def top_per_group(spark, d):
    rows = _table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sorting.top_per_group(rows, "c_nationkey", 5, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_custkey", "c_nationkey", "rank")


@_query("select case when l_quantity < 25 then 0 when l_quantity = 25 then 1 else 2 end as side, count(*) as n from lineitem group by 1")
def three_way_partition(spark, d):
    return sorting.three_way(_table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 25).groupBy("side").agg(F.count("*").alias("n"))


@_query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
dist as (select query_id, vec_id as id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i]::double - embedding[i]::double) * (q[i]::double - embedding[i]::double))) as dist from q join embeddings on vec_id <> query_id)
select query_id, rank::int as rank, id, round(dist, 6) as dist from (select *, row_number() over (partition by query_id order by dist, id) as rank from dist) where rank <= 4""")
def knn_points(spark, d):
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return sorting.knn(rows, rows.filter("id % 100 = 0"), 4).withColumn("dist", F.round("dist", 6))


# --- keyed store ------------------------------------------------------------------------------

_LOG = "log as (select event_id as seq, case when event_type = 'error' then 'del' else 'set' end as op, user_id as k, value as v from events)"
_STATE = f"{_LOG}, state as (select k, arg_max(v, seq) as v from log group by 1 having arg_max(op, seq) = 'set')"


def _log(spark, d):
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("k"), F.col("value").alias("v"))


@_query(f"with {_STATE} select k, v from state")
def kv_final_state(spark, d):
    return keyed.replay(_log(spark, d))


@_query(f"with {_STATE} select c_custkey as k, coalesce(v, -1.0) as v from customer left join state on k = c_custkey")
def kv_lookup_default(spark, d):
    return keyed.lookup(keyed.replay(_log(spark, d)), _table(spark, d, "customer").select(F.col("c_custkey").alias("k")), -1.0)


@_query(f"with {_STATE} select c_custkey as k from customer where c_custkey in (select k from state)")
def kv_membership(spark, d):
    return keyed.contains(keyed.replay(_log(spark, d)), _table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@_query(f"""with {_STATE}, n as (select count(*) as size from state), c as (select size, greatest(8, pow(2, ceil(log2(greatest(1, ceil(size / 0.70)))))::bigint) as capacity from n)
select size, capacity::bigint as capacity, round(size / capacity, 6) as load_factor from c""")
def kv_stats(spark, d):
    return keyed.stats(keyed.replay(_log(spark, d)))


@_query(f"""with {_LOG}, w as (select *, lag(op) over (partition by k order by seq) as was from log)
select seq, k from w where op = 'del' and (was is null or was = 'del')""")
def kv_missing_deletes(spark, d):
    return keyed.missing_deletes(_log(spark, d))


@_query("select p_type as value, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part where p_type is not null)")
def dictionary_encode(spark, d):
    return keyed.encode(_table(spark, d, "part"), "p_type")


# --- point-to-point search --------------------------------------------------------------------


def _symmetric_nations(spark, d):
    return materialize(graph.symmetric(nations_undirected(spark, d)), "nt")


def _every_pair(e):
    return e.select("src").distinct().crossJoin(F.broadcast(e.select(F.col("src").alias("dst")).distinct())).filter("src <> dst")


_PAIRS_SQL = f"with recursive {_NT}, {_ALL.format(t='sy')}"


@_query(f"""{_PAIRS_SQL}, l as (select a, b, d from m where a in (select distinct src from sy order by 1 limit 3) union all select distinct src, src, 0 from sy where src in (select distinct src from sy order by 1 limit 3))
select x.b as src, y.b as dst, max(abs(x.d - y.d)) as bound from l x join l y on x.a = y.a and x.b <> y.b group by 1, 2""")
def landmark_bound(spark, d):
    e = _symmetric_nations(spark, d)
    first = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(3)
    table = paths.sssp_many(e, first).withColumnRenamed("source", "landmark")
    return search.landmark_bounds(materialize(table, "landmarks"), _every_pair(e))


_FARTHEST = """far(n, chosen) as ({first} union all
select n + 1, list_append(any_value(chosen), arg_max(b, struct_pack(d := dd, v := -b)))
from (select n, chosen, b, min(d) as dd from far join z on list_contains(chosen, a) where n < {k} and not list_contains(chosen, b) group by n, chosen, b) group by n)"""
_ZERO = "z as (select a, b, d from m where a <> b union all select distinct src, src, 0 from sy)"
_MARKS = "marks as (select chosen[i] as landmark, (i - 1)::int as nth from (select chosen, unnest(range(1, len(chosen) + 1)) as i from (select chosen from far order by n desc limit 1)))"


def _farthest_sql(first: str, k: int) -> str:
    return f"{_PAIRS_SQL}, {_ZERO}, {_FARTHEST.format(first=first, k=k)}, {_MARKS} select landmark, nth, b as v, d as dist from marks join z on a = landmark"


@_query(_farthest_sql("select 1, [min(src)] from sy", search.LANDMARKS))
def landmark_farthest(spark, d):
    return search.farthest_landmarks(_symmetric_nations(spark, d))


_COVERED = f"""select {search.LANDMARKS // 2}, list(b order by gain desc, b)[:{search.LANDMARKS // 2}] from (select x.b, sum(abs(x.d - y.d)) as gain
from (select i // 2 as n, min(v) filter (i % 2 = 0) as s, min(v) filter (i % 2 = 1) as t
    from (select v, row_number() over (order by (v * 2654435761 + 40503) % 4294967296, v) - 1 as i from (select distinct src as v from sy)) where i < {2 * search.SAMPLED_PAIRS}
    group by 1 having count(*) = 2) join z x on x.a = s join z y on y.a = t and y.b = x.b group by 1)"""


@_query(_farthest_sql(_COVERED, search.LANDMARKS))
def landmark_covering(spark, d):
    return search.covering_landmarks(_symmetric_nations(spark, d))


#: Places of nations, and arcs at least as long as the way between their ends.
_PLACES = "pl as (select src as id, (src * 37 % 101) * 1000.0::double as x, (src * 53 % 103) * 1000.0::double as y from (select distinct src from sy))"
_PLACED = f"""{_NT}, {_PLACES}, gy as (select src, dst, ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))::bigint + w % 1000 as w from sy join pl a on a.id = src join pl b on b.id = dst)"""


def _placed_nations(spark, d):
    e = _symmetric_nations(spark, d)
    at = lambda c, m, n: (F.col(c) * m % n) * 1000.0
    places = e.select(F.col("src").alias("id")).distinct().select("id", at("id", 37, 101).alias("x"), at("id", 53, 103).alias("y"))
    gap = lambda m, n: at("src", m, n) - at("dst", m, n)
    far = F.ceil(F.sqrt(gap(37, 101) * gap(37, 101) + gap(53, 103) * gap(53, 103))).cast("long")
    return materialize(e.select("src", "dst", (far + F.col("w") % 1000).alias("w")), "placed"), places


def _searched(spark, d, strategy):
    e, places = _placed_nations(spark, d)
    marks = search.farthest_landmarks(e) if strategy.startswith("landmark") else None
    return search.search(e, _every_pair(e), strategy, places, marks), e


_PLACED_PAIRS = f"with recursive {_PLACED}, {_ALL.format(t='gy')}"
_COST_SQL = f"{_PLACED_PAIRS} select a as src, b as dst, d::double as cost from m"


@_query(_COST_SQL)
def astar_cost(spark, d):
    return _searched(spark, d, "astar")[0].select("src", "dst", "cost")


@_query(_COST_SQL)
def astar_tie_break_cost(spark, d):
    return _searched(spark, d, "tie_break")[0].select("src", "dst", "cost")


@_query(_COST_SQL)
def two_sided_cost(spark, d):
    return _searched(spark, d, "two_sided")[0].select("src", "dst", "cost")


@_query(_COST_SQL)
def landmark_cost(spark, d):
    return _searched(spark, d, "landmark")[0].select("src", "dst", "cost")


@_query(_COST_SQL)
def landmark_two_sided_cost(spark, d):
    return _searched(spark, d, "landmark_two_sided")[0].select("src", "dst", "cost")


@_query(f"{_PLACED_PAIRS} select a as src, b as dst, d::double as best, s.strategy, true as within from m, (values ('weighted_1.5'), ('weighted_2.0'), ('landmark_two_sided_1.1'), ('landmark_two_sided_1.5')) s(strategy)")
def weighted_search_bound(spark, d):
    e, places = _placed_nations(spark, d)
    marks, pairs, out = search.farthest_landmarks(e), _every_pair(e), None
    best = search.search(e, pairs, "astar", places).select("src", "dst", F.col("cost").alias("best"))
    for name, factor in (("weighted_1.5", 1.5), ("weighted_2.0", 2.0), ("landmark_two_sided_1.1", 1.1), ("landmark_two_sided_1.5", 1.5)):
        found = search.search(e, pairs, name, places, marks).join(best, ["src", "dst"])
        one = found.select("src", "dst", "best", F.lit(name).alias("strategy"), ((F.col("cost") >= F.col("best")) & (F.col("cost") <= factor * F.col("best"))).alias("within"))
        out = one if out is None else out.union(one)
    return out


@_query(f"{_PLACED_PAIRS} select a as src, b as dst, d::double as cost, true as fewer from m")
def astar_expanded(spark, d):
    """Costs, and whether the straight line spares expansions of a plain search."""
    e, places = _placed_nations(spark, d)
    plain = search.search(e, _every_pair(e), "astar").select("src", "dst", F.col("expanded").alias("all"))
    found = search.search(e, _every_pair(e), "astar", places)
    return found.join(plain, ["src", "dst"]).select("src", "dst", "cost", (F.col("expanded") <= F.col("all")).alias("fewer"))


_BATCH = ["astar", "tie_break", "two_sided", "landmark", "landmark_two_sided", "landmark@covering", "landmark_two_sided@covering"]


@_query(f"{_PLACED_PAIRS} select s.strategy, count(*) as pairs, round(avg(d), 6) as mean_cost, 1.0::double as worst_ratio, count(*) as optimal from m, (values {', '.join(f'({s!r})' for s in _BATCH)}) s(strategy) group by 1")
def search_batch(spark, d):
    e, places = _placed_nations(spark, d)
    return search.batch_summary(e, _every_pair(e), _BATCH, places, search.farthest_landmarks(e), search.covering_landmarks(e)).select(
        "strategy", "pairs", "mean_cost", "worst_ratio", "optimal"
    )


# --- sequences --------------------------------------------------------------------------------

_CAPACITY = 60


@_query(f"""with recursive items as (select p_brand, p_size as w, cast(round(p_retailprice * 100) as bigint) as v, row_number() over (partition by p_brand order by p_partkey) as i from part),
k(p_brand, i, best) as (select distinct p_brand, 0::bigint, list_transform(range({_CAPACITY + 1}), lambda x: 0::bigint) from items union all
select k.p_brand, k.i + 1, list_transform(range({_CAPACITY + 1}), lambda c: greatest(best[c + 1], case when c >= w then best[c + 1 - w] + v else 0 end)) from k join items on items.p_brand = k.p_brand and items.i = k.i + 1)
select p_brand, arg_max(best, i)[{_CAPACITY + 1}] as best from k group by 1""")
def knapsack_by_brand(spark, d):
    item = F.struct(F.col("p_size").alias("w"), F.expr("cast(round(p_retailprice * 100) as bigint)").alias("v"))
    packs = _table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(item).alias("items"))
    return packs.select("p_brand", functions.knapsack(F.col("items"), _CAPACITY).alias("best"))


@_query("""with recursive n as (select p_partkey, string_split(lower(p_name), '') as x, string_split(lower(p_type), '') as y from part),
k(p_partkey, i, x, y, best) as (select p_partkey, 0::bigint, x, y, list_transform(range(len(y) + 1), lambda j: 0::bigint) from n union all
select p_partkey, i + 1, x, y, list_transform(range(len(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda h: case when h > 0 and y[h] = x[i + 1] then best[h] + 1 else best[h + 1] end))) from k where i < len(x))
select p_partkey, arg_max(best, i)[len(any_value(y)) + 1] as lcs from k group by 1""")
def lcs_names(spark, d):
    return _table(spark, d, "part").select("p_partkey", functions.lcs_length(F.lower("p_name"), F.lower("p_type")).cast("long").alias("lcs"))


@_query("""with s as (select lang, unnest(regexp_extract_all(text, '(?s).')) as symbol from documents)
select lang, symbol, count(*) as n from s group by 1, 2""")
def symbol_freq(spark, d):
    return sequences.symbol_counts(_table(spark, d, "documents"), "lang", "text")


@_query("""with recursive s as (select lang, unnest(regexp_extract_all(text, '(?s).')) as symbol from documents), c as (select lang, symbol, count(*) as n from s group by 1, 2),
t as (select lang, count(*) as symbols, sum(n)::bigint as total, list_sort(list(n)) as heap from c group by 1),
m(lang, heap, bits) as (select lang, heap, 0::hugeint from t union all select lang, list_sort(list_append(heap[3:], heap[1] + heap[2])), bits + heap[1] + heap[2] from m where len(heap) > 1),
b as (select lang, max(bits) as bits from m group by 1)
select t.lang, symbols, total * 8 as plain_bits, (case when symbols = 1 then total else bits end)::bigint as coded_bits,
round((case when symbols = 1 then total else bits end) / (total * 8)::double, 6) as ratio, case when symbols = 1 then 0.5::double else 1.0::double end as kraft from t join b on b.lang is not distinct from t.lang""")
def huffman_sizes(spark, d):
    return sequences.sizes(sequences.huffman(sequences.symbol_counts(_table(spark, d, "documents"), "lang", "text"), "lang"), "lang")


@_query("select p_partkey, p_name as decoded from part")
def huffman_roundtrip(spark, d):
    names = _table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    book = materialize(sequences.huffman(sequences.symbol_counts(names, "p_brand", "p_name"), "p_brand"), "codes")
    coded = sequences.encode(names, book, "p_brand", "p_name").select("p_partkey", "p_brand", "bits")
    return sequences.decode(coded, book, "p_brand").select("p_partkey", "decoded")


# --- chains -----------------------------------------------------------------------------------

_EV = """ev as (select user_id, event_type as i, lead(event_type) over (partition by user_id order by ts, event_id) as j from events),
c as (select i, j, count(*) as n from ev where j is not null group by 1, 2),
p as (select i, j, n, n / sum(n) over (partition by i) as p from c)"""
_F = "f as (select distinct i as x, length(i)::double as f from p)"
_CARRE = f"""{_EV}, {_F}, st as (select p.i, p.j, p.p, a.f as fi, b.f as fj from p join f a on a.x = p.i join f b on b.x = p.j),
g as (select i, sum(p * fj) as tf, sum(p * (fj - fi) * (fj - fi)) / 2 as gamma from st group by 1),
tg as (select p.i, sum(p * gamma) as t_gamma from p join g on g.i = p.j group by 1),
cr as (select st.i, sum(p * (fj - fi) * (b.tf - a.tf)) / 2 as cr from st join g a on a.i = st.i join g b on b.i = st.j group by 1)"""


def event_chain(spark, d) -> DataFrame:
    """``(i, j, n, p)`` between the types of a user's consecutive events."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = _table(spark, d, "events").select(F.col("event_type").alias("i"), after.alias("j")).filter("j is not null")
    return materialize(markov.transitions(pairs), "chain")


def _function(chain):
    return chain.select(F.col("i").alias("x")).distinct().select("x", F.length("x").cast("double").alias("f"))


@_query(f"with {_EV} select i, j, n, round(p, 6) as p from p")
def markov_transition(spark, d):
    return event_chain(spark, d).select("i", "j", "n", F.round("p", 6).alias("p"))


@_query(f"""with {_EV} select e.i, e.j, round(coalesce(-2 * ln(nullif(sum(sqrt(a.p * b.p)), 0)), 30), 6) as kbc
from p e left join p a on a.i = e.i left join p b on b.i = e.j and b.j = a.j group by 1, 2""")
def kbc_edges(spark, d):
    return markov.overlap_curvature(event_chain(spark, d)).select("i", "j", F.round("kbc", 6).alias("kbc"))


@_query(f"""with {_EV}, r as (select i, sum(sqrt(p)) as r from p group by 1)
select p.i, p.j, round(2 * p.p - (a.r - sqrt(p.p) + coalesce(b.r, 0) - coalesce(sqrt(q.p), 0)) / sqrt(p.p), 6) as frc
from p join r a on a.i = p.i left join r b on b.i = p.j left join p q on q.i = p.j and q.j = p.i""")
def forman_edges(spark, d):
    return markov.forman_curvature(event_chain(spark, d)).select("i", "j", F.round("frc", 6).alias("frc"))


@_query(f"with {_CARRE} select g.i, round(tf, 6) as tf, round(gamma, 6) as gamma, round(t_gamma, 6) as t_gamma, round(t_gamma / 2 - cr, 6) as gamma2 from g join tg using (i) join cr using (i)")
def carre_du_champ(spark, d):
    chain = event_chain(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return markov.carre_du_champ(chain, _function(chain)).select("i", r("tf"), r("gamma"), r("t_gamma"), r("gamma2"))


#: Least ratio of gamma2 to gamma over 40 test functions made from digests.
_BOUND = """{chain}, tf as (select k, x, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) as f from (select k, x,
    (('0x' || substr(md5(x || ':' || k || ':0'), 1, 7))::bigint + 1) / 268435457.0::double as u0, (('0x' || substr(md5(x || ':' || k || ':1'), 1, 7))::bigint + 1) / 268435457.0::double as u1
    from (select distinct x from (select i as x from q union all select j from q)), range(40) t(k))),
qs as (select a.k, q.i, q.j, q.p, a.f as fi, b.f as fj from q join tf a on a.x = q.i join tf b on b.x = q.j and b.k = a.k),
qg as (select k, i, sum(p * fj) as tf, sum(p * (fj - fi) * (fj - fi)) / 2 as gamma from qs group by 1, 2),
qt as (select g.k, q.i, sum(p * gamma) as t_gamma from q join qg g on g.i = q.j group by 1, 2),
qc as (select qs.k, qs.i, sum(p * (fj - fi) * (b.tf - a.tf)) / 2 as cr from qs join qg a on a.k = qs.k and a.i = qs.i join qg b on b.k = qs.k and b.i = qs.j group by 1, 2),
kb as (select min((t_gamma / 2 - cr) / gamma) as k from qg join qt using (k, i) join qc using (k, i) where gamma >= 1e-12)"""
_ONE_STEP, _TWO_STEPS = "q as (select i, j, p from p)", "q as (select a.i, b.j, sum(a.p * b.p) as p from p a join p b on a.j = b.i group by 1, 2)"


@_query(f"with {_CARRE}, {_BOUND.format(chain=_ONE_STEP)} select g.i, round(greatest(0, t_gamma / 2 - cr.cr - (select k from kb) * gamma), 6) as residual from g join tg using (i) join cr using (i)")
def gamma_residual(spark, d):
    chain = event_chain(spark, d)
    return markov.residual(chain, _function(chain), markov.curvature_bound(chain)).select("i", F.round("residual", 6).alias("residual"))


@_query(f"with {_EV} select a.i, b.j, round(sum(a.p * b.p), 6) as p from p a join p b on a.j = b.i group by 1, 2")
def markov_power2(spark, d):
    return markov.power(event_chain(spark, d), 2).select("i", "j", F.round("p", 6).alias("p"))


@_query(f"with {_EV} select a.i as a, b.i as b, round(sum(a.p * ln(a.p / b.p)), 6) as kl from p a join p b on a.j = b.j and a.i <> b.i group by 1, 2")
def kl_states(spark, d):
    emit = event_chain(spark, d).select(F.col("i").alias("state"), F.col("j").alias("symbol"), "p")
    return markov.divergence(emit).select("a", "b", F.round("kl", 6).alias("kl"))


def _flow_sql() -> str:
    """The steps of the flow written out one after the other."""
    parts = [_EV, "w0 as (select i, j, p as w from p)"]
    for k in range(markov.FLOW_STEPS):
        parts.append(f"""s{k} as (select i as x, sum(sqrt(w)) as r, sum(w) as s from w{k} group by 1),
f{k} as (select e.i, e.j, e.w, case when e.w < 1e-12 then 0 else e.w * (case when a.s > 1e-12 then 1 / a.s else 0 end + case when coalesce(b.s, 0) > 1e-12 then 1 / b.s else 0 end)
    - (a.r - sqrt(e.w) + coalesce(b.r, 0) - sqrt(coalesce(q.w, 0))) / sqrt(e.w) end as frc
    from w{k} e join s{k} a on a.x = e.i left join s{k} b on b.x = e.j left join w{k} q on q.i = e.j and q.j = e.i),
w{k + 1} as (select i, j, g / sum(g) over (partition by i) as w from (select i, j, w * exp({markov.FLOW_RATE} * frc) as g from f{k}))""")
    return f"with {', '.join(parts)} select i, j, round(w, 6) as w from w{markov.FLOW_STEPS}"


@_query(_flow_sql())
def ricci_flow_edges(spark, d):
    return markov.ricci_flow(event_chain(spark, d)).select("i", "j", F.round("w", 6).alias("w"))


@_query()
def transport_edges(spark, d):
    return markov.transport_curvature(event_chain(spark, d)).select("i", "j", F.round("orc", 6).alias("orc"))


@_query(f"with {_EV}, {_BOUND.format(chain=_ONE_STEP)} select round(k, 6) as bound from kb")
def curvature_bound(spark, d):
    return spark.createDataFrame([(round(markov.curvature_bound(event_chain(spark, d)), 6),)], "bound double")


@_query(f"with {_EV}, {_BOUND.format(chain=_TWO_STEPS)} select round(k, 6) as bound from kb")
def hop_bound(spark, d):
    return spark.createDataFrame([(round(markov.hop_bound(event_chain(spark, d), 2), 6),)], "bound double")


@_query(f"""with {_EV}, lead as (select length(i) % 2 as c, min(i) as i from (select distinct i from p) group by 1),
e as (select c, j, p.p from p join lead using (i)) select round(greatest(1e-12, sum(a.p * ln(a.p / b.p))), 6) as kl from e a join e b on a.j = b.j and a.c = 0 and b.c = 1 where a.p > 1e-12""")
def kl_communities(spark, d):
    chain = event_chain(spark, d)
    sides = chain.select(F.col("i").alias("state")).distinct().withColumn("community", F.length("state") % 2)
    return markov.least_divergence(chain.select(F.col("i").alias("state"), F.col("j").alias("symbol"), "p"), sides).select(F.round("kl", 6).alias("kl"))


_LENGTHS = [200, 400, 600, 800, 1200, 1600, 3200, 6400]


@_query(f"""with l as (select unnest({_LENGTHS})::bigint as t), c as (select t, 0.25 * 0.4 * 0.15 / 8 * pow(t * 0.8 / 10, 2) * 0.09 as free, t * 0.2 / 10 * ln(360) as cap from l),
g as (select t, 10 * least(free, cap) as gap, free >= cap as capped from c)
select t, round(gap, 6) as gap, round(gap / first_value(gap) over (order by t), 6) as ratio, t * t / 40000.0::double as square, capped,
round(ln(360) / 0.25 * sqrt(8 * ln(20) / t), 6) as threshold from g""")
def scaling_table(spark, d):
    lengths = spark.createDataFrame([(t,) for t in _LENGTHS], "t long")
    rows = markov.scaling_table(lengths, 360, 0.25, -0.4, 0.3, 0.85, 0.2, 10)
    limit = markov.sequence_threshold(360, 0.25, 0.05, F.col("t"))
    return rows.select("t", F.round("gap", 6).alias("gap"), F.round("ratio", 6).alias("ratio"), "square", "capped", F.round(limit, 6).alias("threshold"))


_BUCKET = "least(9, greatest(0, floor(value / 20)))"


def _hmm(spark, d):
    rows = _table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.expr(f"cast(coalesce({_BUCKET}, 0) as bigint)").alias("symbol"))
    chain = event_chain(spark, d)
    n = rows.groupBy(F.col("event_type").alias("state"), "symbol").agg(F.count("*").alias("n"))
    every = n.select("state").distinct().crossJoin(F.broadcast(n.select("symbol").distinct()))
    smooth = every.join(n, ["state", "symbol"], "left").select("state", "symbol", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    emit = smooth.join(smooth.groupBy("state").agg(F.sum("n").alias("t")), "state").select("state", "symbol", (F.col("n") / F.col("t")).alias("p"))
    total = rows.count()
    prior = rows.groupBy(F.col("event_type").alias("state")).agg((F.count("*") / F.lit(total)).alias("p"))
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return rows.select(F.col("user_id").alias("seq"), t.alias("t"), "symbol"), markov.model(chain, emit, prior), chain


_HMM_SQL = f"""{_EV}, o as (select user_id as seq, row_number() over (partition by user_id order by ts, event_id) as t, event_type, coalesce({_BUCKET}, 0)::bigint as symbol from events),
n as (select event_type as state, symbol, count(*) as n from o group by 1, 2),
sm as (select a.state, b.symbol, coalesce(n.n, 0) + 1 as n from (select distinct state from n) a cross join (select distinct symbol from n) b left join n on n.state = a.state and n.symbol = b.symbol),
em as (select state, symbol, ln(n / sum(n) over (partition by state)) as lb from sm),
pr as (select event_type as state, ln(count(*) / (select count(*) from events)) as lp from events group by 1),
vit(seq, t, state, score) as (select seq, t, pr.state, lp + lb from o join pr on true join em on em.state = pr.state and em.symbol = o.symbol where t = 1
union all select v.seq, v.t + 1, em.state, max(v.score + ln(p.p)) + any_value(em.lb) from vit v join o on o.seq = v.seq and o.t = v.t + 1 join p on p.i = v.state join em on em.state = p.j and em.symbol = o.symbol group by v.seq, v.t, em.state)"""


@_query(f"with recursive {_HMM_SQL}, l as (select seq, max(t) as t from o group by 1) select seq, round(max(score), 6) as score from vit join l using (seq, t) group by 1")
def viterbi_score(spark, d):
    seqs, m, _ = _hmm(spark, d)
    return markov.decode(seqs, m).groupBy("seq").agg(F.round(F.max("score"), 6).alias("score"))


def _path_sql(extra: str = "0.0", joins: str = "", more: str = "") -> str:
    """Best states by step, ties to the smaller state, with ``extra`` on every transition."""
    return f"""{_HMM_SQL.rpartition('vit(seq')[0]}{more}
vit(seq, t, state, score, back) as (select seq, t, pr.state, lp + lb, null::varchar from o join pr on true join em on em.state = pr.state and em.symbol = o.symbol where t = 1
union all select v.seq, v.t + 1, em.state, max(v.score + (ln(p.p) + {extra})) + any_value(em.lb), min_by(v.state, struct_pack(s := -(v.score + (ln(p.p) + {extra})), n := v.state))
from vit v join o on o.seq = v.seq and o.t = v.t + 1 join p on p.i = v.state join em on em.state = p.j and em.symbol = o.symbol {joins} group by v.seq, v.t, em.state),
l as (select seq, max(t) as t from o group by 1),
way(seq, t, state) as (select vit.seq, vit.t, min_by(state, struct_pack(s := -score, n := state)) from vit join l on l.seq = vit.seq and l.t = vit.t group by 1, 2
union all select w.seq, w.t - 1, back from way w join vit on vit.seq = w.seq and vit.t = w.t and vit.state = w.state where w.t > 1)"""


@_query(f"with recursive {_path_sql()} select seq, t, state from way")
def viterbi_path(spark, d):
    seqs, m, _ = _hmm(spark, d)
    return markov.decode(seqs, m).select("seq", "t", "state")


@_query()
def field_signal(spark, d):
    seqs, m, chain = _hmm(spark, d)
    return markov.decode(seqs, m, "field", 0.2, markov.curvature_bound(chain)).select("seq", "t", "state", F.round("signal", 6).alias("signal"))


@_query()
def field_signal_two_hops(spark, d):
    seqs, m, chain = _hmm(spark, d)
    found = markov.decode(seqs, m, "field", 0.2, markov.hop_bound(chain, 2), hops=2, own_path=False)
    return found.select("seq", "t", "state", F.round("signal", 6).alias("signal"))


@_query()
def transport_signal(spark, d):
    seqs, m, chain = _hmm(spark, d)
    edges = {(r["i"], r["j"]): r["orc"] for r in markov.transport_curvature(chain).collect()} | {None: 0.5}
    return markov.decode(seqs, m, "edge", 0.2, edges=edges).select("seq", "t", "state", F.round("signal", 6).alias("signal"))


_FORMAN = """fr as (select p.i, p.j, 2 * p.p - (a.r - sqrt(p.p) + coalesce(b.r, 0) - coalesce(sqrt(q.p), 0)) / sqrt(p.p) as frc
from p join (select i, sum(sqrt(p)) as r from p group by 1) a on a.i = p.i left join (select i, sum(sqrt(p)) as r from p group by 1) b on b.i = p.j left join p q on q.i = p.j and q.j = p.i),
sc as (select 1 / greatest(1.0::double, 2 * (select count(*) from p) / (select count(*) from pr)::double) as s),"""


@_query(f"""with recursive {_path_sql('0.2 * fr.frc * sc.s', 'join fr on fr.i = p.i and fr.j = p.j cross join sc', _FORMAN)}
select w.seq, w.t, w.state, round(coalesce(fr.frc * sc.s, 0.0), 6) as signal from way w left join way b on b.seq = w.seq and b.t = w.t - 1 left join fr on fr.i = b.state and fr.j = w.state cross join sc""")
def forman_signal(spark, d):
    seqs, m, chain = _hmm(spark, d)
    scale = 1 / max(1.0, 2 * chain.count() / len(m.states))
    edges = {(r["i"], r["j"]): r["frc"] * scale for r in markov.forman_curvature(chain).collect()} | {None: 0.0}
    return markov.decode(seqs, m, "edge", 0.2, edges=edges).select("seq", "t", "state", F.round("signal", 6).alias("signal"))


# --- metrics ----------------------------------------------------------------------------------

_SCORED = "x as (select value as s, (event_type = 'purchase')::int as y from events where value is not null)"


def _scored(spark, d):
    return _table(spark, d, "events").filter("value is not null").select(F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@_query(f"""with {_SCORED}, g as (select s, sum(y) as p, sum(1 - y) as n from x group by 1), c as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as b from g)
select round(sum(p * b + p * n / 2) / sum(p) / sum(n), 6) as auroc from c""")
def auroc(spark, d):
    return metrics.auroc(_scored(spark, d), "s", "y")


@_query(f"""with {_SCORED}, g as (select s, sum(y) as p, sum(1 - y) as n from x group by 1),
c as (select s, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as fp, (select sum(y) from x) as a from g), f as (select s, round(tp * 2.0::double / (tp + fp + a), 6) as f1 from c)
select f1 as best_f1, s as threshold from f order by f1 desc, s limit 1""")
def best_f1(spark, d):
    return metrics.best_f1(_scored(spark, d), "s", "y")


@_query(f"""with {_SCORED}, c as (select count(*) filter (s >= 50 and y = 1) as tp, count(*) filter (s >= 50 and y = 0) as fp, count(*) filter (s < 50 and y = 1) as fn from x)
select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(tp * 2.0::double / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d).withColumn("p", (F.col("s") >= 50).cast("int")), "p", "y")


@_query("""with o as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, (event_type in ('click', 'view'))::int as y, value as s from events),
b as (select *, sum(case when y = 1 and coalesce(pr, 0) <> 1 then 1 else 0 end) over (partition by user_id order by i) as burst from (select *, lag(y) over (partition by user_id order by i) as pr from o)),
r as (select user_id, burst, min(i) as start, min(i) filter (s >= 80) as first from b where y = 1 group by 1, 2)
select user_id, count(*) as bursts, count(first) as detected, round(avg(first - start), 6) as mean_delay from r group by 1""")
def detection_delay(spark, d):
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _table(spark, d, "events").select("user_id", t.alias("t"), F.col("value").alias("s"), F.col("event_type").isin("click", "view").cast("int").alias("y"))
    return metrics.detection_delay(rows, "user_id", "t", "s", "y", 80.0)


@_query("""select event_type, count(value) as n, round(min(value), 6) as least, round(max(value), 6) as most, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd,
round(median(value), 6) as median, round(stddev_samp(value) / avg(value) * 100, 6) as cv, round(stddev_samp(value) * 2.045 / sqrt(count(value)), 6) as half_width from events group by 1""")
def sample_stats(spark, d):
    return metrics.describe(_table(spark, d, "events"), "event_type", "value")


@_query("""with s as (select count(value) filter (event_type = 'click') as n1, avg(value) filter (event_type = 'click') as m1, var_samp(value) filter (event_type = 'click') as v1,
count(value) filter (event_type = 'view') as n2, avg(value) filter (event_type = 'view') as m2, var_samp(value) filter (event_type = 'view') as v2 from events),
e as (select *, v1 / n1 as e1, v2 / n2 as e2 from s), t as (select (m1 - m2) / sqrt(e1 + e2) as t, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) as df from e), z as (select *, abs(t) * (1 - 1 / (4 * df)) as z from t)
select round(t, 6) as t, round(df, 6) as df, round(least(1.0::double, 2 * exp(-0.717 * z - 0.416 * z * z)), 6) as p from z""")
def welch(spark, d):
    return metrics.welch(_table(spark, d, "events"), "event_type", "value", "click", "view")


@_query("""with x as (select cast(round((l_tax - l_discount) * 100) as bigint) as d from lineitem), g as (select abs(d) as a, sum((d > 0)::int) as up, sum((d < 0)::int) as down from x where d <> 0 group by 1),
r as (select *, coalesce(sum(up + down) over (order by a rows between unbounded preceding and 1 preceding), 0) + (up + down + 1) / 2 as r from g),
s as (select sum(up + down)::bigint as n, sum(up * r) as wp, sum(down * r) as wm from r)
select n, round(wp, 6)::double as w_plus, round(wm, 6)::double as w_minus, round(sign(wp - wm) * greatest(0, abs(wp - wm) / 2 - 0.5) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24.0), 6) as z from s""")
def wilcoxon(spark, d):
    gap = F.expr("cast(round((l_tax - l_discount) * 100) as bigint)")
    rows = _table(spark, d, "lineitem").select(F.lit(0).cast("long").alias("a"), gap.alias("b"))
    return metrics.wilcoxon(rows, "a", "b").select("n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), "z")


@_query("""with o as (select l_orderkey, l_returnflag, l_extendedprice from lineitem), b as (select l_orderkey, min(struct_pack(v := l_extendedprice, c := l_returnflag)) as b from o group by 1)
select b.c as contender, count(*) as wins from b group by 1""")
def algo_wins(spark, d):
    return metrics.wins(_table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_extendedprice")


@_query("""with a as (select event_id, event_type as x, lag(event_type) over (partition by user_id order by ts, event_id) as y from events)
select count(*) as n, round(avg((x is not distinct from y)::int), 6) as share from a""")
def path_agreement(spark, d):
    rows = _table(spark, d, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return metrics.agreement(rows.select("event_id", F.col("event_type").alias("x")), rows.select("event_id", before.alias("x")), ["event_id"], "x")


from plexus import catalog_more  # noqa: E402, F401  registers its queries
