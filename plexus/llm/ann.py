"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Vectors are dealt to shards by the hash of their id; a shard is a value of its own, so that the
graphs depend on the vectors alone, however the rows are partitioned.  A shard adds one coordinate to its vectors
that makes them equally long, which turns the largest inner product into the smallest distance, and
builds a directed graph: for each batch of new vectors a greedy search of the graph so far
proposes neighbours, pruning with a relaxed distance (``ALPHA``) keeps diverse edges, and reverse
edges are added and pruned where they exceed the degree.  A query runs a beam search from the
centre of every shard; the found vectors are scored again exactly, in double precision, and the
best over all shards are returned.

Every row is indexed.  Equal vectors share a node that lists their ids in order, so that a hot
vector costs one node and ties still fall to the smaller id.  Queries go out in blocks of bounded
bytes against all shards, one block after the other; a task searches several shards and sends out
the best of them all, so that what is sent grows with queries and tasks, not with shards.  Vectors that are null, zero or hold null or non-finite components take no
part, as do null ids; a repeated id counts with its smallest vector, and vectors of another length than the
first in a shard raise.  With fewer candidates than asked for, all that the graph reaches return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.plans.loops import Levels
from plexus.plans.tables import materialize, release
from plexus.plans.workers import tidy

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 112
ALPHA = 1.2
#: Shards: at least so many, and more once a shard would exceed the rows, up to which the beam
#: reaches its recall, or the bytes.
SHARDS, SHARD_ROWS, SHARD_BYTES = 12, 10_000, 64 << 20
#: Bytes of query vectors that a broadcast block holds, and search tasks for each core.
BLOCK_BYTES, TASKS = 16 << 20, 4
#: Queries that walk a graph together.
WALK = 512


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``beam`` nearest nodes met and their squared distances, nearest first.

    ``edges`` has a row of neighbours per node, padded with -1; missing results are -1 and infinite.
    """
    n, out_ids, out_far = len(points), [], []
    norms = np.einsum("ij,ij->i", points, points)
    for at in range(0, len(queries), WALK):
        q = queries[at : at + WALK]
        m, rows = len(q), np.arange(len(q))
        qn = np.einsum("ij,ij->i", q, q)
        ids = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n + 1), bool)
        ids[:, 0], open_[:, 0], seen[:, start], seen[:, n] = start, True, True, True
        far[:, 0] = qn - 2 * (q @ points[start]) + norms[start]
        live = rows
        while len(live):
            pick = np.argmax(open_[live], axis=1)
            going = open_[live, pick]
            live, pick = live[going], pick[going]
            if not len(live):
                break
            open_[live, pick] = False
            near = edges[ids[live, pick]]
            near = np.where(near < 0, n, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            near = np.where(fresh, near, 0)
            d = qn[live, None] - 2 * np.einsum("ijk,ik->ij", points[near], q[live], optimize=True) + norms[near]
            d[~fresh] = np.inf
            all_far = np.concatenate((far[live], d), axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, order, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), axis=1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate((open_[live], fresh), axis=1), order, 1) & np.isfinite(far[live])
        ids[~np.isfinite(far)] = -1
        out_ids.append(ids)
        out_far.append(far)
    return np.concatenate(out_ids), np.concatenate(out_far)


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of each node out of its proposals (padded with -1).

    The nearest remaining proposal is kept and strikes out those that are ``alpha`` times nearer to
    it than to the node, until the degree is reached.
    """
    out = np.full((len(nodes), degree), -1, np.int64)
    for at in range(0, len(nodes), WALK):
        who, c = nodes[at : at + WALK], proposed[at : at + WALK]
        ok = (c >= 0) & (c != who[:, None])
        x = points[np.where(ok, c, 0)]
        sq = np.einsum("ijk,ijk->ij", x, x)
        home = np.einsum("ijk,ijk->ij", x - points[who][:, None], x - points[who][:, None])
        home[~ok] = np.inf
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        rows = np.arange(len(who))
        for k in range(degree):
            best = np.argmin(home, axis=1)
            some = np.isfinite(home[rows, best])
            if not some.any():
                break
            out[at + rows[some], k] = c[rows, best][some]
            struck = (alpha * alpha) * between[rows, best] <= home
            struck[rows, best] = True
            home[struck & some[:, None]] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (padded with -1) and the start node of a graph over the points."""
    n = len(points)
    start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    done = 1
    while done < n:
        fresh = order[done : done + max(1, min(done, n // 8 + 1, 4 * WALK))]
        met, _ = beam_search(points, edges, start, points[fresh], beam)
        edges[fresh] = robust_prune(points, fresh, met, alpha, degree)
        src, to = np.repeat(fresh, degree), edges[fresh].ravel()
        src, to = src[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        src, to = src[by], to[by]
        target, first, size = np.unique(to, return_index=True, return_counts=True)
        room = degree - (edges[target] >= 0).sum(axis=1)
        easy = size <= room
        slot = np.arange(len(to)) - np.repeat(first, size)
        fits = np.repeat(easy, size)
        held = degree - np.repeat(room, size)
        edges[to[fits], (held + slot)[fits]] = src[fits]
        full = np.flatnonzero(~easy)
        if len(full):
            wide = np.full((len(full), degree + int(size[full].max())), -1, np.int64)
            wide[:, :degree] = edges[target[full]]
            place = np.repeat(np.searchsorted(full, np.arange(len(target))), size)[~fits]
            wide[place, degree + slot[~fits]] = src[~fits]
            edges[target[full]] = robust_prune(points, target[full], wide, alpha, degree)
        done += len(fresh)
    return edges, start


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec)`` of the vectors that take part, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    return rows.filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("vec").alias("vec"))


_FOUND = "query_id long, vec_id long, score double"
_SHARD = "dim int, n long, points binary, node binary, ids binary, edges binary, start long"


def _by_shard(batches):
    """``(ids, vectors)`` of each shard, from batches sorted by shard."""
    held: list[tuple] = []
    name = None

    def shard():
        width = {x.shape[1] for _, x in held}
        if len(width) > 1:
            raise ValueError("vectors differ in length")
        return np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])

    for b in batches:
        if not b.num_rows:
            continue
        ids, of, vec = b["vec_id"].to_numpy(), b["shard"].to_numpy(), b["vec"]
        flat, cut = vec.flatten().to_numpy(), np.diff(vec.offsets.to_numpy())
        if (cut != cut[0]).any():
            raise ValueError("vectors differ in length")
        rows = flat.reshape(len(cut), -1)
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            if held and of[part[0]] != name:
                yield shard()
                held = []
            name = of[part[0]]
            held.append((ids[part], rows[part]))
    if held:
        yield shard()


def _index_shards(batches):
    for ids, rows in _by_shard(batches):
        distinct, node = np.unique(rows, axis=0, return_inverse=True)
        length = (distinct * distinct).sum(axis=1)
        level = np.sqrt(np.maximum(length.max() - length, 0))
        edges, start = build_graph(np.column_stack((distinct, level)).astype(np.float32))
        order = np.lexsort((ids, node.ravel()))
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([rows.shape[1]], pa.int32()), "n": [len(ids)], "points": [distinct.tobytes()], "node": [node.ravel()[order].astype(np.int64).tobytes()],
            "ids": [ids[order].tobytes()], "edges": [edges.astype(np.int32).tobytes()], "start": [start],
        })


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shards: int = SHARDS) -> DataFrame:
    """One row per shard with its vectors, their ids and the graph, in the shared folder."""
    rows = materialize(_usable(vectors, id_col, vec_col), "vectors")
    count, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    n = max(shards, -(-count // max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (width or 1))))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    out = materialize(dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(tidy(_index_shards), _SHARD), "graph")
    release(rows)
    return out


def _search_shards(shared, k: int, beam: int):
    """The best ``k`` of each query over all shards of a task."""

    def run(batches):
        ask, q = shared.value
        best: list[tuple] = [(np.empty(0, np.int64), np.empty(0))] * len(ask)
        any_ = False
        for b in batches:
            for at in range(b.num_rows):
                r = {c: b[c][at] for c in b.schema.names}
                dim = r["dim"].as_py()
                if q.shape[1] != dim:
                    raise ValueError("vectors differ in length")
                points = np.frombuffer(r["points"].as_buffer()).reshape(-1, dim)
                ids, node = np.frombuffer(r["ids"].as_buffer(), np.int64), np.frombuffer(r["node"].as_buffer(), np.int64)
                edges = np.frombuffer(r["edges"].as_buffer(), np.int32).reshape(len(points), -1).astype(np.int64)
                cut = np.searchsorted(node, np.arange(len(points) + 1))
                length = (points * points).sum(axis=1)
                level = np.sqrt(np.maximum(length.max() - length, 0))
                flat = np.column_stack((points, level)).astype(np.float32)
                met, _ = beam_search(flat, edges, r["start"].as_py(), np.column_stack((q, np.zeros(len(q)))).astype(np.float32), beam)
                any_ = True
                for i, nodes in enumerate(met):
                    nodes = nodes[nodes >= 0]
                    score = (points[nodes] * q[i]).sum(axis=1)
                    # A node's k + 1 smallest ids are all that k results and the query's own id can need.
                    held = [ids[cut[x] : min(cut[x + 1], cut[x] + k + 1)] for x in nodes.tolist()]
                    who, what = np.concatenate([best[i][0], *held]), np.concatenate((best[i][1], np.repeat(score, list(map(len, held)))))
                    other = who != ask[i]
                    who, what = who[other], what[other]
                    top = np.lexsort((who, -what))[:k]
                    best[i] = who[top], what[top]
        if any_:
            n = [len(who) for who, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ask, n)), pa.array(np.concatenate([w for w, _ in best])), pa.array(np.concatenate([s for _, s in best]))],
                ["query_id", "vec_id", "score"],
            )

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found, ranks from 1."""
    spark = index.sparkSession
    asked = materialize(_usable(queries, id_col, vec_col), "queries")
    count, width = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = 8 * (width or 1) * count
    n = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    tasks = max(1, min(index.count(), TASKS * spark.sparkContext.defaultParallelism))
    many = Levels(spark.createDataFrame([], _FOUND), "found") if n > 1 else None
    found = spark.createDataFrame([], _FOUND)
    for block in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).orderBy("vec_id").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), np.array([r["vec"] for r in rows], np.float64)))
        part = index.repartition(tasks).mapInArrow(tidy(_search_shards(shared, k, max(beam, k + 1))), _FOUND)
        if many is None:
            found = part
        else:
            many.append(part)
            shared.unpersist()
    if many is not None:
        found = many.all()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
