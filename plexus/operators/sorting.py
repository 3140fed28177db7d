"""Ordering, three-way partition, top-k and exact nearest neighbours.

A distributed sort samples its range boundaries, so a total order costs one exchange.  Stability is
an order by the key and then by the input's sequence number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.plans.loops import Levels
from plexus.plans.tables import materialize


def sort_by(rows: DataFrame, *keys: Column, seq: str | None = None, reverse: bool = False) -> DataFrame:
    """Rows in key order; with ``seq`` the order is stable, in either direction."""
    order = [k.desc() if reverse else k.asc() for k in keys]
    return rows.orderBy(*order, *([F.col(seq).asc()] if seq else []))


def rank_all(rows: DataFrame, keys: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``keys``, without one task for all rows.

    The rows are range-partitioned by the keys; each partition numbers its own rows and starts
    where the ones before it end.  Keys must tell all rows apart, or ties fall in any order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + inner).cast("long")).drop("__part", "__start")


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """``rows`` with a running sum ``name`` of each column ``sums[name]``, without one task for all.

    Range partitions sum their own rows and start from the totals of those before them.  Equal
    keys fall into one partition, in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = dealt.join(F.broadcast(starts), "__part")
    made = {n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return joined.withColumns(made).drop("__part", *[f"__{n}" for n in sums])


def running_max(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` up to each, by range partitions as in ``running_sums``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    most = dealt.groupBy("__part").agg(F.max(value).alias("__m"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = most.select("__part", F.max("__m").over(before).alias("__m"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.greatest(F.col("__m"), F.max(value).over(inside))).drop("__part", "__m")


def is_sorted(rows: DataFrame, seq: str, key: str) -> bool:
    """Whether ``key`` never falls along ``seq``; compares neighbours, then the seams of ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.select(F.col(seq).alias("s"), F.col(key).alias("k"))
    dealt = materialize(pairs.repartitionByRange(parts, "s").withColumn("p", F.spark_partition_id()), "ranges")
    fall = F.lag("k").over(Window.partitionBy("p").orderBy("s")) > F.col("k")
    if not dealt.select(fall.alias("fall")).filter("fall").isEmpty():
        return False
    ends = dealt.groupBy("p").agg(F.min_by("k", "s").alias("first"), F.max_by("k", "s").alias("last"))
    seam = F.lag("last").over(Window.orderBy("p")) > F.col("first")
    return ends.select(seam.alias("fall")).filter("fall").isEmpty()


def three_way(rows: DataFrame, key: str, pivot) -> DataFrame:
    """``rows`` with ``side``: 0 below the pivot, 1 equal, 2 above."""
    k = F.col(key)
    return rows.withColumn("side", F.when(k < F.lit(pivot), 0).when(k == F.lit(pivot), 1).otherwise(2))


def top_k(rows: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The first ``k`` rows in key order; partial heaps per partition, then one merge."""
    return rows.orderBy(*keys).limit(k)


def top_by_count(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys ``(key, n)``, ties to the smaller key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_per_group(rows: DataFrame, group: str, k: int, *keys: Column) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``; groups are pruned before they move."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).filter(F.col("rank") <= k)


#: Bytes of query vectors that go out at once, and squared distances that a task holds.
KNN_BLOCK_BYTES, KNN_CELLS = 8 << 20, 1 << 21


def knn(points: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Exact ``k`` nearest ``points(id, x)`` of each of ``queries(id, x)`` by squared distance.

    Returns ``(query_id, rank, id, dist)``, ties to the smaller id, a point itself left out.  Queries
    go out in blocks of bounded bytes, or of about ``block`` queries, one block after the other.  A task finds the candidates of a
    batch of points by a matrix product, measures those exactly, and sends ``k`` rows for each query.
    """
    asked = materialize(queries.select(F.col("id").cast("long").alias("query_id"), F.col("x").cast("array<double>").alias("q")), "asked")
    n, width = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    spark, size = points.sparkSession, 8 * (width or 1) * n
    blocks = -(-n // block) if block else 1 if size <= KNN_BLOCK_BYTES else -(-2 * size // KNN_BLOCK_BYTES)
    base = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).filter("x is not null")
    kind = "query_id long, id long, dist double"
    found = Levels(spark.createDataFrame([], kind), "knn")
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        if some:
            shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in some]), np.array([r["q"] for r in some])))
            found.append(base.mapInArrow(_nearest(shared, k), kind))
            shared.unpersist()
    if not found.n:
        return spark.createDataFrame([], "query_id long, rank int, id long, dist double")
    best = Window.partitionBy("query_id").orderBy("dist", "id")
    return found.all().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def _nearest(shared, k: int):
    def run(batches):
        asked, q = shared.value
        norm = (q * q).sum(axis=1)
        ids, far = np.empty((len(asked), 0), np.int64), np.empty((len(asked), 0))
        for b in batches:
            step = max(k + 1, KNN_CELLS // max(1, len(asked)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = part["x"].flatten().to_numpy().reshape(part.num_rows, -1)
                own = part["id"].to_numpy()
                rough = norm[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)[None, :]
                rough[own[None, :] == asked[:, None]] = np.inf
                m = min(k, len(own))
                # the product is rounded: whatever may be among the nearest is measured again
                limit = np.partition(rough, m - 1, axis=1)[:, m - 1]
                limit = limit + 1e-9 * (np.abs(limit) + norm + (x * x).sum(axis=1).max())
                rows, cols = np.nonzero(rough <= limit[:, None])
                gap = x[cols] - q[rows]
                exact = np.zeros(len(rows))
                for j in range(gap.shape[1]):
                    exact += gap[:, j] * gap[:, j]
                n = np.bincount(rows, minlength=len(asked))
                wide = int(n.max(initial=0))
                slot = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                new_ids, new_far = np.full((len(asked), wide), np.iinfo(np.int64).max), np.full((len(asked), wide), np.inf)
                new_ids[rows, slot], new_far[rows, slot] = own[cols], exact
                ids, far = np.concatenate((ids, new_ids), axis=1), np.concatenate((far, new_far), axis=1)
                order = np.lexsort((ids, far), axis=1)[:, :k]
                ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        held = np.isfinite(far)
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asked, held.sum(axis=1)), "id": ids[held], "dist": far[held]})

    return run
