"""Minimum spanning forests: one contract, several strategies.

Edges are ordered by ``(w, u, v)``, which makes the forest unique whatever the strategy.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.components import connected_components
from plexus.operators.graph import normalise
from plexus.operators.paths import KERNEL_EDGES
from plexus.plans.loops import Levels
from plexus.plans.tables import materialize, release
from plexus.plans.workers import tidy

#: Hooking edges of a round that one task labels; more are contracted in rounds.
HOOKS_IN_ONE_TASK = 500_000
#: Edges that one task's kernel may hold beside its executor's heap; more go through the forests of parts.
FOREST_EDGES = 2_000_000
#: Rows of a batch that a kernel sends back.
OUT_ROWS = 50_000
#: Edges of a part whose forest a kernel leaves, on average, where a graph is too large for one task.
PART_EDGES = 500_000
#: Parents of a root and of an item outside a Fibonacci heap; the latter ends lists of children, too.
_ROOT, _OUT = -1, -2


class UnionFind:
    """Disjoint sets by rank with path halving."""

    def __init__(self, items=()) -> None:
        self.parent = {x: x for x in items}
        self.rank = dict.fromkeys(self.parent, 0)
        self.n_components = len(self.parent)

    def find(self, x):
        if x not in self.parent:
            self.parent[x], self.rank[x] = x, 0
            self.n_components += 1
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.parent[b] = a
        self.rank[a] += self.rank[a] == self.rank[b]
        self.n_components -= 1
        return True

    def connected(self, a, b) -> bool:
        return self.find(a) == self.find(b)


def _boruvka(edges: DataFrame, contract: bool) -> DataFrame:
    """The forest of ``edges`` by rounds of hooking until no edge is left."""
    chosen, state = _hooked(edges, contract, 0)
    release(state)
    return chosen.all() if chosen.n else edges.select("u", "v", "w").limit(0)


def _hooked(edges: DataFrame, contract: bool, rest: int) -> tuple[Levels, DataFrame]:
    """Every component hooks to the other end of its least edge at once; then edges are renamed.

    With ``contract`` only the least of the edges between two components is carried on.  Returns the
    edges chosen and, once they are at most ``rest``, those between components, ``(a, b, w, u, v)``.
    """
    state = materialize(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"), "mst")
    chosen = Levels(edges.select("u", "v", "w"), "forest")
    while state.count() > rest:
        key = F.struct("w", "u", "v")
        ends = state.select(F.col("a").alias("c"), key.alias("e")).union(state.select(F.col("b").alias("c"), key.alias("e")))
        least = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        picked = chosen.append(least.select("u", "v", "w"))
        ends_of = state.join(picked.select("u", "v"), ["u", "v"], "left_semi").select("a", "b")
        root = materialize(connected_components(ends_of, one_task=HOOKS_IN_ONE_TASK), "roots")
        named = (
            state.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "w", "u", "v")
        )
        if contract:
            named = named.groupBy("a", "b").agg(F.min(key).alias("e")).select("a", "b", "e.*")
        after = materialize(named, "mst")
        release(state)
        release(root)
        state = after
    return chosen, state


def _kruskal(rows: list[tuple]) -> list[tuple]:
    sets, out = UnionFind(), []
    for w, u, v in sorted(rows):
        if sets.union(u, v):
            out.append((u, v, w))
    return out


def _kruskal_heap(rows: list[tuple]) -> list[tuple]:
    heap, sets, out = list(rows), UnionFind({x for _, u, v in rows for x in (u, v)}), []
    heapq.heapify(heap)
    while heap and sets.n_components > 1:
        w, u, v = heapq.heappop(heap)
        if sets.union(u, v):
            out.append((u, v, w))
    return out


def _prim(rows: list[tuple]) -> list[tuple]:
    arcs: dict = {}
    for w, u, v in rows:
        arcs.setdefault(u, []).append((w, u, v, v))
        arcs.setdefault(v, []).append((w, u, v, u))
    seen, out = set(), []
    for start in sorted(arcs):
        if start in seen:
            continue
        seen.add(start)
        heap = list(arcs[start])
        heapq.heapify(heap)
        while heap:
            w, u, v, to = heapq.heappop(heap)
            if to not in seen:
                seen.add(to)
                out.append((u, v, w))
                for arc in arcs[to]:
                    if arc[3] not in seen:
                        heapq.heappush(heap, arc)
    return out


class FibonacciHeap:
    """Keys with handles: trees of heaps that are only put in order when the least one leaves.

    Items are whole numbers from 0; arrays of links have a place for each up to the largest.
    """

    def __init__(self, size: int = 0) -> None:
        self.roots: list[int] = []
        self.keys: list = []
        # the parent is _ROOT for roots and _OUT for items that the heap does not hold
        self.parent, self.child, self.left, self.right = (array("i") for _ in range(4))
        self.rank, self.marked = bytearray(), bytearray()
        self.n = 0
        self._grow(size)

    def _grow(self, size: int) -> None:
        more = size - len(self.keys)
        if more > 0:
            self.keys.extend([None] * more)
            for links in (self.parent, self.child, self.left, self.right):
                links.extend(array("i", [_OUT]) * more)
            self.rank.extend(bytes(more))
            self.marked.extend(bytes(more))

    def push(self, item: int, key) -> None:
        """Insert the item, or lower its key if the new one is smaller."""
        if item >= len(self.keys):
            self._grow(max(item + 1, 2 * len(self.keys)))
        up = self.parent[item]
        if up == _OUT:
            self.keys[item], self.parent[item], self.child[item] = key, _ROOT, _OUT
            self.rank[item] = self.marked[item] = 0
            self.roots.append(item)
            self.n += 1
        elif key < self.keys[item]:
            self.keys[item] = key
            if up >= 0 and key < self.keys[up]:
                self._cut(item)

    def _cut(self, item: int) -> None:
        """Move a node to the roots, and with it every ancestor that has lost a child before."""
        while True:
            up, left, right = self.parent[item], self.left[item], self.right[item]
            if left >= 0:
                self.right[left] = right
            else:
                self.child[up] = right
            if right >= 0:
                self.left[right] = left
            self.rank[up] -= 1
            self.parent[item], self.marked[item] = _ROOT, 0
            self.roots.append(item)
            if self.parent[up] == _ROOT:
                return
            if not self.marked[up]:
                self.marked[up] = 1
                return
            item = up

    def pop(self):
        """``(key, item)`` of the least key; its children become roots, and roots of a rank unite."""
        keys, parent, child, left, right, ranks = self.keys, self.parent, self.child, self.left, self.right, self.rank
        least = min(self.roots, key=keys.__getitem__)
        roots = self.roots
        roots.remove(least)
        c = child[least]
        while c >= 0:
            parent[c], self.marked[c] = _ROOT, 0
            roots.append(c)
            c = right[c]
        by_rank: dict[int, int] = {}
        for root in roots:
            rank = ranks[root]
            while rank in by_rank:
                other = by_rank.pop(rank)
                if keys[other] < keys[root]:
                    root, other = other, root
                c = child[root]
                parent[other], left[other], right[other], child[root] = root, _OUT, c, other
                if c >= 0:
                    left[c] = other
                rank += 1
                ranks[root] = rank
            by_rank[rank] = root
        self.roots = list(by_rank.values())
        key, keys[least], parent[least] = keys[least], None, _OUT
        self.n -= 1
        return key, least

    def __bool__(self) -> bool:
        return self.n > 0


def _prim_fibonacci(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The forest's ranks, of edges between dense ids ``a`` and ``b`` in the order of their ranks.

    Arcs lie in arrays by the node they leave, 8 bytes each.
    """
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    ends = np.concatenate((a, b))
    first = memoryview(np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=n)))))
    order = np.argsort(ends, kind="stable").astype(np.int32)
    del ends
    to = memoryview(np.concatenate((b, a))[order])
    order[order >= len(a)] -= len(a)
    rank = memoryview(order)
    # the least rank that leads to a node from the tree, -1 inside it
    best, heap, out = array("i", [len(a)]) * n, FibonacciHeap(n), []
    for start in range(n):
        if best[start] < 0:
            continue
        heap.push(start, -1)
        while heap:
            k, at = heap.pop()
            best[at] = -1
            if k >= 0:
                out.append(k)
            low, high = first[at], first[at + 1]
            for k, other in zip(rank[low:high].tolist(), to[low:high].tolist(), strict=True):
                if k < best[other]:
                    best[other] = k
                    heap.push(other, k)
    return out


def _on_ranks(kernel: Callable[[list[tuple]], list[tuple]]) -> Callable[[np.ndarray, np.ndarray], list[int]]:
    """The kernel on tuples as one on the ends of edges in the order of their ranks."""
    return lambda a, b: [k for _, _, k in kernel(list(zip(range(len(a)), a.tolist(), b.tolist(), strict=True)))]


_KERNELS = {"kruskal": _on_ranks(_kruskal), "heap": _on_ranks(_kruskal_heap), "prim": _on_ranks(_prim), "prim_fibonacci": _prim_fibonacci}
STRATEGIES = ("boruvka", "contract", "strata", *_KERNELS)


def _forest_of(table: pa.Table, strategy: str) -> pa.Table:
    """The forest of rows ``(a, b, w, u, v)`` between ``a`` and ``b``, by a kernel on ranks and dense ids."""
    order = np.lexsort([table[c].to_numpy() for c in ("v", "u", "w")])
    nodes = np.unique(np.concatenate([table[c].to_numpy() for c in ("a", "b")]))
    a, b = (np.searchsorted(nodes, table[c].to_numpy()).astype(np.int32)[order] for c in ("a", "b"))
    del nodes
    return table.take(pa.array(order[np.array(_KERNELS[strategy](a, b), np.int64)]))


def _kernel_parts(edges: DataFrame, strategy: str, parts: int) -> DataFrame:
    """The forests of so many parts of ``(a, b, w, u, v)``; an edge outside its part's is in no forest of all."""

    columns = edges.columns

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _forest_of(pa.Table.from_batches(held), strategy).select(columns).combine_chunks().to_batches(OUT_ROWS)

    if parts == 1:
        return edges.coalesce(1).mapInArrow(tidy(run), edges.schema)
    # all edges of few nodes leave a small forest; the side with more nodes has fewer edges at each
    ends = edges.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
    keys = ("a", "b") if ends["a"] >= ends["b"] else ("b", "a")
    return edges.repartitionByRange(parts, *keys).mapInArrow(tidy(run), edges.schema)


def _one_task(edges: DataFrame, strategy: str, most: int | None = None) -> DataFrame:
    """The forest by a kernel that holds at most ``most`` edges.

    Of more edges the kernel first leaves the forests of parts, in rounds while they shrink.  What is
    still too much has its components hooked until the rest fits.
    """
    most = most or min(KERNEL_EDGES, FOREST_EDGES)
    rows = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v")
    chosen, size = None, edges.count()
    while size > most:
        fewer = materialize(_kernel_parts(rows, strategy, -(-size // min(most, PART_EDGES))), "forests")
        release(rows)
        before, rows, size = size, fewer, fewer.count()
        if size > most and 2 * size > before:
            chosen, rest = _hooked(rows.select("u", "v", "w"), True, most)
            release(rows)
            rows, size = rest, rest.count()
    if not size:
        return chosen.all() if chosen else edges.select("u", "v", "w")
    last = _kernel_parts(rows, strategy, 1).select(*edges.columns)
    return chosen.all().union(last) if chosen else last


def strata(edges: DataFrame, least: int = 200) -> tuple[DataFrame, int]:
    """``edges`` with a ``stratum`` of their weight, and the number of strata.

    ``m`` edges make about ``sqrt(m / ln(m + 1))`` strata of equal size; few edges make one.
    """
    import math

    m = edges.count()
    k = 1 if m < least else max(1, int(math.sqrt(m / math.log(m + 1))))
    if k == 1:
        return edges.withColumn("stratum", F.lit(0)), 1
    cuts = sorted(set(edges.stat.approxQuantile("w", [i / k for i in range(1, k)], 0.25 / k)))
    return _numbered(edges, cuts), len(cuts) + 1


def _numbered(edges: DataFrame, cuts: list[float]) -> DataFrame:
    """``edges`` with the number of cuts below their weight as ``stratum``, found by a binary search."""
    from pyspark.ml.feature import Bucketizer

    # buckets hold their lower end, strata their upper one
    splits = [float("-inf"), *[-c for c in reversed(cuts)], float("inf")]
    turned = edges.withColumn("__turned", -F.col("w").cast("double"))
    found = Bucketizer(splits=splits, inputCol="__turned", outputCol="__bucket", handleInvalid="keep").transform(turned)
    number = F.when(F.isnan("__turned"), len(cuts)).when(F.col("w").isNotNull(), len(cuts) - F.col("__bucket").cast("int"))
    return found.withColumn("stratum", number).drop("__turned", "__bucket")


def _by_strata(edges: DataFrame, batch: int = 8) -> DataFrame:
    """Forests of the lightest strata first; heavier edges inside a component never come in.

    Each round takes twice the strata of the one before.
    """
    cut, n = strata(edges)
    cut = materialize(cut, "strata")
    forest, total = None, cut.select("u").union(cut.select("v")).distinct().count()
    low = 0
    while low < n:
        part = cut.filter((F.col("stratum") >= low) & (F.col("stratum") < low + batch)).select("u", "v", "w")
        if forest is not None:
            root = materialize(connected_components(forest.select(F.col("u").alias("a"), F.col("v").alias("b")), one_task=HOOKS_IN_ONE_TASK), "roots")
            part = (
                part.join(root.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left")
                .join(root.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
                .filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "w")
            )
            part = part.union(forest)
        low, batch = low + batch, 2 * batch
        forest = materialize(_boruvka(part, True), "forest")
        if forest.count() == total - 1:
            break
    return forest if forest is not None else edges.select("u", "v", "w")


def spanning_forest(edges: DataFrame, strategy: str = "contract") -> DataFrame:
    """Edges ``(u, v, w)`` of the minimum spanning forest of an undirected graph.

    Parallel edges count with their least weight, loops not at all, and negative weights are fine.
    """
    clean = materialize(normalise(edges), "undirected")
    if strategy in _KERNELS:
        return _one_task(clean, strategy)
    if strategy == "strata":
        return _by_strata(clean)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    return _boruvka(clean, strategy == "contract")


def summary(forest: DataFrame, n_nodes: int) -> DataFrame:
    """``(edges, total, n_components, spanning)`` of a forest over ``n_nodes`` nodes."""
    n = F.count("*")
    return forest.agg(n.alias("edges"), F.coalesce(F.sum("w"), F.lit(0)).alias("total"), (F.lit(n_nodes) - n).alias("n_components"),
                      (F.lit(n_nodes) - n <= 1).alias("spanning"))


def strata_profile(edges: DataFrame, forest: DataFrame, cuts: list[float] | None = None, k: int = 16) -> DataFrame:
    """Per weight stratum: weights, edges, tree edges and their share in per cent.

    Strata end at the given weights, or at approximate quantiles that make ``k`` of them.
    """
    if cuts is None:
        cuts = sorted(set(edges.stat.approxQuantile("w", [i / k for i in range(1, k)], 0.25 / k)))
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("w") > F.lit(c)).cast("int")
    marked = edges.withColumn("stratum", number).join(forest.select("u", "v", F.lit(1).alias("tree")), ["u", "v"], "left")
    return marked.groupBy("stratum").agg(
        F.min("w").alias("least"), F.max("w").alias("most"), F.count("*").alias("edges"), F.count("tree").alias("tree_edges"),
        F.round(F.count("tree") * 100.0 / F.count("*"), 4).alias("share"),
    )
