"""Connected components of an undirected edge list by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.plans.tables import materialize, release


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star contraction of edges with a < b.

    The minima are tables of their own: a node with very many edges then joins its one row by a
    join between two plain scans, whose skewed side Spark splits.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc")
    # every larger neighbour of a node hooks to the smallest node that it sees
    large = materialize(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "cc")
    first = materialize(large.groupBy("b").agg(F.min("a").alias("m")), "cc")
    # a node and its smaller neighbours hook to the smallest of them
    hooked = large.join(first, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
    out = materialize(hooked.union(first.select(F.col("m").alias("a"), "b")).distinct(), "cc")
    for done in (least, large, first):
        release(done)
    return out


def _in_one_task(batches):
    """Smallest labels over all rows at once, by hooking and pointer jumping."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[label]})


def connected_components(edges: DataFrame, max_rounds: int = 64, one_task: int = 0) -> DataFrame:
    """Label every node that occurs in ``edges(a, b)`` with the smallest node of its component.

    Returns ``(node, root)``.  Rows with a null end and self loops are ignored, repeated and
    reversed edges count once, and an empty edge list gives an empty result.  The work per round
    is two pre-aggregated minima and two joins; the number of rounds is logarithmic.  At most
    ``one_task`` edges are labelled in a single task instead, which has no rounds.
    """
    state = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "cc",
    )
    if one_task and state.count() <= one_task:
        return state.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    last = None
    for _ in range(max_rounds):
        step = _round(state)
        mark = step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        release(state)
        state = step
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
