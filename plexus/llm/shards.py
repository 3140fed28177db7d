"""Byte-balanced sharding by histogram sort, in DataFrame operations alone.

Rows are ordered by a 120-bit key: 60 bits hashed from the text, so that equal texts lie together,
then 60 bits of the second half: 44 hashed from the id and all carried columns, and 16 that part
rows equal in all of these.  Rows that are not such repeats thus have an order of their own, whatever
the partitions they come in; repeats are interchangeable.  Each round counts the exact bytes below equally spaced candidate
boundaries inside the interval that holds each splitter, then narrows the intervals, until a
boundary lies within the tolerance of its target or the interval holds a single key.  A boundary
between two groups of equal texts that meets the tolerance is taken before the probes go inside a
group, so that a group is parted only if it is too large to stay whole.  After that the rows move
once, to fine buckets of their shard, in which they are numbered; the buckets' counts, added up in
order, make the numbers gapless over the shard.

A boundary misses its target by at most half the tolerance, or by half of the largest row where rows
are larger than that, so a shard's ``bytes`` differ from an equal share by at most the tolerance (1 %
of a share) or by that row.  A null text has no bytes and hashes like a value of its own; texts of
any length are only hashed and measured; null ids are allowed.  The carried columns travel as one,
so their names clash with nothing made here; ``place`` replaces columns called ``shard`` and
``slot``.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.plans.tables import materialize, maybe_broadcast

SHARDS = 8
TOLERANCE = 0.01
#: Bits that a round of probes resolves: 4,095 probes for each splitter.
STEP = 12
KEY_BITS, REPEAT_BITS = 60, 16
#: Rows that one numbering bucket should hold.
BUCKET_ROWS = 8192


def _named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(row, size, crc, k1, k2)``: the carried columns (all, if not told) as one, and both halves of the sort key."""
    text, carry = _named(text_col).cast("string"), carry if carry is not None else docs.columns
    bits = lambda n, *c: F.shiftrightunsigned(F.xxhash64(*c), 64 - n)
    own = bits(KEY_BITS - REPEAT_BITS, _named(id_col), *[_named(c) for c in carry if c not in (id_col, text_col) and _hashable(docs, c)], F.lit(2))
    return docs.select(
        F.struct(*[_named(c) for c in carry]).alias("row"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), bits(KEY_BITS, text, F.lit(1)).alias("k1"),
        (F.shiftleft(own, REPEAT_BITS) + bits(REPEAT_BITS, F.monotonically_increasing_id())).alias("k2"),
    )


def _hashable(docs: DataFrame, column: str) -> bool:
    return "map<" not in docs.select(_named(column)).schema[0].dataType.simpleString()


def _probe(rows: DataFrame, spans: list[tuple]) -> dict[tuple, list[tuple[int, int]]]:
    """Exact bytes in each probed cell of the spans ``(first, low, bits)``, cells ascending.

    A span without ``first`` lies on the first key half, one with it on the second half of that
    first half.  There are at most as many spans as splitters and ``2**STEP`` cells in each.
    """
    tests = []
    for g, (first, low, bits) in enumerate(spans):
        key = F.col("k1" if first is None else "k2")
        inside = (key >= F.lit(low)) & (key < F.lit(low + (1 << bits)))
        if first is not None:
            inside = inside & (F.col("k1") == F.lit(first))
        cell = F.shiftright(key - F.lit(low), max(0, bits - STEP))
        tests.append(F.when(inside, F.struct(F.lit(g).alias("g"), cell.alias("cell"))))
    counted = (
        rows.select("size", F.coalesce(*tests).alias("at")).filter("at is not null")
        .groupBy("at.g", "at.cell").agg(F.sum("size").alias("bytes")).collect()
    )
    out: dict[tuple, list] = {span: [] for span in spans}
    for r in counted:
        out[spans[r["g"]]].append((r["cell"], r["bytes"]))
    return {span: sorted(cells) for span, cells in out.items()}


class _Splitter:
    """Search state of one splitter: the open interval of keys and the best boundary so far."""

    def __init__(self, target: float) -> None:
        self.target, self.below = target, 0
        self.span = (None, 0, KEY_BITS)
        self.gap, self.point = target, (0, 0)

    def offer(self, count: int, edge: int) -> None:
        if abs(count - self.target) < self.gap:
            first = self.span[0]
            self.gap, self.point = abs(count - self.target), (edge, 0) if first is None else (first, edge)

    def narrow(self, cells: list[tuple[int, int]], slack: float) -> bool:
        """Take a round's counts; True if the splitter needs another round."""
        first, low, bits = self.span
        shift, at = max(0, bits - STEP), self.below
        for cell, n in cells:
            if at + n > self.target:
                break
            at += n
        else:
            return False
        start = low + (cell << shift)
        self.offer(at, start)
        self.offer(at + n, start + (1 << shift))
        self.below = at
        if shift:
            self.span = (first, start, shift)
        elif first is None:
            self.span = (start, 0, KEY_BITS)
        return self.gap > slack and (shift > 0 or first is None)


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Ascending boundaries ``(k1, k2)``; a row lies below one if its key is smaller."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    every = [_Splitter(total * j / shards) for j in range(1, shards)]
    open_ = every if total else []
    while open_:
        counts = _probe(rows, sorted({s.span for s in open_}, key=str))
        open_ = [s for s in open_ if s.narrow(counts[s.span], tolerance * total / shards / 2)]
    return [s.point for s in every]


def _below(point: tuple[int, int]) -> Column:
    a, b = point
    return (F.col("k1") < F.lit(a)) | ((F.col("k1") == F.lit(a)) & (F.col("k2") < F.lit(b)))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
          shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The carried columns as ``row``, with ``size``, ``crc``, ``shard`` (from 0) and ``slot``.

    Slots are gapless from 0 in each shard, bucket by bucket in key order; a bucket that a large
    group makes hot is split on the second key half before it is numbered.
    """
    rows = materialize(keyed(docs, id_col, text_col, carry), "keyed")
    number = reduce(lambda a, p: a + F.when(_below(p), 0).otherwise(1), splitters(rows, shards, tolerance), F.lit(0))
    bits = (max(1, rows.count() // BUCKET_ROWS)).bit_length()
    placed = rows.withColumn("shard", number).withColumn("b1", F.shiftright("k1", KEY_BITS - bits))
    depth = F.ceil(F.log2(F.count("*") / BUCKET_ROWS)).cast("int")
    hot = materialize(placed.groupBy("shard", "b1").agg(depth.alias("deep")).filter("deep > 0"), "hot")
    fine = ["shard", "b1", "b2"]
    split = placed.join(maybe_broadcast(hot, hot.count(), 32), fine[:2], "left").withColumn(
        "b2", F.coalesce(F.expr(f"shiftright(k2, {KEY_BITS} - deep)"), F.lit(0).cast("long"))
    ).drop("deep")
    counts = split.groupBy(*fine).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("b1", "b2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy(*fine).orderBy("k1", "k2")) - 1
    return (
        split.join(starts, fine).withColumn("slot", (F.col("start") + inner).cast("long"))
        .drop("b1", "b2", "start", "k1", "k2")
    )


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every document.

    The text is only hashed and measured; no copy of it is stored or moved.
    """
    return shard(docs, id_col, text_col, [id_col], shards).select(
        F.col("row")[id_col].alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; columns of those names that it has are replaced."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return shard(docs, id_col, text_col, kept, shards).select("row.*", "shard", "slot")
