"""SimHash near-duplicate classes through sharded BK-trees.

``classes`` takes three-word shingles, 64 bits, and links at three or fewer differing bits.  Any two
such fingerprints agree on at least ``blocks - 3`` of ``blocks`` bit blocks, so every pair that has
to link meets in a shard keyed by some choice of agreeing blocks, and no link is lost.

``similar_classes`` is for near copies at a similarity: classes of the pairs whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more.  Fingerprints of 256 bits, in shards keyed by
random choices of bits, give the nearest pairs (four standard deviations below the expected number
of differing bits), which are links.  An exact join of the sets then finds every other pair.  Two
sets at the similarity share one of the first ``n - ceil(0.8 n) + 1`` of their ``n`` shingles in any
fixed order, so all texts that hold a shingle so early form a shard.  Each shard checks its members
against one of them, which joins most large groups; where more than one class is left, all pairs
of different classes are checked, but for those that their sizes and the places of the shingle in
either order exclude.  The order puts shingles frequent in a sample last; the sample decides the
work, never the result.  A shingle that is frequent within a task gets a member of its own there,
which alone goes on to the shingle's shard, so that no task gathers all members of a hot shingle.

A shard's fingerprints form a BK-tree (children keyed by the integer Hamming distance to
their parent) and its members search it, following only the edges within the radius.  A shard's
tree travels to the task that queries it by an exchange, since the trees together grow with the
corpus and so have no bound for a broadcast.

Null handling: a null or blank text has no words and gets fingerprint zero, linked like any other.
A null ``doc_id`` is ignored when the smallest id of a class is chosen; a class of null ids alone
has a null ``component_id``.  Repeated rows are returned as often as they come.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType

from plexus.operators.components import connected_components
from plexus.plans.tables import drop_shuffles, materialize, maybe_broadcast, release
from plexus.plans.workers import give_back, tidy

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Near copies: words of a shingle, least Jaccard similarity, 64-bit lanes of a fingerprint, the
#: chance with which a pair at that similarity meets in a shard of fingerprints, and the standard
#: deviations of the last radius above the expected number of differing bits.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_LANES, MEET, SLACK = 5, 0.8, 4, 0.98, 2.5
#: Bands of differing bits up to the last radius.
BANDS = 6
#: Documents sampled to order shingles by frequency, and shingles of the sample that are ranked.
SAMPLE, RANKED = 20_000, 1 << 18
#: Least parities in the sketch of a set; larger sets have the next power of two of their size.
ODD = 1024
#: Shingles of prefixes that a bucket of the exact join holds on average, and that a task gathers
#: before it sends them out.
BUCKET, FLUSH = 1 << 19, 1 << 20
#: Members of a shingle in one such gathering, above which only one of them goes to the shard.
LOCAL = 16
#: Steps of a set's size on a logarithmic scale, and of a shingle's place in its set.
SIZE_STEPS, PLACE_STEPS = 1500, 1 << 12
#: Links up to which components are labelled in one task.
FEW_LINKS = 1 << 18
#: Members up to which a shard of the exact join lists its pairs; larger ones are checked as units.
LISTED = 32
#: Members that one search unit takes from a shard; larger shards split into pairs of groups.
UNIT = 4096
#: Pairs of members, or words of their sketches, that a task compares at once.
PARTNERS = 1 << 20
#: Frontier entries (query, tree node) that a search step holds at once.
FRONTIER = 1 << 20


_LANES = [k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(1, 8)]


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Each hash followed by mixes of it, as rows of ``lanes`` words; the first is the hash itself."""
    out = np.empty((len(hashes), lanes), "<u8")
    out[:, 0] = hashes
    for k in range(1, lanes):
        x = hashes + np.uint64(_LANES[k - 1])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text in order, repeats included; none for a text without words."""
    words = (text or "").encode().lower().split()
    hash64, n = xxhash.xxh64_intdigest, len(words)
    line = b" ".join(words)
    if n <= width:
        return np.array([hash64(line, SEED)] if n else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([hash64(line[s:e], SEED) for s, e in spans], "<u8")


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    """The bits set in over half of the hashes, 64 to a lane, little-endian; zero without hashes."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(_lanes(hashes[at : at + 4096], lanes).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprint_bytes(text: str | None, width: int = SHINGLE, lanes: int = 1) -> bytes:
    """The majority fingerprint of a text's word shingles, repeats included."""
    return _majority(_shingles(text, width), lanes)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    return int.from_bytes(fingerprint_bytes(text, width), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    out = b"".join(fingerprint_bytes(t.as_py()) for t in texts)
    return pa.array(np.frombuffer(out, "<i8"))


def fingerprint_column(text: Column) -> Column:
    """Signed 64-bit SimHash of a text column."""
    return arrow_udf(_fingerprints, LongType())(text.cast("string"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between the rows of two arrays of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over the rows of several units, built level by level for all trees at once."""

    def __init__(self, prints: np.ndarray, tree: np.ndarray) -> None:
        self.prints, self.far = prints, 64 * prints.shape[1]
        span = self.far + 1
        order = np.arange(len(prints))
        trees, first = np.unique(tree, return_index=True)
        self.root = dict(zip(trees.tolist(), first.tolist(), strict=True))
        at = first[np.searchsorted(trees, tree)]
        waiting = order[at != order]
        parents, edges, nodes = [], [], []
        while len(waiting):
            key = at[waiting] * span + _apart(prints[waiting], prints[at[waiting]])
            _, lead, member = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[lead]
            parents.append(key[lead] // span)
            edges.append(key[lead] % span)
            nodes.append(child)
            at[waiting] = child[member]
            waiting = waiting[at[waiting] != waiting]
        join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        key, self.node = join(parents) * span + join(edges), join(nodes)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], self.node[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yield (position in queries, node) arrays of all nodes within the radius."""
        who, at, span = np.arange(len(queries)), roots, self.far + 1
        while len(who):
            far = _apart(queries[who], self.prints[at])
            hit = far <= radius
            if hit.any():
                yield who[hit], at[hit]
            low = np.searchsorted(self.key, at * span + np.maximum(far - radius, 0))
            high = np.searchsorted(self.key, at * span + np.minimum(far + radius, self.far), "right")
            n = high - low
            who = np.repeat(who, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = self.node[np.repeat(low, n) + step]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union the label classes of the linked rows; return the links that joined two classes."""
    used_a, used_b = [], []
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        _, pick = np.unique(high, return_index=True)
        used_a.append(a[pick])
        used_b.append(b[pick])
        label[high[pick]] = low[pick]
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    empty = np.empty(0, np.int64)
    return (np.concatenate(used_a), np.concatenate(used_b)) if used_a else (empty, empty)


def _unit_links(unit: np.ndarray, side: np.ndarray, prints: np.ndarray, radii: list[int]):
    """A spanning forest of the links inside each unit, as pairs of row numbers.

    Pairs are taken by rising radius, so that a far pair joins only what nearer ones leave apart.
    Rows of side 0 form the tree.  In a unit of one group they are the queries as well, but for
    those within the least radius of the root: whatever links to one of them asks itself.  In a
    unit of two groups side 1 queries the tree of side 0.
    """
    two = np.unique(unit[side == 1])
    base = np.flatnonzero(side == 0)
    forest = Forest(prints[base], unit[base])
    label, found = np.arange(len(unit)), []
    names, first, size = np.unique(unit[base], return_index=True, return_counts=True)
    asks = np.flatnonzero((side == 1) | ~np.isin(unit, two))
    asks = asks[np.isin(unit[asks], names)]
    roots = first[np.searchsorted(names, unit[asks])]
    near = (side[asks] == 0) & (_apart(prints[asks], prints[base[roots]]) <= radii[0])
    found.append(_hook(label, asks[near], base[roots[near]]))
    asks, roots = asks[~near], roots[~near]
    load = np.cumsum(size[np.searchsorted(names, unit[asks])])
    cut = np.searchsorted(load, np.arange(FRONTIER, (load[-1] if len(load) else 0) + FRONTIER, FRONTIER))
    start = 0
    for stop in np.unique(np.concatenate((cut, [len(asks)]))).tolist():
        some, late = asks[start:stop], []
        for who, node in forest.search(prints[some], roots[start:stop], radii[-1]):
            a, b = some[who], base[node]
            far = _apart(prints[a], prints[b])
            now = far <= radii[0]
            found.append(_hook(label, a[now], b[now]))
            if not now.all():
                late.append(np.stack((a[~now], b[~now], far[~now])))
        if late:
            a, b, far = np.concatenate(late, axis=1)
            for radius in radii[1:]:
                now = far <= radius
                found.append(_hook(label, a[now], b[now]))
                a, b, far = a[~now], b[~now], far[~now]
        start = stop
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _whole_units(emit, rows_at_once: int):
    """Apply ``emit`` to sorted rows with a ``unit``, whole units at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows_at_once:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table["unit"].to_numpy()
            cut = int(np.flatnonzero(unit == unit[-1])[0])
            if cut:
                yield emit(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                n = table.num_rows - cut
        if n:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _link_partition(radii: list[int], rows_at_once: int = 1 << 17):
    """Link sorted rows (unit, side, node, fp), whole units at a time."""

    def emit(table: pa.Table):
        unit, node = table["unit"].to_numpy(), table["node"].to_numpy()
        prints = np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(table.num_rows, -1)
        a, b = _unit_links(np.unique(unit, return_inverse=True)[1], table["side"].to_numpy(), prints, radii)
        return pa.RecordBatch.from_pydict({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return _whole_units(emit, rows_at_once)


def _layout(distinct: int) -> tuple[int, int]:
    """Bit blocks and how many of them key a shard, so that an average shard stays small."""
    for blocks in (4, 5, 6, 7):
        keyed = blocks - RADIUS
        if distinct <= 256 << (64 * keyed // blocks):
            return blocks, keyed
    return 8, 8 - RADIUS


def links(prints: DataFrame, distinct: int) -> DataFrame:
    """Links ``(a, b)`` that connect the same classes as all links between distinct ``fp`` rows."""
    blocks, keyed = _layout(distinct)
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for pick in combinations(range(blocks), keyed):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in pick)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    members = prints.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.explode(keys).alias("shard"))
    return _shard_links(members, [RADIUS])


def _shard_links(members: DataFrame, radii: list[int]) -> DataFrame:
    """Pairs ``(a, b)`` of ``members(shard, node, fp)`` within their shards and the last radius.

    Within a shard only a spanning forest of its links is returned.  A shard with more than
    ``UNIT`` members is split into groups and every pair of groups is its own unit, so that the
    work of a hot shard spreads over tasks and no link is lost.
    """
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    units = _units(members.join(sizes, "shard"), F.ceil(F.col("n") / UNIT), "fp")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(tidy(_link_partition(radii)), "a long, b long")


def _units(members: DataFrame, groups: Column, *more: str) -> DataFrame:
    """``(unit, side, node, *more)``: a shard's members in so many groups, each pair of groups a unit."""
    return (
        members.withColumn("g", groups.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .select("shard", "node", *more, "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
        .select(
            F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "node", *more,
        )
    )


def _similar_layout(distinct: int, similarity: float, bits: int) -> tuple[list[int], int, int]:
    """Radii, bits of a shard key and number of keys for a Jaccard similarity.

    A pair at the similarity has a cosine of ``2 s / (1 + s)``; a bit differs with the angle's share
    of a half turn.  Keys are wide enough for small shards of unrelated texts and as many as give
    such a pair a chance of ``MEET`` to agree on one.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = math.sqrt(bits * chance * (1 - chance))
    low, high = math.floor(bits * chance - 4 * spread), math.ceil(bits * chance + SLACK * spread)
    radii = [low + math.ceil((high - low) * k / BANDS) for k in range(BANDS + 1)]
    width = max(16, math.ceil(math.log2(max(1, distinct) / 4)))
    return radii, width, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - chance) ** width))


def similar_pairs(prints: DataFrame, distinct: int, similarity: float, bits: int) -> DataFrame:
    """Links ``(a, b)`` within the first radius between ``prints(node, fp)`` with binary ``fp`` of ``bits`` bits."""
    radii, width, _ = _similar_layout(distinct, similarity, bits)
    # enough keys for pairs within the first radius; the exact join finds what they miss
    keys = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - radii[0] / bits) ** width))

    def spread(batches):
        rng = np.random.default_rng(SEED)
        picks = [rng.choice(bits, width, replace=False) for _ in range(keys)]
        powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            node, fp = b["node"], b["fp"]
            on = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little").astype(np.uint64)
            for k, pick in enumerate(picks):
                key = (on[:, pick] * powers).sum(axis=1, dtype=np.uint64) * np.uint64(keys) + np.uint64(k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node, fp], ["shard", "node", "fp"])

    return _shard_links(prints.select("node", "fp").mapInArrow(tidy(spread), "shard long, node long, fp binary"), radii[:1])


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``: the sorted distinct shingle hashes."""

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(_shingles(t.as_py(), width)).tobytes() for t in texts], pa.binary())

    return texts.select("node", arrow_udf(cut, BinaryType())(F.col("text")).alias("shingles"))


def _checked(similarity: float):
    """Keep the rows ``(a, b, x, y)`` whose shingle sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                low, high = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if low >= similarity * high else 0
                keep.append(both >= similarity * (low + high - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _unit_matches(table: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links of rows (unit, side, node, root, shingles) of different roots, found by counting shared shingles.

    A pair whose ends the links found before have joined is left out.
    """
    unit, side, node = (table[c].to_numpy() for c in ("unit", "side", "node"))
    sets = [np.frombuffer(v.as_buffer(), "<u8") for c in table["shingles"].chunks for v in c]
    label = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    out = []
    cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = np.arange(start, stop)
        base, asks = rows[side[rows] == 0], rows[side[rows] == 1]
        if not len(base):
            continue
        size = np.array([len(sets[i]) for i in base])
        first = np.cumsum(size) - size
        words, at = np.unique(np.concatenate([sets[i] for i in base]), return_inverse=True)
        held = np.zeros(len(words) + 1, np.int32)
        _, name = np.unique(label[rows], return_inverse=True)
        for i in (asks if len(asks) else base).tolist():
            n = len(sets[i])
            low, high = np.minimum(size, n), np.maximum(size, n)
            open_ = (name[base - start] != name[i - start]) & (low >= similarity * high)
            if not open_.any():
                continue
            place = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
            place = place[words[place] == sets[i]]
            held[place] = 1
            both = np.add.reduceat(held[at], first)
            held[place] = 0
            for j in base[open_ & (both >= similarity * (size + n - both))].tolist():
                x, y = name[i - start], name[j - start]
                if x != y:
                    name[name == y] = x
                    out.append((node[i], node[j]))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch's bits, or those of several in rows, folded to so many words."""
    return np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, words), axis=-2)


def _short(sketch: Column) -> Column:
    """The sketch folded to a bit for each shingle at least, the size left in front."""

    def cut(sketches: pa.Array) -> pa.Array:
        out = []
        for v in sketches:
            x = np.frombuffer(v.as_buffer(), "<u8")
            words = min(len(x) - 1, max(1, (1 << (max(1, int(x[0])) - 1).bit_length()) // 64))
            out.append(x[:1].tobytes() + _fold(x[1:], words).tobytes())
        return pa.array(out, pa.binary())

    return arrow_udf(cut, BinaryType())(sketch)


def _pairs_of(unit: np.ndarray):
    """Yield (earlier, later) row numbers of all pairs within the units of sorted rows, bounded numbers at once."""
    lead = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    long = np.diff(np.append(lead, len(unit)))
    after = np.repeat(lead + long, long) - np.arange(len(unit)) - 1
    load, start = np.cumsum(after), 0
    while start < len(unit):
        stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + PARTNERS, "right")))
        n = after[start:stop]
        p = np.repeat(np.arange(start, stop), n)
        yield p, p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def _fit(size: np.ndarray, place: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """As ``_fitting``, of rows ``p`` and ``q``."""
    ratio = np.exp((size[q] - size[p]) / SIZE_STEPS)
    least = (1 + ratio) * (similarity / (1 + similarity) * 0.998)
    near = np.abs(size[q] - size[p]) <= _size_window(similarity)
    return near & (1 - place[p] / PLACE_STEPS >= least) & (ratio * (1 - place[q] / PLACE_STEPS) >= least)


def _unit_partners(table: pa.Table, similarity: float) -> pa.RecordBatch:
    """The rows (unit, side, node, root, size, place, n) that have a partner of another root in their
    unit which sizes, places of the shared shingle and sketches allow."""
    unit, side, node, root, size, place = (table[c].to_numpy() for c in ("unit", "side", "node", "root", "size", "place"))
    sketches = [np.frombuffer(v.as_buffer(), "<u8") for c in table["sketch"].chunks for v in c]
    exact, width = np.array([v[0] for v in sketches], np.float64), np.array([len(v) - 1 for v in sketches])
    flat, first = np.concatenate([v[1:] for v in sketches]), np.cumsum(width) - width
    share = (1 - similarity) / (1 + similarity)
    two, keep = np.isin(unit, unit[side == 1]), np.zeros(len(unit), bool)
    for p, q in _pairs_of(unit):
        met = (root[p] != root[q]) & ((side[p] != side[q]) | ~two[p])
        p, q = p[met], q[met]
        met = _fit(size, place, p, q, similarity)
        p, q = p[met], q[met]
        p, q = np.where(width[p] <= width[q], p, q), np.where(width[p] <= width[q], q, p)
        kind = np.stack((width[p], width[q]), axis=1)
        for low, high in np.unique(kind, axis=0).tolist():
            some = np.flatnonzero((kind == (low, high)).all(axis=1))
            for at in range(0, len(some), max(1, PARTNERS // high)):
                i, j = (x[some[at : at + max(1, PARTNERS // high)]] for x in (p, q))
                wide = _fold(flat[first[j][:, None] + np.arange(high)], low)
                gap = np.bitwise_count(flat[first[i][:, None] + np.arange(low)] ^ wide).sum(axis=1, dtype=np.int64)
                near = gap <= (exact[i] + exact[j]) * share + 1e-6
                keep[i[near]] = keep[j[near]] = True
    return pa.RecordBatch.from_pydict({c: table[c].to_numpy()[keep] for c in ("unit", "side", "node", "root", "size", "place", "n")})


def _ranks(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a bounded sample of the documents, ascending, and how often."""
    part = min(1 << 20, math.ceil((SAMPLE << 20) / max(1, docs.count())))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < part).select(F.col("text").cast("string").alias("text"))

    def each(batches):
        for b in batches:
            found = [np.unique(_shingles(t.as_py(), width)) for t in b["text"]]
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([np.empty(0, "<u8"), *found]).view("<i8"))})

    seen = sample.mapInArrow(tidy(each), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    top = seen.orderBy(F.desc("n"), "shingle").limit(RANKED).collect()
    names, counts = np.array([r[0] for r in top], "<i8").view("<u8"), np.array([r[1] for r in top], np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def _prefix(hashes: np.ndarray, names: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set of which any set at the similarity shares one as early, rarest first."""
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        often = np.where(names[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - math.ceil(similarity * n - 1e-9) + 1]]


_SHAPE = "struct<fp:binary,sketch:binary,early:binary>"


def _shapes(text: Column, shared, width: int, similarity: float, lanes: int) -> Column:
    """A text's shingle set as ``(fp, sketch, early)``: fingerprint, sketch and prefix.

    The sketch is the set's size and, for each bucket of hashes, whether it holds an odd number.
    Every shingle that only one of two sets has changes one such bit; a longer sketch folds to a
    shorter one.
    """

    def cut(texts: pa.Array) -> pa.Array:
        prints, sketches, early = [], [], []
        for t in texts:
            hashes = np.unique(_shingles(t.as_py(), width))
            bits = max(ODD, 1 << (max(1, len(hashes)) - 1).bit_length())
            odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            prints.append(_majority(hashes, lanes))
            sketches.append(np.int64(len(hashes)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            early.append(_prefix(hashes, *shared.value, similarity).tobytes())
        give_back()
        return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in (prints, sketches, early)], ["fp", "sketch", "early"])

    return arrow_udf(cut, _SHAPE)(text.cast("string"))


def _possible(similarity: float):
    """Keep the rows ``(a, b, x, y)`` whose sketches do not exclude the similarity."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = ([np.frombuffer(v.as_buffer(), "<u8") for v in batch[c]] for c in ("x", "y"))
            m, n = (np.array([v[0] for v in side]).astype(np.int64) for side in (x, y))
            fits = np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6
            for i in np.flatnonzero(fits).tolist():
                words = min(len(x[i]), len(y[i])) - 1
                gap = np.bitwise_count(_fold(x[i][1:], words) ^ _fold(y[i][1:], words)).sum(dtype=np.int64)
                fits[i] = gap <= (m[i] + n[i]) * share + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return run


#: A member of a shard: the low half of its shingle, its node, and codes of its set's size and of
#: the shingle's place; the place's top bit marks a member that stands for others.
_POST = np.dtype([("low", "<u4"), ("size", "<u2"), ("place", "<u2"), ("node", "<i8")])
_STANDS = 1 << 15


def _mixed(node: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """An order of nodes that differs from shingle to shingle."""
    x = (node.view(np.uint64) ^ shingle) * np.uint64(_LANES[0])
    return (x ^ (x >> np.uint64(31))) * np.uint64(_LANES[1])


def _size_window(similarity: float) -> int:
    """Steps by which the sizes of two sets at the similarity may differ, rounded codes included."""
    return math.ceil(SIZE_STEPS * math.log(1 / similarity)) + 2


def _early(shapes: DataFrame, similarity: float) -> DataFrame:
    """``(shard, node, hub, size, place)`` of ``(node, sketch, early)``: shingles that recur in prefixes.

    Members travel packed by bucket; a bucket keeps 32 bits of a shingle, and what collides is only
    checked in vain.  Where many members of a task share a shingle, they take one of them as their
    hub; that one goes to the shard, and the others travel dealt out evenly as they are.
    """
    every = shapes.agg(F.sum(F.octet_length("early") / 8)).first()[0] or 0
    buckets = max(8, math.ceil(every / BUCKET))

    def send(held: list[tuple]) -> pa.RecordBatch:
        shingle, node, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((_mixed(node, shingle), shingle))
        shingle, node, size, place = shingle[order], node[order], size[order], place[order]
        bucket = (shingle >> np.uint64(32)) % np.uint64(buckets)
        _, first, n = np.unique(shingle, return_index=True, return_counts=True)
        hub, lead = np.repeat(node[first], n), np.zeros(len(node), bool)
        lead[first] = True
        many = np.repeat(n > LOCAL, n)
        place[many & lead] |= _STANDS
        stay = many & ~lead
        apart = pa.RecordBatch.from_pydict({
            "shard": (bucket[stay] << np.uint64(32) | shingle[stay] & np.uint64(0xFFFFFFFF)).view(np.int64), "node": node[stay], "hub": hub[stay],
            "size": size[stay].astype(np.int32), "place": place[stay].astype(np.int32), "hub_size": np.repeat(size[first], n)[stay].astype(np.int32),
        })
        post = np.empty(int((~stay).sum()), _POST)
        post["low"], post["size"], post["place"], post["node"] = (x[~stay] for x in (shingle.astype(np.uint32), size, place, node))
        bucket = bucket[~stay]
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        cut = [*first.tolist(), len(order)]
        post = post[order]
        packed = [post[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        units, data = names.astype(np.int64).tolist(), [None] * len(names)
        for start in range(0, apart.num_rows, BUCKET):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, apart.schema) as out:
                out.write_batch(apart.slice(start, BUCKET))
            units.append(-1 - int(node[0]) % buckets)
            packed.append(None)
            data.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.int64()), "post": pa.array(packed, pa.binary()), "apart": pa.array(data, pa.binary())})

    def pack(batches):
        held, n = [], 0
        for b in batches:
            early = b["early"].to_pylist()
            size = np.array([len(v) // 8 for v in early], np.int64)
            whole = np.array([int.from_bytes(v[:8], "little") for v in b["sketch"].to_pylist()], np.int64)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code = np.rint(SIZE_STEPS * np.log(np.maximum(whole, 1))).astype(np.uint16)
            held.append((np.frombuffer(b"".join(early), "<u8"), np.repeat(b["node"].to_numpy(), size), np.repeat(code, size),
                         (at * PLACE_STEPS // np.repeat(np.maximum(whole, 1), size)).astype(np.uint16)))
            n += int(size.sum())
            if n >= FLUSH:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    def meet(table: pa.Table):
        found = [pa.ipc.open_stream(v).read_all() for v in table["apart"].to_pylist() if v is not None]
        packed = [(u, np.frombuffer(v, _POST)) for u, v in zip(table["unit"].to_pylist(), table["post"].to_pylist(), strict=True) if v is not None]
        if packed:
            post = np.concatenate([v for _, v in packed])
            shard = np.repeat(np.array([u for u, _ in packed], np.int64), [len(v) for _, v in packed]) << 32 | post["low"]
            found.append(pa.table(_members(shard, post, similarity)))
        return pa.concat_tables(found).combine_chunks().to_batches()[0] if sum(t.num_rows for t in found) else pa.RecordBatch.from_pylist([], _MEMBER)

    packed = shapes.mapInArrow(tidy(pack), "unit long, post binary, apart binary").repartition("unit").sortWithinPartitions("unit")
    return packed.mapInArrow(tidy(_whole_units(meet, 512)), "shard long, node long, hub long, size int, place int, hub_size int")


_MEMBER = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("hub", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("hub_size", pa.int32())])


def _members(shard: np.ndarray, post: np.ndarray, similarity: float) -> dict:
    """Columns of the members that have a partner of fitting size in their shard or one that stands for others.

    In shards of few members the partner also has to fit by the shingle's places.
    """
    window = _size_window(similarity)
    order = np.lexsort((post["node"], post["size"], shard))
    shard, post = shard[order], post[order]
    node, size, place = post["node"].astype(np.int64), post["size"].astype(np.int64), post["place"].astype(np.int64)
    # the neighbour by size fits if any other member does
    fits = (shard[1:] == shard[:-1]) & (size[1:] - size[:-1] <= window) & (node[1:] != node[:-1])
    keep = np.zeros(len(shard), bool)
    keep[1:] = fits
    keep[:-1] |= fits
    stands = np.isin(shard, shard[place >= _STANDS])
    keep |= stands
    shard, node, size, place, stands = shard[keep], node[keep], size[keep], place[keep] & (_STANDS - 1), stands[keep]
    if len(shard):
        _, at, n = np.unique(shard, return_inverse=True, return_counts=True)
        listed = np.flatnonzero((n[at] <= LISTED) & ~stands)
        keep = np.ones(len(shard), bool)
        keep[listed] = False
        for p, q in _pairs_of(shard[listed]) if len(listed) else ():
            p, q = listed[p], listed[q]
            met = _fit(size, place, p, q, similarity) & (node[p] != node[q])
            keep[p[met]] = keep[q[met]] = True
        shard, node, size, place = shard[keep], node[keep], size[keep], place[keep]
    order = np.lexsort((_mixed(node, shard.view(np.uint64)), shard))
    shard, node, size, place = shard[order], node[order], size[order], place[order]
    _, first, n = np.unique(shard, return_index=True, return_counts=True)
    return {"shard": shard, "node": node, "hub": np.repeat(node[first], n), "size": size.astype(np.int32), "place": place.astype(np.int32),
            "hub_size": np.repeat(size[first], n).astype(np.int32)}


def _fitting(similarity: float) -> Column:
    """Whether the sizes of ``p`` and ``q`` and the places of the shingle that they share allow the similarity.

    Their first shared shingle leaves at most what follows it in either set to share.
    """
    ratio = F.exp((F.col("q.size") - F.col("p.size")) / F.lit(float(SIZE_STEPS)))
    least = (1 + ratio) * F.lit(similarity / (1 + similarity) * 0.998)
    return (
        (F.abs(F.col("q.size") - F.col("p.size")) <= _size_window(similarity))
        & (1 - F.col("p.place") / F.lit(float(PLACE_STEPS)) >= least) & (ratio * (1 - F.col("q.place") / F.lit(float(PLACE_STEPS))) >= least)
    )


def _exact_links(docs: DataFrame, rows: DataFrame, stand: DataFrame, sure: DataFrame, width: int, similarity: float) -> DataFrame:
    """``sure`` with links that join all nodes whose shingle sets reach the similarity.

    ``stand`` has one row ``(node, doc_id, text_key, sketch, early)`` for each node; ``docs`` the texts.
    """
    members = materialize(_early(stand.select("node", "sketch", "early"), similarity), "members")
    drop_shuffles(docs.sparkSession)
    sketches = materialize(stand.select("node", _short(F.col("sketch")).alias("sketch")), "sketches")

    def sets(asked: DataFrame) -> DataFrame:
        asked = asked.distinct()
        named = materialize(stand.select("node", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).join(asked, "node"), "named")
        few = maybe_broadcast(named, named.count(), 40)
        texts = docs.join(few, docs["doc_id"].eqNullSafe(few["__id"]) & (F.xxhash64(docs["text"]) == few["__key"]))
        # repeated rows of a text come in as often as they stand there
        out = materialize(_sets(texts.select("node", F.col("text").cast("string").alias("text")).dropDuplicates(["node"]), width), "sets")
        release(named)
        return out

    def sided(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        side = lambda c, v: table.select(F.col("node").alias(c), F.col(value).alias(v))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def checked(maybe: DataFrame) -> DataFrame:
        held = sets(maybe.select(F.col("a").alias("node")).union(maybe.select("b")))
        met = materialize(sided(maybe, held, "shingles").mapInArrow(tidy(_checked(similarity)), "a long, b long"), "met")
        release(held)
        return met

    def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs whose ends the links leave in different classes."""
        roots = materialize(connected_components(links, one_task=FEW_LINKS), "roots")
        few = maybe_broadcast(roots, roots.count(), 40)
        a, b = (few.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        return pairs.join(a, "a", "left").join(b, "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    def confirmed(pairs: DataFrame, links: DataFrame, likely: bool) -> DataFrame:
        """``links`` and those of the pairs that reach the similarity and join what is apart.

        Of ``likely`` pairs each node is checked against one partner first; that joins most, and what
        it joins need not be checked again.
        """
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        maybe = materialize(sided(pairs, sketches, "sketch").mapInArrow(tidy(_possible(similarity)), "a long, b long"), "maybe")
        if not likely:
            links = links.union(checked(maybe))
            release(maybe)
            return links
        one = maybe.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(maybe.groupBy("a").agg(F.min("b").alias("b")).select("a", "b"))
        links = links.union(checked(materialize(one.distinct(), "first")))
        links = links.union(checked(materialize(apart(maybe, links), "rest")))
        release(maybe)
        return links

    def rooted(table: DataFrame, links: DataFrame) -> DataFrame:
        roots = materialize(connected_components(links, one_task=FEW_LINKS), "roots")
        return table.join(maybe_broadcast(roots, roots.count(), 40), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def several(table: DataFrame) -> DataFrame:
        """Shards with members of more than one class, and their number; a table of its own, so that a
        hot shard joins by a skew join that Spark can split."""
        seen = table.groupBy("shard").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"))
        found = materialize(seen.filter("least <> most").select("shard", "n"), "shards")
        return maybe_broadcast(found, found.count(), 32)

    star = members.join(several(rooted(members, sure)).select("shard"), "shard").filter((F.col("node") != F.col("hub")) & (F.abs(F.col("size") - F.col("hub_size")) <= _size_window(similarity)))
    links = confirmed(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), sure, True)
    # a shard's pairs with its hub are checked; others may link where more than one class is left
    left = rooted(members, links)
    left = materialize(left.join(several(left).filter("n > 2"), "shard").select("shard", "node", "root", "size", "place", "n"), "open")
    release(members)
    drop_shuffles(docs.sparkSession)
    # at size such shards hold most texts many times: sketches, dealt by member, say who needs a check there
    units = _units(left.join(sketches, "node"), F.ceil(F.col("n") / UNIT), "root", "size", "place", "n", "sketch")
    asked = materialize(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        tidy(_whole_units(lambda t: _unit_partners(t, similarity), 2 * UNIT)), "unit long, side int, node long, root long, size int, place int, n long"
    ), "asked")
    release(left)
    drop_shuffles(docs.sparkSession)
    few = asked.filter(F.col("n") <= LISTED)
    met = few.alias("p").join(few.alias("q"), (F.col("p.unit") == F.col("q.unit")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root")) & _fitting(similarity))
    links = confirmed(met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")), links, False)
    many = asked.filter(F.col("n") > LISTED).select("unit", "side", "node", "root")
    if not many.isEmpty():
        held = sets(many.select("node"))
        matched = many.join(held, "node").repartition("unit").sortWithinPartitions("unit").mapInArrow(
            tidy(_whole_units(lambda t: _unit_matches(t, similarity), 2 * UNIT)), "a long, b long"
        )
        links = links.union(materialize(matched, "matched"))
        release(held)
    release(asked)
    return links


def _labelled(rows: DataFrame, linked) -> DataFrame:
    """``rows(doc_id, text_key, node, fp)`` with ``component_id``; ``linked`` makes links of the
    distinct ``(node, fp)``, given them and their number."""
    least = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("fp").alias("fp")), "prints")
    roots = connected_components(linked(least.select("node", "fp"), least.count()), one_task=FEW_LINKS)
    rooted = least.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    # a table of its own, so that a large class joins by a skew join that Spark can split
    named = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    return rows.join(rooted.select("node", "root").join(named, "root"), "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, text_key, fp, root, component_id)`` per document.

    ``text_key`` is a 64-bit hash of the text and ``root`` tells classes apart.  An empty table
    gives an empty result.
    """
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), fingerprint_column(F.col(text_col)).alias("fp")),
        "simhash",
    )
    return _labelled(rows.withColumn("node", F.col("fp")), links).select("doc_id", "text_key", "fp", "root", "component_id")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_SHINGLE,
                    similarity: float = SIMILARITY, lanes: int = SIMILAR_LANES) -> DataFrame:
    """As ``classes``, for near copies at a Jaccard similarity of word shingles; ``fp`` is binary."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(docs, width))
    shaped = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _shapes(F.col("text"), shared, width, similarity, lanes).alias("shape"))
    rows = materialize(
        shaped.select("doc_id", "text_key", "shape.*").select(F.monotonically_increasing_id().alias("row"), F.xxhash64("fp").alias("node"), "*"), "shapes"
    )
    # one row stands for all rows of a node: equal set fingerprints
    nodes = materialize(rows.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "nodes")
    others = materialize(rows.select("node", "row").join(nodes.select("node", F.col("row").alias("first")), "node").filter("row <> first").select("row"), "others")
    n, repeats = nodes.count(), others.count()
    stand = rows.join(maybe_broadcast(others, repeats, 24), "row", "left_anti") if repeats else rows
    sure = materialize(similar_pairs(stand.select("node", "fp"), n, similarity, 64 * lanes), "sure")
    drop_shuffles(docs.sparkSession)
    roots = materialize(connected_components(_exact_links(docs, rows, stand, sure, width, similarity), one_task=FEW_LINKS), "roots")
    rooted = nodes.join(maybe_broadcast(roots, roots.count(), 40), "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    rooted = materialize(rooted.select("node", "root").join(named, "root"), "rooted")
    out = materialize(rows.select("doc_id", "text_key", "fp", "node").join(rooted, "node").select("doc_id", "text_key", "fp", "root", "component_id"), "classes")
    for done in (rows, nodes, others, sure, roots, named, rooted):
        release(done)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: the smallest id of every class of ``similar_classes`` stays.

    Rows that share the kept id are ordered by text hash; identical repeats of the kept row
    collapse to one.  Columns are those of ``docs``.
    """
    found = similar_classes(docs, id_col, text_col)
    counted = materialize(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "counted")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = counted.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.doc_id").alias("kept_id"), F.col("best.text_key").alias("kept_key"))
    best = materialize(best, "best")
    kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    marked = materialize(counted.join(best, "root").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n", kept.alias("kept")), "marked")
    gone, repeats = marked.agg(F.count(F.when(~F.col("kept"), 1)), F.count(F.when(F.col("kept") & (F.col("n") > 1), 1))).first()
    drop = maybe_broadcast(marked.filter("not kept").select("__id", "__key"), gone, 32)
    on = docs[id_col].eqNullSafe(drop["__id"]) & (F.xxhash64(docs[text_col]) == drop["__key"])
    left = docs.join(drop, on, "left_anti")
    return left.dropDuplicates([id_col, text_col]) if repeats else left
