"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments, each a self-contained index of some consecutive documents: the
postings (positions) of every distinct word in the segment, written once to shared storage.  A
search takes a block of the benchmark to every segment.  For each phrase it orders the words by the
length of their postings, starts from the rarest list, shifts each list by the word's offset in the
phrase and intersects, for many phrases at once; what remains are the exact places.  Proximity
search intersects the same lists with a window of positions instead.  Nothing is shuffled: a
segment never needs another one.

The benchmark goes out in blocks of at most ``BLOCK_BYTES`` of text, which is a list of word codes
and a start, a length and the items of every distinct window: some five times the text.  With more
than one block each is searched in a pass of its own, which keeps the hits alone, and is given up
before the next one goes out.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds after A-Z are lower-cased.  Null
texts have no words; an item without words takes no part.  Null item ids count as the empty string,
equal windows of several items hit for all of them, and repeated documents are judged one by one.
Ids of documents may be of any type.
An empty corpus gives an empty result and an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.plans.loops import Levels
from plexus.plans.tables import materialize, maybe_broadcast, release
from plexus.plans.workers import tidy

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bytes of text that one segment indexes; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
#: Places of rarest words that are intersected at once.
AT_ONCE = 1 << 19

#: Byte to byte: A-Z to a-z, separators to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_SEGMENT = "keys array<long>, n_words array<int>, terms binary, counts binary, places binary, terms_size long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _segment(ids: list, keys: list, docs: list[list[bytes]]) -> dict:
    """Postings of some documents; a gap of one position parts neighbours."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = [w for d in docs for w in d]
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(docs)), n)
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int32)
    step = np.diff(place[order], prepend=0).astype(np.int32)
    squeeze = lambda b: pa.compress(b, "zstd", asbytes=True)
    terms = b" ".join(coded.dictionary.to_pylist())
    return {"ids": ids, "keys": keys, "n_words": n.astype(np.int32).tolist(), "terms": squeeze(terms) if terms else b"",
            "counts": counts.tobytes(), "places": squeeze(step.tobytes()) if len(step) else b"",
            "terms_size": len(terms)}


def _segment_schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(ids)), ("keys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()),
        ("counts", pa.binary()), ("places", pa.binary()), ("terms_size", pa.int64()),
    ])


def _index(segment_bytes: int):
    def run(batches):
        ids, keys, docs, size, schema = [], [], [], 0, None
        pack = lambda: pa.RecordBatch.from_pylist([_segment(ids, keys, docs)], schema=schema)
        for b in batches:
            schema = schema or _segment_schema(b.schema.field("id").type)
            for doc, key, text in zip(b["id"].to_pylist(), b["key"].to_pylist(), b["text"], strict=True):
                found = words_of(text.as_py())
                if docs and size + sum(map(len, found)) + len(found) > segment_bytes:
                    yield pack()
                    ids, keys, docs, size = [], [], [], 0
                ids.append(doc)
                keys.append(key)
                docs.append(found)
                size += sum(map(len, found)) + len(found)
        if docs:
            yield pack()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index every word of every text; one row per numbered segment, stored in the shared folder."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInArrow(tidy(_index(segment_bytes)), f"ids array<{kind}>, {_SEGMENT}")
    return materialize(packed.withColumn("segment", F.monotonically_increasing_id()), "postings")


class Segment:
    """A segment's postings, opened for searching."""

    def __init__(self, row: dict) -> None:
        self.ids, self.keys = row["ids"], row["keys"]
        self.n_words = np.array(row["n_words"], np.int64)
        counts = np.frombuffer(row["counts"], np.int32)
        terms = pa.decompress(row["terms"], row["terms_size"], "zstd", asbytes=True).split(b" ") if row["terms"] else []
        self.term = dict(zip(terms, range(len(terms)), strict=True))
        size = 4 * int(counts.sum())
        step = np.frombuffer(pa.decompress(row["places"], size, "zstd", asbytes=True), np.int32) if size else np.empty(0, np.int32)
        self.places = np.cumsum(step, dtype=np.int64)
        self.cut = np.concatenate(([0], np.cumsum(counts)))
        #: First position of each document.
        self.first = np.cumsum(self.n_words + 1) - self.n_words - 1

    def postings(self, code: int) -> np.ndarray:
        return self.places[self.cut[code] : self.cut[code + 1]]

    def phrases(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray):
        """Yield ``(phrase, start)`` arrays: places of the phrases ``codes[first : first + size]``, from their rarest words on."""
        count, span = np.diff(self.cut), int(self.n_words.sum()) + len(self.n_words) + int(size.max(initial=0)) + 1
        key = np.repeat(np.arange(len(count)), count) * span + self.places
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            for some in np.array_split(of, max(1, len(of) * n // AT_ONCE)):
                words = codes[first[some][:, None] + np.arange(n)]
                order = np.argsort(count[words], axis=1, kind="stable")
                words = np.take_along_axis(words, order, 1)
                lists = count[words[:, 0]]
                load = np.cumsum(lists)
                cuts = np.searchsorted(load, np.arange(AT_ONCE, load[-1] + AT_ONCE, AT_ONCE)) if len(load) else []
                begin = 0
                for stop in np.unique(np.concatenate((cuts, [len(some)]))).astype(np.int64).tolist():
                    w, o, m = words[begin:stop], order[begin:stop], lists[begin:stop]
                    who = np.repeat(np.arange(len(w)), m)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
                    starts = self.places[np.repeat(self.cut[w[:, 0]], m) + nth] - o[who, 0]
                    for j in range(1, n):
                        want = starts + o[who, j]
                        at = np.minimum(np.searchsorted(key, w[who, j] * span + want), len(key) - 1)
                        held = (key[at] == w[who, j] * span + want) & (want >= 0)
                        who, starts = who[held], starts[held]
                    if len(who):
                        yield some[begin + who], starts
                    begin = stop

    def near(self, codes: list[int], slop: int) -> np.ndarray:
        """Places of the rarest word with every other word at most ``slop`` positions away."""
        order = sorted(set(codes), key=lambda c: self.cut[c + 1] - self.cut[c])
        places = self.postings(order[0])
        for c in order[1:]:
            have = self.postings(c)
            places = places[np.searchsorted(have, places - slop) < np.searchsorted(have, places + slop, "right")]
        return places

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


class Phrases:
    """A block of the benchmark: its distinct windows and the items that hold each of them.

    ``codes`` are the words of all items one after the other; a window is a start and a length.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        texts = [words_of(text) for _, text in items]
        flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.items = ["" if i is None else str(i) for i, _ in items]
        self.words, self.codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int32)
        each = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        item = np.repeat(np.arange(len(n)), each)
        start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.cumsum(n) - n, each)
        length = np.minimum(window, n)[item]
        first, size, of, at = [], [], [], [np.zeros(1, np.int64)]
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            rows = np.ascontiguousarray(self.codes[start[own][:, None] + np.arange(k)])
            _, lead, same = np.unique(rows.view(f"V{4 * k}").ravel(), return_index=True, return_inverse=True)
            held = np.unique(same * len(n) + item[own])
            first.append(start[own][lead])
            size.append(np.full(len(lead), k))
            of.append(held % len(n))
            at.append(at[-1][-1] + np.cumsum(np.bincount(held // len(n), minlength=len(lead))))
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
        self.first, self.size, self.of, self.at = join(first, np.int32), join(size, np.int32), join(of, np.int32), join(at, np.int64)

    def within(self, segment: Segment):
        """Yield ``(phrase, start)`` arrays of every phrase that the segment holds."""
        if not len(self.first):
            return
        code = np.fromiter((segment.term.get(w, -1) for w in self.words), np.int64, len(self.words))[self.codes]
        lacking = np.concatenate(([0], np.cumsum(code < 0)))
        there = np.flatnonzero(lacking[self.first + self.size] == lacking[self.first])
        for who, starts in segment.phrases(code, self.first[there].astype(np.int64), self.size[there].astype(np.int64)):
            yield there[who], starts


_SPANS = "spans array<struct<start:int,stop:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _hits(block: Phrases, seg: Segment) -> dict[int, tuple[list, list]]:
    """Hit spans of words and items of the segment's documents that hold a window of the block."""
    turn = np.zeros(int((seg.n_words + 1).sum()) + 1, np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    for phrase, starts in block.within(seg):
        np.add.at(turn, starts, 1)
        np.add.at(turn, starts + block.size[phrase], -1)
        pairs.append(np.unique(np.stack((seg.owner(starts), phrase), axis=1), axis=0))
    pairs = np.concatenate(pairs)
    held = block.at[pairs[:, 1] + 1] - block.at[pairs[:, 1]]
    at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(block.at[pairs[:, 1]], held)
    both = np.unique(np.stack((np.repeat(pairs[:, 0], held), block.of[at]), axis=1), axis=0)
    marks, out = np.cumsum(turn) > 0, {}
    if not len(both):
        return out
    docs, cut = np.unique(both[:, 0], return_index=True)
    for d, items in zip(docs.tolist(), np.split(both[:, 1], cut[1:]), strict=True):
        edge = np.flatnonzero(np.diff(marks[seg.first[d] : seg.first[d] + seg.n_words[d]].astype(np.int8), prepend=0, append=0))
        out[d] = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()], sorted({block.items[i] for i in items.tolist()})
    return out


def _rows(batch: pa.RecordBatch):
    """The rows of a batch one at a time, so that one segment at once is copied."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _report(shared):
    """A row per document of each segment: its hit words, the items it holds and the hit spans of words."""

    def run(batches):
        for b in batches:
            kind = b.schema.field("ids").type.value_type
            schema = pa.schema([("doc_id", kind), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                                ("items", pa.list_(pa.string())), ("spans", _SPANS_ARROW)])
            for row in _rows(b):
                found, out = _hits(shared.value, Segment(row)), []
                for d, (i, k, n) in enumerate(zip(row["ids"], row["keys"], row["n_words"], strict=True)):
                    spans, items = found.get(d, ([], []))
                    out.append({"doc_id": i, "text_key": k, "n_words": n, "n_hit": sum(s["stop"] - s["start"] for s in spans), "items": items, "spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _only_hits(shared):
    """``(segment, nth, spans, items)`` of the documents that hold a window of the block."""
    schema = pa.schema([("segment", pa.int64()), ("nth", pa.int32()), ("spans", _SPANS_ARROW), ("items", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            for row in _rows(b):
                found = _hits(shared.value, Segment(row)).items()
                yield pa.RecordBatch.from_pylist([{"segment": row["segment"], "nth": d, "spans": s, "items": i} for d, (s, i) in found], schema=schema)

    return run


def _joined(index: DataFrame, hits: DataFrame) -> DataFrame:
    """The report of all documents from the hits of several blocks."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("ids", "keys", "n_words")).alias("nth", "d")).select(
        "segment", "nth", F.col("d.ids").alias("doc_id"), F.col("d.keys").alias("text_key"), F.col("d.n_words").cast("long").alias("n_words")
    )
    held = hits.groupBy("segment", "nth").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    grow = lambda done, s: F.when(  # noqa: E731  spans of one block may overlap those of another
        F.size(done) == 0, F.array(s)
    ).when(F.element_at(done, -1)["stop"] < s["start"], F.concat(done, F.array(s))).otherwise(F.concat(
        F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
        F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))),
    ))
    none = F.expr(f"cast(array() as {_SPANS.removeprefix('spans ')})")
    held = held.withColumn("spans", F.aggregate("s", none, grow))
    out = docs.join(held, ["segment", "nth"], "left").withColumn("spans", F.coalesce("spans", none))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "text_key", "n_words", hit.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "spans")


def _block_count(benchmark: DataFrame, text_col: str, block_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 16)).first()[0] or 0
    return 1 if total <= block_bytes else -(-2 * int(total) // block_bytes)


def _block(benchmark: DataFrame, id_col: str, text_col: str, k: int, blocks: int) -> Phrases:
    """One block of the benchmark, dealt by hash; only its own bounded rows come to the driver."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return Phrases([(r["id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``doc_id, text_key, n_words, n_hit, items, spans, contaminated``."""
    return _contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, block_bytes)[0]


def _contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The report and the index that it reads."""
    index = build_index(docs, id_col, text_col)
    blocks, spark = _block_count(benchmark, item_text_col, block_bytes), docs.sparkSession
    if blocks == 1:
        shared = spark.sparkContext.broadcast(_block(benchmark, item_col, item_text_col, 0, 1))
        kind = index.schema["ids"].dataType.elementType.simpleString()
        found = index.drop("segment").mapInArrow(tidy(_report(shared)), f"doc_id {kind}, text_key long, n_words long, n_hit long, items array<string>, {_SPANS}")
    else:
        hits = Levels(spark.createDataFrame([], f"segment long, nth int, {_SPANS}, items array<string>"), "hits")
        for k in range(blocks):
            shared = spark.sparkContext.broadcast(_block(benchmark, item_col, item_text_col, k, blocks))
            hits.append(index.mapInArrow(tidy(_only_hits(shared)), f"segment long, nth int, {_SPANS}, items array<string>"))
            shared.unpersist()
        found = _joined(index, hits.all())
    return found.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words")), index


def proximity(docs: DataFrame, queries: list[tuple[str, str]], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(query, doc_id, n)``: places of a query's rarest word with all its words within ``slop``."""
    index = build_index(docs, id_col, text_col)
    terms = [(name, words_of(text)) for name, text in queries]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seg, out = Segment(row), []
                for name, words in terms:
                    codes = [seg.term.get(w, -1) for w in words]
                    if codes and min(codes) >= 0:
                        doc, n = np.unique(seg.owner(seg.near(codes, slop)), return_counts=True)
                        out += [(name, seg.ids[d], int(c)) for d, c in zip(doc.tolist(), n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.int64())], ["query", "doc_id", "n"])

    return index.mapInArrow(run, "query string, doc_id long, n long")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the per-document report with the items as one hash."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    found, index = _contamination(docs, benchmark, id_col, text_col)
    bad = materialize(
        found.filter("contaminated")
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(),
        "contaminated",
    )
    release(index)
    drop = maybe_broadcast(bad, bad.count(), 32)
    on = docs[id_col].eqNullSafe(drop["__id"]) & (F.xxhash64(docs[text_col]) == drop["__key"])
    return docs.join(drop, on, "left_anti")

