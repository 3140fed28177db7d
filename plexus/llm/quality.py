"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text becomes a sparse vector over ``2**bits`` buckets: its words, word pairs, word shapes
(character class of the first, second and last byte, and a capped length), shape pairs and a mark
for a word that repeats its predecessor, each hashed, with the share of the text's n-grams of that
kind as value.  Words are split at ASCII white space with their case and punctuation kept.  The
weights follow FTRL-proximal with per-coordinate rates.  A score is the sparse dot product of a
text's vector with the weights, through the logistic function.

Training reads at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id; that
bound is the only limit, and scoring covers every text whole, however long.  Null and empty texts
have an empty vector and score the intercept alone.  Rows with a null label or id are not learnt
from; of several labels of one id the smallest counts, and of several texts the one with the
smallest hash is learnt from, so that repeated rows never add to the sample.  Repeated rows score
alike, and the columns of ``docs`` keep their names and values whatever they are called.  Without any labelled row the model is empty: it scores 0.5
and ``keep_good`` keeps every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from plexus.plans.workers import give_back, tidy

BITS = 18
#: Most labelled rows that a model is fitted on.
MAX_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-2
THRESHOLD = 0.7
#: Weight of a text's n-gram shares; large, since shares of long texts are small.
GAIN = 8.0

#: Bytes of text whose n-grams are held at once, unless a single text has more.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.full(256, 4, np.uint64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, value and owner (position of the text) of every n-gram of the texts."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))))
    word = _mix((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data))[starts])
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(offsets, starts, "right") - 1
    size = np.minimum(ends - starts, 15).astype(np.uint64)
    shape = (((_CLASS[data[starts]] * np.uint64(8) + _CLASS[data[np.minimum(starts + 1, ends - 1)]]) * np.uint64(8)
              + _CLASS[data[ends - 1]]) * np.uint64(16) + size)
    same = owner[1:] == owner[:-1]
    pair = lambda x: x[:-1] * np.uint64(31) + x[1:] * np.uint64(_BASE)
    kinds = [
        (word, owner),
        (pair(word)[same], owner[1:][same]),
        (shape, owner),
        (pair(shape)[same], owner[1:][same]),
        ((word[1:] == word[:-1]).astype(np.uint64)[same], owner[1:][same]),
    ]
    buckets, values, owners = [], [], []
    for kind, (code, of) in enumerate(kinds):
        n = np.bincount(of, minlength=len(texts))
        buckets.append((_mix(code + np.uint64((kind + 1) * _BASE % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64))
        values.append(GAIN / n[of])
        owners.append(of)
    return np.concatenate(buckets), np.concatenate(values), np.concatenate(owners)


def chunks(texts, limit: int = CHUNK_BYTES):
    """Encoded texts of an Arrow array, in runs of about ``limit`` bytes, with the first's position."""
    held, size, first = [], 0, 0
    for at, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, at
        held.append(data)
        size += len(data)
    if held:
        yield first, held


class Ftrl:
    """FTRL-proximal logistic regression; the last coordinate is the intercept."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, importance: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * importance
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _train(bits: int, epochs: int):
    def run(batches):
        rows = [r for b in batches for r in zip(b["rank"].to_pylist(), b["label"].to_pylist(), b["at"].to_pylist(), b["x"].to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        data = [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), y) for _, y, at, x in rows]
        model, positive = Ftrl(1 << bits), max(1, sum(y for *_, y in data))
        negative = max(1, len(data) - positive)
        heavy = {1: len(data) / (2 * positive), 0: len(data) / (2 * negative)}
        for _ in range(epochs):
            for at, x, y in data:
                model.learn(at, x, y, heavy[y])
        yield pa.RecordBatch.from_pydict({"w": [model.weights().astype(np.float32).tobytes()]})

    return run


def _sparse(bits: int):
    """Compress the labelled texts of a batch to distinct buckets and summed values."""

    def run(batches):
        for b in batches:
            for first, texts in chunks(b["text"]):
                at, x, owner = features(texts, bits)
                code, inverse = np.unique(owner * (1 << bits) + at, return_inverse=True)
                value = np.bincount(inverse, x, len(code)).astype(np.float32)
                bucket, cut = (code % (1 << bits)).astype(np.int32), np.searchsorted(code >> bits, np.arange(len(texts) + 1))
                tail, one = np.array([1 << bits], np.int32), np.ones(1, np.float32)
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_pydict({
                    "rank": b["rank"].slice(first, len(texts)), "label": b["label"].slice(first, len(texts)),
                    "at": [np.concatenate((bucket[s:e], tail)).tobytes() for s, e in spans],
                    "x": [np.concatenate((value[s:e], one)).tobytes() for s, e in spans],
                })

    return run


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from the labelled rows that are not held out.

    The sample joins as at most ``max_rows`` ids, and each id gives one text, which bounds both the
    broadcast and the one task that runs the sequential updates.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = (
        known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
        .withColumn("rank", F.xxhash64("__id")).orderBy("rank", "__id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    one = F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("one")
    rows = rows.groupBy("rank", "__id", "label").agg(one).select("rank", "label", F.col("one.text").alias("text"))
    sparse = rows.mapInArrow(tidy(_sparse(bits)), "rank long, label int, at binary, x binary")
    found = sparse.repartition(1).mapInArrow(tidy(_train(bits, epochs)), "w binary").first()
    return np.frombuffer(found["w"], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score_column(spark, weights: np.ndarray, text: Column) -> Column:
    """Score from 0 to 1 of a text column; the weights are of a fixed size and broadcast."""
    bits, shared = (len(weights) - 1).bit_length() - 1, spark.sparkContext.broadcast(weights)

    def score(texts: pa.Array) -> pa.Array:
        w, n = shared.value.astype(np.float64), len(texts)
        out = np.full(n, w[-1])
        for first, part in chunks(texts):
            at, x, owner = features(part, bits)
            out[first : first + len(part)] += np.bincount(owner, x * w[at], len(part))
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return arrow_udf(score, DoubleType())(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    weights = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        score_column(docs.sparkSession, weights, F.col(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they were."""
    weights = fit(docs, labels, id_col=id_col, text_col=text_col)
    if not weights.any():
        return docs
    return docs.filter(score_column(docs.sparkSession, weights, F.col(text_col)) >= THRESHOLD)
