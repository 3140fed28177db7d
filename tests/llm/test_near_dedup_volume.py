import random

import numpy as np
import pyarrow as pa

from plexus.llm import simhash


def test_members_without_partners_send_no_sets(spark, monkeypatch):
    """Texts that share a passage alone meet in large shards, and none of them needs its set there."""
    monkeypatch.setattr(simhash, "RANKED", 0)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(40)]
    rows = [(i, " ".join(common + [word() for _ in range(200)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + word()) for i in range(3)]
    sets, write = [], simhash.materialize

    def seen(df, name="table"):
        out = write(df, name)
        sets.extend(out.collect() if name == "sets" else [])
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(range(60))
    assert len(sets) <= 6


def test_partners_of_units_against_brute_force():
    """Every pair at the similarity is kept, whatever the widths of its sketches; most others are not."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (5, 60, 66, 100, 130, 500, 520, 1020, 1030, 3000):
        base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        sets += [base, np.concatenate((base[: int(n * 0.93)], rng.integers(0, 1 << 62, int(n * 0.05), dtype=np.uint64))), rng.integers(0, 1 << 62, n, dtype=np.uint64)]
    short = []
    for s in sets:
        bits = max(64, 1 << (len(s) - 1).bit_length())
        odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        short.append(np.int64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    k = len(sets)
    code = np.rint(simhash.SIZE_STEPS * np.log([len(s) for s in sets])).astype(np.int32)
    for unit, side in ((np.zeros(k, np.int64), np.zeros(k, np.int32)), (np.arange(k) // 3, (np.arange(k) % 3 == 1).astype(np.int32))):
        table = pa.table({"unit": unit, "side": side, "node": np.arange(k), "root": np.arange(k), "size": code, "place": np.zeros(k, np.int32),
                          "n": np.full(k, k), "sketch": pa.array(short, pa.binary())})
        found = set(simhash._unit_partners(table, 0.8)["node"].to_pylist())
        near = set()
        for i in range(k):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    near |= {i, j}
        assert len(near) == 20 and near <= found and len(found) <= 22
