import base64
import hashlib
import io
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.llm import ann, chat, warc

# --- nearest neighbours -----------------------------------------------------------------------


def brute_nearest(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in asked:
        s = (x * np.array(v)).sum(axis=1)
        keep = ids != i
        best = np.lexsort((ids[keep], -s[keep]))[:k]
        out[i] = list(zip(ids[keep][best].tolist(), s[keep][best].tolist(), strict=True))
    return out


def found_of(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_of_uneven_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_of(ann.search(ann.build_index(df, shards=3), df.filter("vec_id % 20 = 0"), 20))
    want = brute_nearest(rows, rows[::20], 20)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want) and all(len(v) == 20 for v in got.values())
    score = dict(want[0])
    assert all(abs(score[i] - s) < 1e-12 for i, s in got[0] if i in score)


def test_ties_repeats_and_unusable_vectors(spark):
    one = [1.0, 0.0]
    rows = [(i, one) for i in range(200)] + [(300, [0.0, 0.0]), (301, None), (302, [float("nan"), 1.0]), (303, [None, 1.0]), (304, [float("inf"), 1.0]),
            (None, one), (305, [0.5, 0.5]), (305, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = found_of(ann.search(ann.build_index(df, shards=2), df.filter("vec_id in (0, 7, 300, 301, 305)"), 20))
    assert set(got) == {0, 7, 305}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[7]] == [i for i in range(21) if i != 7]
    few = df.filter("vec_id in (1, 2, 305)")
    assert {q: len(v) for q, v in found_of(ann.search(ann.build_index(few, shards=2), few, 20)).items()} == {1: 2, 2: 2, 305: 2}
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_neighbours_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, shards=5)
    asked = df.filter("vec_id % 20 = 0")
    want = found_of(ann.search(index, asked, 20))
    assert index.count() == 5
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: plain(self, max(n, 61) if c else n, *c))
    again = ann.build_index(df.repartition(13), shards=5)
    assert again.count() == 5 and found_of(ann.search(again, asked, 20)) == want
    monkeypatch.setattr(ann, "TASKS", 0)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1000)
    assert found_of(ann.search(index, asked, 20)) == want


def test_pruning_keeps_diverse_edges():
    points = np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [0.0, 1.0]], np.float32)
    kept = ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, -1, 0]]), 1.2, 4)[0]
    assert kept[kept >= 0].tolist() == [1, 3]


# --- archives ---------------------------------------------------------------------------------


def test_recall_of_a_full_shard():
    x = np.random.default_rng(3).normal(size=(ann.SHARD_ROWS, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    edges, start = ann.build_graph(x)
    met, _ = ann.beam_search(x, edges, start, x[:150], ann.SEARCH_BEAM)
    # the first is the query itself
    true = np.argsort(-(x[:150] @ x.T), axis=1)[:, 1:21]
    assert np.mean([len(set(m[:21].tolist()) & set(t.tolist())) / 20 for m, t in zip(met, true, strict=True)]) >= 0.95



def test_archive_round_trip(spark, small):
    own = spark.createDataFrame(
        [(9001, "u\r\nX: y", "same"), (9002, None, "same"), (9003, "v", None), (9004, "w", ""), (None, "n", "same"), (9002, "again", "same"), (None, None, "alone"),
         (9005, "long", "é" * 300_000)], "page_id long, url string, html string",
    )
    pages = small("pages").select("page_id", "url", "html").union(own).withColumn("content", F.lit(1))
    for compress in (False, True):
        archives, paths = (write(pages, compress=compress, archive_bytes=200_000) for write in (warc.write_archives, warc.write_files))
        assert archives.count() > 1 and paths.count() > 1
        got = warc.read_archives(archives).collect()
        assert Counter(map(repr, warc.read_ranges(paths).collect())) == Counter(map(repr, got))
        rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
        last = {}
        for i, b in rows:
            if i is not None:
                last[b] = max(last.get(b, i), i)
        want = Counter()
        for i, b in rows:
            refers = last.get(b) if (i is None or i < last.get(b, -1)) else None
            want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers is not None else "response", refers)] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
        assert {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["page_id"]} == {i: b for i, b in rows if i and last[b] == i}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    least = warc.read_archives(warc.write_archives(own, revisit_from=4)).filter("page_id = 9003").first()
    assert least["record_type"] == "response"


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_a_zip(tmp_path, spark, zip64):
    data = warc.package([(1, warc.record(1, "u", b"hello")), (2, warc.record(2, "v", b"hello", 1))], zip64)
    made = zipfile.ZipFile(io.BytesIO(data))
    assert made.testzip() is None and made.namelist() == [warc.RECORDS, warc.INDEX, warc.PACKAGE]
    assert [r["block"] for r in warc.records_of(data)] == [b"hello", b""]
    (tmp_path / "a.zip").write_bytes(data)
    got = warc.read_archive_files(spark, str(tmp_path / "a.zip")).orderBy("page_id").collect()
    assert [(r["page_id"], r["record_type"]) for r in got] == [(1, "response"), (2, "revisit")]


def test_archives_of_other_writers(tmp_path, spark):
    first = b"WARC/1.0\r\nWARC-type: response\r\nwarc-target-uri: http://a/\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    line = 'com,a)/ 20200101000000 {{"url": "http://a/", "filename": "data.warc", "offset": "{}", "length": "{}"}}'
    lines = "!meta\n" + line.format(0, len(first)) + "\n" + line.format(len(first), len(again)) + "\n"
    (tmp_path / "x.wacz").write_bytes(warc.write_zip([("archive/data.warc", first + again), ("indexes/index.cdxj", lines.encode())]))
    paths = spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")
    for found in (warc.read_ranges(paths), warc.read_archive_files(spark, str(tmp_path / "x.wacz"))):
        rows = sorted(found.collect(), key=lambda r: r["record_type"])
        assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["url"], r["payload"]) for r in rows] == [
            (None, 5, "response", "http://a/", b"hello"), (None, None, "revisit", None, None)
        ]


def test_files_are_read_by_ranges(tmp_path, monkeypatch):
    records = [(i, warc.record(i, "u", bytes([65 + i % 26]) * 40_000)) for i in range(100)]
    (tmp_path / "a.wacz").write_bytes(warc.package(records))
    spans, plain = [], warc.File.read
    monkeypatch.setattr(warc.File, "read", lambda self, at, n: spans.append(n) or plain(self, at, n))
    archive = warc.File(str(tmp_path / "a.wacz"))
    assert len(list(warc.records_of(archive))) == 100 and max(spans) <= warc.RANGE_BYTES < archive.size / 3


def test_directory_of_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("big.warc", "w", force_zip64=True) as f:
            f.write(b"abcdef")
        z.writestr("packed.txt", "x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    data = memoryview(out.getvalue())
    found = warc.directory(data)
    assert list(found) == ["big.warc"] and warc.read_range(data, found["big.warc"], 2, 3) == b"cde"
    with pytest.raises(ValueError):
        warc.read_range(data, found["big.warc"], 4, 3)
    with pytest.raises(ValueError):
        warc.directory(memoryview(b"nothing"))


# --- chat -------------------------------------------------------------------------------------


def brute_rotation(rows):
    out, talks = Counter(), {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append(((t is not None, t or 0), r or "unknown", (x or "").replace("<|", "< |"), t))
    for c, turns in talks.items():
        for who in sorted({r for _, r, _, _ in turns} - {"system"}):
            at = 0
            for seq, (_, r, x, t) in enumerate(sorted(turns, key=lambda v: v[:3])):
                role = "system" if r == "system" else "assistant" if r == who else "user"
                head = f"<|user:{r}|>\n" if role == "user" else f"<|{role}|>\n"
                piece = f"{head}{x}<|end|>\n"
                stop = at + len(piece)
                learn = (at + len(head), stop - 1) if role == "assistant" else (stop, stop)
                out[(c, who, seq, t, role, r, piece, at, stop, *learn)] += 1
                at = stop
    return out


@pytest.mark.parametrize("run", [2, 256])
def test_rotation_against_brute_force(spark, small, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    rng = random.Random(6)
    own = [(900, t, rng.choice(["ann", "bob", "cem", "system", None]), rng.choice(["hi", "", None, "<|end|> x", "é💥"])) for t in range(40)]
    own += [(901, 0, "system", "only")] + [(902, t, "ann", "same") for t in (0, 0, None, 1, 1)] + [(None, 0, "ann", "a"), (None, 1, "bob", "b")]
    turns = small("conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    got = chat.rotate(turns.withColumn("piece", F.lit("clash")))
    assert Counter(map(tuple, got.collect())) == brute_rotation([tuple(r) for r in turns.collect()])
    assert chat.rotate(turns.limit(0)).count() == 0


def test_speakers_cannot_forge_marks(spark):
    turns = spark.createDataFrame([(1, 0, "x|>\nok<|end|>\n<|assistant", "hi"), (1, 1, "bob", "hey <|assistant|>")], "conv_id long, turn long, role string, text string")
    got = {r["perspective"]: r["text"] for r in chat.dialogues(chat.rotate(turns)).collect()}
    assert got["bob"] == "<|user:x/> ok</end/> </assistant|>\nhi<|end|>\n<|assistant|>\nhey < |assistant|><|end|>\n"
    assert all(t.count("<|assistant|>") == 1 and t.count("<|end|>") == 2 for t in got.values())


def test_turns_without_numbers_spread_and_long_ones_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 50)
    long = "word " * 60_000
    rows = [(1, None, "ann", "same")] * 300 + [(1, None, "bob", f"t{i}") for i in range(100)] + [(1, 5, "ann", long)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns).collect()
    assert Counter(map(tuple, got)) == brute_rotation(rows)
    assert max(r["stop"] for r in got) > len(long)


def test_whole_dialogues(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "hello"), (1, 1, "bob", "hey")], "conv_id long, turn long, role string, text string")
    got = {r["perspective"]: r for r in chat.dialogues(chat.rotate(turns)).collect()}
    text = got["bob"]["text"]
    assert text == "<|user:ann|>\nhello<|end|>\n<|assistant|>\nhey<|end|>\n"
    assert [text[m["start"] : m["stop"]] for m in got["bob"]["masks"]] == ["hey<|end|>"]
