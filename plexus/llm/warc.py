"""ZIP-packaged web archives: written as stored members, read by ranges through the directories.

An archive is a ZIP file with three stored members: the records (``archive/data.warc``, or
``.warc.gz`` with one gzip member per record), their index (``indexes/index.cdx``: a line of JSON
per record with offset and length) and ``datapackage.json``.  The reader finds the end record, the
ZIP64 end record if there is one, and the central directory (with ZIP64 extra fields); it locates
the members' data through their local headers and reads each record at the offset its index line
names.  No member is extracted, and of an archive file no more is read than the directories, the
index and the records: neighbouring records in one range of up to ``RANGE_BYTES``.

Archives are files in the shared folder, named in a table ``(path)``: a lost task leaves a file that
no row names.  ``read_ranges`` reads files through Arrow's file systems, which know seeks; where they
do not reach the store, ``read_archives`` takes archives as rows ``(content)``, for instance of
Spark's ``binaryFile`` source, and cuts the same ranges out of those bytes.  The writer closes an
archive at ``ARCHIVE_BYTES``.  Index lines may be JSON alone or follow a key and a time stamp, and
records of other writers need neither a page id nor a stated payload length.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest page id
is the response and the others are revisits of it without a payload block.  A null payload is the
empty one.  Rows that repeat the largest id with an equal payload are responses too.  Null ids
order below all others; if a group has null ids alone, all its records are responses.  An empty
table makes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.plans.tables import materialize, maybe_broadcast, shared_root
from plexus.plans.workers import tidy

ARCHIVE_BYTES = 8 << 20
#: Most bytes of neighbouring records that one read takes, unless a single record has more.
RANGE_BYTES = 1 << 20
#: Reading tasks for each core.
READERS = 16
RECORDS, INDEX, PACKAGE = "archive/data.warc", "indexes/index.cdx", "datapackage.json"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ---------------------------------------------------------------------------------


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(uri or '').translate({13: 32, 10: 32})}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and block of one record, gzip-compressed or plain; header names in lower case."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("record is cut short")
    return {"headers": head, "block": block}


# --- ZIP -------------------------------------------------------------------------------------


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; sizes and offsets go to ZIP64 fields if they need to or if asked."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, n, label = len(out), zlib.crc32(data), len(data), name.encode()
        wide = zip64 or n >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        short = _MAX32 if wide else n
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 33, crc, short, short, len(label), len(extra)) + label + extra
        out += data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, short, short, len(label), len(extra), 0, 0, 0, 0,
            _MAX32 if wide else at,
        ) + label + extra
    at, n, size = len(out), len(members), len(central)
    out += central
    if zip64 or at >= _MAX32 or size >= _MAX32 or n >= _MAX16:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, at)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        at, n, size = _MAX32, _MAX16, _MAX32
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, at, 0)
    return bytes(out)


class Bytes:
    """An archive held in memory, read by ranges."""

    def __init__(self, content) -> None:
        self.content = memoryview(content)
        self.size = len(self.content)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("range lies outside the archive")
        return bytes(self.content[at : at + n])


class File:
    """An archive file, of which only the asked ranges are read."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("range lies outside the archive")
        return self.file.read_at(n, at)


def _directory_place(archive) -> tuple[int, int, int]:
    """Entries, bytes and offset of the central directory."""
    tail_at = max(0, archive.size - 65557)
    tail = archive.read(tail_at, archive.size - tail_at)
    found = tail.rfind(b"PK\x05\x06")
    if found < 0:
        raise ValueError("no end of central directory")
    n, size, at = struct.unpack_from("<HII", tail, found + 10)
    locator = archive.read(tail_at + found - 20, 20) if tail_at + found >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        end = archive.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is not where its locator points")
        n, size, at = struct.unpack_from("<QQQ", end, 32)
    return n, size, at


def directory(archive) -> dict[str, tuple[int, int]]:
    """Offset and length of every stored member's data, by name."""
    archive = archive if hasattr(archive, "read") else Bytes(archive)
    n, size, at = _directory_place(archive)
    table, out, seen = archive.read(at, size), {}, 0
    for _ in range(n):
        if table[seen : seen + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        (how,) = struct.unpack_from("<H", table, seen + 10)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", table, seen + 20)
        (local,) = struct.unpack_from("<I", table, seen + 42)
        name = table[seen + 46 : seen + 46 + name_n].decode()
        extra, stop = seen + 46 + name_n, seen + 46 + name_n + extra_n
        while extra + 4 <= stop:
            tag, length = struct.unpack_from("<HH", table, extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", table, extra + 4))
                plain, packed, local = (next(wide) if v == _MAX32 else v for v in (plain, packed, local))
            extra += 4 + length
        if how == 0:
            own_name, own_extra = struct.unpack("<HH", archive.read(local + 26, 4))
            out[name] = (local + 30 + own_name + own_extra, packed)
        seen = stop + note_n
    return out


def read_range(archive, member: tuple[int, int], offset: int, length: int) -> bytes:
    """Bytes of a stored member, straight from the archive."""
    archive = archive if hasattr(archive, "read") else Bytes(archive)
    start, size = member
    if offset < 0 or offset + length > size:
        raise ValueError("range lies outside the member")
    return archive.read(start + offset, length)


def package(records: list[tuple[int | None, bytes]], zip64: bool = False, compress: bool = False) -> bytes:
    """An archive of the given (page id, record) pairs."""
    data, lines = bytearray(), []
    name = RECORDS + ".gz" * compress
    for page_id, raw in records:
        raw = gzip.compress(raw, 6, mtime=0) if compress else raw
        lines.append(json.dumps({"page_id": page_id, "filename": name, "offset": len(data), "length": len(raw)}))
        data += raw
    about = json.dumps({"profile": "data-package", "resources": [{"path": name}, {"path": INDEX}]})
    return write_zip([(name, bytes(data)), (INDEX, "\n".join(lines).encode()), (PACKAGE, about.encode())], zip64)


def _entry(line: bytes) -> dict | None:
    """An index line: JSON, alone or after a key and a time stamp."""
    at = line.find(b"{")
    return json.loads(line[at:]) if at >= 0 else None


def _member(members: dict, name: str) -> str:
    """The member that an index names, by its whole path or its last part."""
    if name in members:
        return name
    for full in members:
        if full.rpartition("/")[2] == name:
            return full
    raise ValueError(f"the archive holds no {name}")


def records_of(archive):
    """Yield every record of an archive, found through its indexes and read by ranges."""
    archive = archive if hasattr(archive, "read") else Bytes(archive)
    members = directory(archive)
    for name, where in members.items():
        if not (name.startswith("indexes/") and name.endswith((".cdx", ".cdxj"))):
            continue
        entries = [e for e in map(_entry, read_range(archive, where, 0, where[1]).splitlines()) if e]
        rows = sorted((_member(members, e["filename"]), int(e["offset"]), int(e["length"]), k) for k, e in enumerate(entries))
        held: list[tuple] = []
        for row in [*rows, None]:
            if held and (row is None or row[0] != held[0][0] or row[1] + row[2] - held[0][1] > RANGE_BYTES):
                start = held[0][1]
                data = read_range(archive, members[held[0][0]], start, max(o + n for _, o, n, _ in held) - start)
                for _, o, n, k in held:
                    yield {"page_id": entries[k].get("page_id"), **parse_record(data[o - start : o - start + n])}
                held = []
            if row is not None:
                held.append(row)


# --- tables ----------------------------------------------------------------------------------


def _pack(archive_bytes: int, compress: bool):
    """Archives of the pages, one after the other."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                raw = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                if held and size + len(raw) > archive_bytes:
                    yield package(held, compress=compress)
                    held, size = [], 0
                held.append((page_id.as_py(), raw))
                size += len(raw)
        if held:
            yield package(held, compress=compress)

    return run


def _to_rows(archives):
    def run(batches):
        for content in archives(batches):
            yield pa.RecordBatch.from_pydict({"content": [content]})

    return run


def _to_files(archives, folder: str):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for content in archives(batches):
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return run


def _told(pages: DataFrame, revisit_from: int) -> DataFrame:
    """``(page_id, url, html, refers_to)``.

    Which payloads repeat is settled on digests alone, pre-aggregated, so that neither a hot
    payload nor the pages themselves move: only the repeated digests join, broadcast if few.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.sha1("html"))
    many = materialize(
        rows.filter(F.octet_length("html") >= revisit_from).groupBy("key")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("last")).filter("n > 1 and last is not null").select("key", "last"),
        "payloads",
    )
    return rows.join(maybe_broadcast(many, many.count(), 80), "key", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, revisit_from: int = 0, compress: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in a table of rows ``(content)``."""
    return materialize(_told(pages, revisit_from).mapInArrow(tidy(_to_rows(_pack(archive_bytes, compress))), "content binary"), "archives")


def write_files(pages: DataFrame, folder: str | None = None, revisit_from: int = 0, compress: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archive files; rows ``(path)`` of the files that count.

    The folder has to be one that Arrow's file systems reach on all executors; by default it is a
    fresh one in the shared folder.
    """
    folder = folder or f"{shared_root(pages.sparkSession)}/plexus-wacz-{uuid.uuid4().hex}"
    return materialize(_told(pages, revisit_from).mapInArrow(tidy(_to_files(_pack(archive_bytes, compress), folder)), "path string"), "paths")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])


def _page(row: dict, payloads: bool) -> dict:
    head, block = row["headers"], row["block"]
    response = head.get("warc-type") != "revisit"
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if response and stated and digest(block) != stated:
        raise ValueError(f"payload of page {row['page_id']} does not match its digest")
    refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    length = head.get("warc-payload-length")
    return {
        "page_id": row["page_id"], "payload_bytes": len(block) if response else int(length) if length else None,
        "payload_digest": stated or (digest(block) if response else None), "record_type": head.get("warc-type"),
        "refers_to": int(refers) if refers.lstrip("-").isdigit() else None, "url": head.get("warc-target-uri"),
        "payload": block if payloads and response else None,
    }


def _unpack(column: str, opened, payloads: bool):
    """Records of the archives that ``opened`` makes of a column's values, in batches of bounded bytes."""

    def run(batches):
        for b in batches:
            for value in b[column]:
                out, size = [], 0
                for r in records_of(opened(value)):
                    out.append(_page(r, payloads))
                    size += len(r["block"]) if payloads else 0
                    if len(out) >= 500 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=_READ_ARROW)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_READ_ARROW)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives given as rows with a binary column ``content``."""
    return archives.select("content").mapInArrow(tidy(_unpack("content", lambda v: Bytes(v.as_buffer()), payloads)), _READ)


def read_ranges(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archive files given as rows with a column ``path``, by ranged reads."""
    tasks = max(1, min(paths.count(), READERS * paths.sparkSession.sparkContext.defaultParallelism))
    return paths.select("path").repartition(tasks).mapInArrow(tidy(_unpack("path", lambda v: File(v.as_py()), payloads)), _READ)


def read_archive_files(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of archive files in any store that Spark reads, each taken as a row."""
    return read_archives(spark.read.format("binaryFile").load(path), payloads)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write the pages and read them back: as files by ranged reads, or as rows where Arrow's file
    systems do not reach the shared folder."""
    root = shared_root(pages.sparkSession)
    try:
        if ":" in root.split("/")[0]:
            fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_archives(write_archives(pages), payloads)
    return read_ranges(write_files(pages), payloads)
