"""WARC archives as seekable Zstandard bundles, written and read by tasks.

Records are grouped into frames of about `frame_bytes` that are compressed on their own; an archive ends with a skippable frame
that tables the sizes and checksums of all frames, so any of them can be found and read alone. `write_archives` returns the
index: where each record identifier is, as an archive, a frame and an offset within the decompressed frame; `fetch` reads
records by it, `read_archives` reads whole archives by their seek tables.

Of pages with equal payloads one is a response, the others are revisits that refer to it, without a payload. Equality goes by
SHA-256; the page of a payload that is kept is found from counts per (digest, part), so a payload that a third of all pages
share is spread over `PARTS` groups. Archives have names of their own for each attempt of a task, and only the index of
attempts that succeeded names them: files of lost tasks are never read.

Edge cases: null html is an empty payload; a null url becomes a URN of the page's id; white space and control characters in
urls are percent-encoded; a null page_id counts as smaller than any other and stays null; repeated rows are records each, and of
rows with the same id and payload one is the response; an empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shared_dir, table

#: Uncompressed bytes of a frame and of an archive, about; a record is never split.
FRAME_BYTES, ARCHIVE_BYTES = 1 << 18, 1 << 28
#: Groups that pages of one payload are spread over.
PARTS = 64
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer, the flag for checksums.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
#: Fixed values of the record format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
_INDEX = "record_id string, page_id long, record_type string, archive string, frame int, frame_at long, frame_bytes long, offset long, length long"
_FRAME = "archive string, frame int, frame_at long, frame_bytes long, checksum long"
_RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_RECORD_ARROW = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
#: Payload bytes in a batch that goes back to Spark.
BATCH_BYTES = 1 << 23


class Archive:
    """One bundle while it's written: records gather in a frame, frames go to the file, the seek table ends it."""

    def __init__(self, folder: str, frame_bytes: int):
        self.uri, self.frame_bytes = f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = store.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=3)
        self.at, self.raw, self.entries = 0, 0, []
        self.open, self.size, self.members, self.index = [], 0, [], []
        self.add(record("warcinfo", _urn(uuid.uuid4().bytes), b"software: surveyloom\r\nformat: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")]), None)
        self.close_frame()

    def add(self, data: bytes, name: tuple | None) -> None:
        if self.open and self.size + len(data) > self.frame_bytes:
            self.close_frame()
        self.members.append((name, self.size, len(data)))
        self.open.append(data)
        self.size += len(data)

    def close_frame(self) -> None:
        if not self.open:
            return
        raw = b"".join(self.open)
        packed = self.pack.compress(raw)
        self.file.write(packed)
        self.index += [(*name, self.uri, len(self.entries), self.at, len(packed), at, length) for name, at, length in self.members if name]
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.at, self.raw = self.at + len(packed), self.raw + len(raw)
        self.open, self.size, self.members = [], 0, []

    def close(self) -> list[tuple]:
        """Ends the file; the index rows of its records."""
        self.close_frame()
        body = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.file.close()
        return self.index


def _urn(raw: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=4)}>"


def record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {NO_DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None, page: int | None) -> str:
    if url is None:
        return f"urn:page:{'' if page is None else page}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _page_record(page: int | None, url: str | None, payload: bytes, digest: bytes, kept: int | None, kind: str, shared: bool) -> tuple[str, bytes]:
    own = _urn(hashlib.sha256(digest).digest()) if kind == "response" and shared else _urn(uuid.uuid4().bytes)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Target-URI", _uri(url, page)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(hashlib.sha256(digest).digest()))]
        if kept is not None:
            fields.append(("X-Refers-To-Page-ID", str(kept)))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return own, record(kind, own, head if kind == "revisit" else head + payload, fields)


def _written(folder: str, frame_bytes: int, archive_bytes: int):
    names = _INDEX.replace(",", "").split()[::2]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[k] for k in _INDEX.replace(",", "").split()[1::2]]

    def rows(index: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=names)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page, url, payload, digest, kept, kind, shared in zip(*batch.columns):
                page = page.as_py()
                own, data = _page_record(page, url.as_py(), payload.as_py(), digest.as_py(), kept.as_py(), kind.as_py(), shared.as_py())
                archive = archive or Archive(folder, frame_bytes)
                archive.add(data, (own, page, kind.as_py()))
                if archive.raw > archive_bytes:
                    yield rows(archive.close())
                    archive = None
        if archive:
            yield rows(archive.close())

    return written


def write_archives(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The index of the archives written to `folder`; pages: page_id, url, html.

    Of pages with equal payloads of `least` bytes and more, that with the largest page_id is the response.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    named = named.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    tops = named.groupBy("digest", "part").agg(F.max("page_id").alias("top"))
    best = tops.groupBy("digest").agg(F.max(F.struct("top", "part")).alias("best"))
    where = tops.select("digest", "part").join(best, "digest").select("digest", "part", F.col("best.top").alias("kept"), (F.col("best.part") == F.col("part")).alias("holds"))
    order = F.row_number().over(Window.partitionBy("digest", "part").orderBy(F.col("page_id").desc_nulls_last(), "url"))
    placed = named.withColumn("place", order).join(where, ["digest", "part"])
    shared = F.octet_length("payload") >= least
    response = ~shared | (F.col("holds") & (F.col("place") == 1))
    records = placed.select("page_id", "url", "payload", "digest", "kept", F.when(response, "response").otherwise("revisit").alias("kind"), shared.alias("shared"))
    return materialise(records.mapInArrow(_written(folder, frame_bytes, archive_bytes), _INDEX))


def seek_table(file) -> list[tuple[int, int, int]]:
    """(compressed size, size, checksum) of each frame of an open archive."""
    end = file.size()
    file.seek(end - FOOTER.size)
    n, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the archive")
    file.seek(end - FOOTER.size - n * ENTRY.size)
    return list(ENTRY.iter_unpack(file.read(n * ENTRY.size)))


def _opened(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with _opened(uri) as file:
                table = seek_table(file)
            rows, at = [], 0
            for i, (size, _, checksum) in enumerate(table):
                rows.append((uri, i, at, size, checksum))
                at += size
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "frame", "frame_at", "frame_bytes", "checksum"])


class Frames:
    """Decompressed frames by place; the last file stays open and the last frame stays at hand."""

    def __init__(self):
        self.uri = self.file = self.at = self.raw = None
        self.unpack = zstandard.ZstdDecompressor()

    def read(self, uri: str, at: int, size: int) -> bytes:
        if uri != self.uri:
            self.close()
            self.uri, self.file = uri, _opened(uri)
        if at != self.at:
            self.file.seek(at)
            self.at, self.raw = at, self.unpack.decompress(self.file.read(size))
        return self.raw

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.uri = self.file = self.at = self.raw = None


def parsed(raw: bytes, at: int) -> tuple[dict[str, str], memoryview, int]:
    """(fields, block, where the next record starts) of the record at a place of a decompressed frame."""
    end = raw.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
    start, length = end + 4, int(fields["Content-Length"])
    return fields, memoryview(raw)[start : start + length], start + length + 4


def described(fields: dict[str, str], block: memoryview, with_payload: bool) -> tuple:
    """A row of `_RECORD`; of a response the digest and size are those of the payload read, checked against its header."""
    head = re.match(rb"(?s).*?\r\n\r\n", block)[0]
    size, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[len(head) :]
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
    page, kept = (int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    own = bytes(payload) if with_payload and fields["WARC-Type"] == "response" else None
    return fields["WARC-Record-ID"], page, fields["WARC-Target-URI"], fields["WARC-Type"], kept, digest, size, own


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RECORD_ARROW)], schema=_RECORD_ARROW)

    for row in rows:
        held.append(row)
        size += 500 + len(row[-1] or b"")
        if size > BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _whole(with_payload: bool):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        frames = Frames()
        for batch in batches:
            for uri, _, place, size, checksum in zip(*(c.to_pylist() for c in batch.columns)):
                raw, at = frames.read(uri, place, size), 0
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                    raise ValueError(f"frame at {place} of {uri} differs from its checksum")
                while at < len(raw):
                    fields, block, at = parsed(raw, at)
                    if fields["WARC-Type"] != "warcinfo":
                        yield described(fields, block, with_payload)
        frames.close()

    return lambda batches: _batched(records(batches))


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per page record of whole archives (archive: uri), found by their seek tables; frames are dealt over tasks."""
    frames = materialise(archives.select("archive").distinct().mapInArrow(_frames, _FRAME))
    return frames.repartition("archive", "frame").mapInArrow(_whole(with_payload), _RECORD)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        frames = Frames()
        for batch in batches:
            for uri, place, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                fields, block, _ = parsed(frames.read(uri, place, size), at)
                yield described(fields, block, True)
        frames.close()

    return _batched(rows())


def fetch(index: DataFrame) -> DataFrame:
    """The records that rows of the index name; each frame is read once by the task that has its rows."""
    wanted = index.select("archive", "frame_at", "frame_bytes", "offset").repartition("archive", "frame_at").sortWithinPartitions("archive", "frame_at", "offset")
    return wanted.mapInArrow(_fetched, _RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives to the shared folder; the rows describe what is read back from them."""
    index = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 turns 5 hexadecimal digits into 4 letters.
ORACLE_SQL = {"op11_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS x,
    row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY payload) AS kept FROM p),
g AS (
  SELECT *, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: instr('0123456789abcdef', x[5 * i + j + 1]) - 1), lambda a, b: 16 * a + b)) AS twenty FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(twenty, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN kept END AS refers_to
FROM g
"""}
QUERIES = {"op11_warc": op11_warc}
