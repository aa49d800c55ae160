"""WARC records in ZIP packages, read by range without extraction.

Writing: each task streams its pages into archives of about `archive_bytes`. A package is a ZIP file
with stored members: archive/data.warc.gz (each record a gzip member of its own), indexes/index.cdxj
(one line per record with offset and length) and datapackage.json.

Reading: each task takes whole packages of the manifest, parses the end record, the ZIP64 locator and
end record, and the central directory with its ZIP64 extras, finds the stored members, and reads each
record by the offset and length of its index line.

Files are opened with pyarrow.fs by URI, so that the shared folder may be any store it knows. A task
writes under a name of its own, which holds the number of its attempt, and moves the finished file. A repeated
task may deal its pages otherwise; it leaves files beside those of the first, and the manifest names those of
one attempt only. What the manifest does not name is not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
MANIFEST = "uri string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
SMALL = 32 << 20  # bytes of marks of repeated payloads that are broadcast


def target(url: str) -> str:
    """The URL as a header holds it: spaces and control characters, line ends among them, percent-encoded. The index has it as it was."""
    return re.sub(r"[\x00-\x20\x7F-\x9F\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id, url, kind: str, digest: str, refers_to, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target(url)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if kind == "revisit" else payload)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class PackageWriter:
    """Streams records into one package."""

    def __init__(self, uri: str):
        self.uri, self.temp = uri, f"{uri}.{uuid.uuid4().hex}.tmp"
        self.fs, self.path = pafs.FileSystem.from_uri(self.temp)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at, self.size = [], 0, 0

    def add(self, page_id, url, kind, digest, refers_to, payload: bytes) -> None:
        raw = gzip.compress(record(page_id, url, kind, digest, refers_to, payload), 1, mtime=0)
        self.data.write(raw)
        self.index.append(json.dumps({"page": page_id, "url": url, "offset": self.at, "length": len(raw), "type": kind}))
        self.at += len(raw)
        self.size += len(payload) + 512

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        size = self.sink.tell()
        self.sink.close()
        self.fs.move(self.path, pafs.FileSystem.from_uri(self.uri)[1])
        return self.uri, size, len(self.index)


def central_directory(f, size: int) -> dict[str, dict]:
    """{member: method, offset, size} from the central directory of an open file, ZIP64 included."""

    def at(pos: int, n: int) -> bytes:
        f.seek(pos)
        return f.read(n)

    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, cd_size, cd_at = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (loc := at(locator, 20))[:4] == b"PK\x06\x07":
        end64 = at(struct.unpack("<Q", loc[8:16])[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end record")
        count, cd_size, cd_at = struct.unpack("<QQQ", end64[32:56])
    raw, pos, out = at(cd_at, cd_size), 0, {}
    for _ in range(count):
        if raw[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, full = struct.unpack("<H", raw[pos + 10 : pos + 12])[0], *struct.unpack("<II", raw[pos + 20 : pos + 28])
        n, extra, comment = struct.unpack("<HHH", raw[pos + 28 : pos + 34])
        offset = struct.unpack("<I", raw[pos + 42 : pos + 46])[0]
        name = raw[pos + 46 : pos + 46 + n].decode()
        x, stop = pos + 46 + n, pos + 46 + n + extra
        while x + 4 <= stop:
            tag, length = struct.unpack("<HH", raw[x : x + 4])
            if tag == 1:  # ZIP64: only the fields that do not fit stand here, in this order
                y = x + 4
                if full == 0xFFFFFFFF:
                    full, y = struct.unpack("<Q", raw[y : y + 8])[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack("<Q", raw[y : y + 8])[0], y + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack("<Q", raw[y : y + 8])[0]
            x += 4 + length
        out[name] = {"method": method, "offset": offset, "size": packed}
        pos = stop + comment
    return out


def member_start(f, entry: dict) -> int:
    """Where a stored member's bytes begin."""
    if entry["method"] != 0:
        raise ValueError("the member is compressed; only stored members can be read by range")
    f.seek(entry["offset"])
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    return entry["offset"] + 30 + sum(struct.unpack("<HH", head[26:30]))


def read_package(uri: str) -> Iterator[tuple[dict, dict, bytes]]:
    """(index line, headers, payload) of each record, each read by its range."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        members = central_directory(f, f.size())
        index = members[INDEX]
        f.seek(member_start(f, index))
        lines = f.read(index["size"])
        start = member_start(f, members[DATA])
        for line in io.BytesIO(lines):
            entry = json.loads(line)
            f.seek(start + entry["offset"])
            yield entry, *parse_record(gzip.decompress(f.read(entry["length"])))


def _writer(root: str, archive_bytes: int):
    def write(batches):
        task, seq, out = TaskContext.get(), 0, None
        done = []
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to"))):
                if out is None:
                    out = PackageWriter(f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{seq:04d}.wacz")
                    seq += 1
                out.add(page_id.as_py(), url.as_py(), kind.as_py(), digest.as_py(), refers_to.as_py(), payload.as_py())
                if out.size >= archive_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("uri", "bytes", "records"), d)) for d in done], pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))
    return write


_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _read(batches):
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows, size = [], 0
            for entry, h, payload in read_package(uri):
                kind = h["warc-type"]
                rows.append({"page_id": number(h["warc-record-id"]), "url": entry["url"], "record_type": kind, "refers_to": number(h.get("warc-refers-to", "")),
                             "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else h["warc-payload-digest"].removeprefix("sha256:"), "payload": payload if kind == "response" else None})
                size += len(payload) + 256
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)


def _sent(marks: DataFrame) -> DataFrame:
    """A materialised table of digests, broadcast if it has SMALL bytes at most."""
    return F.broadcast(marks) if marks.count() * 160 <= SMALL else marks


def write_packages(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes the pages below root and returns the manifest (uri, bytes, records), materialised.

    Of records with equal payloads of at least `least` bytes the one with the smallest id is a response
    and the others revisit it. A null html is an empty payload. Rows with equal id and payload are all
    responses if that id is the smallest; so are rows with a null id. An empty table writes no package.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small = rows.where(F.length("payload") >= least).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # both sides grow with the repeated payloads alone, and are broadcast while small; then no payload is shuffled
    again = materialise(small.join(_sent(materialise(first)), "digest").where(F.col("page_id") != F.col("refers_to")).distinct())
    rows = rows.join(_sent(again), ["page_id", "digest"], "left").withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    return materialise(rows.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(_writer(root, archive_bytes), MANIFEST))


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records (RECORDS) of the packages of a manifest, dealt to a few tasks per core; a task reads its packages in turn."""
    tasks = min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("uri").repartition(max(1, tasks)).mapInArrow(_read, RECORDS)


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    records = read_packages(write_packages(pages, scratch(spark, "warc")))
    records = records.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own"))
    records = materialise(records)
    held = records.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("own").alias("held"))
    revisits = records.where(F.col("record_type") == "revisit").join(held, ["refers_to", "payload_digest"], "left")
    responses = records.where(F.col("record_type") == "response").withColumn("held", F.col("own"))
    every = responses.unionByName(revisits)
    return every.select("page_id", F.col("held").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
