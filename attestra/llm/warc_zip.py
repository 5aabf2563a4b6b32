"""WARC records in ZIP-packaged archives, read by range.

A package is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members of
their own, and ``indexes/index.cdxj``, one line a record with its offset and length inside the archive member.  The
reader finds the end-of-central-directory record, follows the ZIP64 locator where sizes or counts overflow, parses the
central directory and the local headers, and then reads single records by byte range; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the ZIP format: signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL = 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages have no capture date; a fixed one keeps retried files equal


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class StoredZipWriter:
    """Stored members one after another; every size is written as ZIP64, so no archive is too long."""

    def __init__(self, out):
        self.out, self.members, self.at = out, [], 0

    def begin(self, name: str) -> None:
        self.name, self.start, self.size, self.crc = name.encode(), self.at, 0, 0
        # sizes follow in a data descriptor (flag bit 3), for the member is streamed
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._raw(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 0x21, 0, FULL, FULL, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._raw(data)

    def end(self) -> None:
        self._raw(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
            self._raw(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, FULL, FULL, len(name), len(extra), 0, 0, 0, 0, FULL) + name + extra)
        size, n, end64 = self.at - begin, len(self.members), self.at
        self._raw(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, begin))
        self._raw(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._raw(struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0))


class ZipReader:
    """Members of a ZIP file by name, with the place of their data; plain and ZIP64 directories."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.length = self.file.seek(0, os.SEEK_END)
        self.members = self._directory()

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut short")
        return data

    def _directory(self) -> dict[str, dict]:
        tail_at = max(0, self.length - 22 - 0xFFFF)  # a comment of up to 65,535 bytes may follow
        tail = self.range(tail_at, self.length - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, begin = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or FULL in (size, begin):
            where = tail_at + at - 20
            signature, _, end64, _ = struct.unpack("<IIQI", self.range(where, 20))
            if signature != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            head = struct.unpack("<IQHHIIQQQQ", self.range(end64, 56))
            if head[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, size, begin = head[7:]
        return self._entries(self.range(begin, size), n)

    def _entries(self, directory: bytes, n: int) -> dict[str, dict]:
        out, at = {}, 0
        for _ in range(n):
            head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if head[0] != CENTRAL:
                raise ValueError("bad central directory entry")
            names, extras, comments = head[10:13]
            name = directory[at + 46 : at + 46 + names].decode()
            extra = directory[at + 46 + names : at + 46 + names + extras]
            packed, size, local = self._zip64(extra, head[9], head[8], head[16])
            out[name] = {"method": head[4], "crc": head[7], "packed": packed, "size": size, "local": local}
            at += 46 + names + extras + comments
        return out

    @staticmethod
    def _zip64(extra: bytes, size: int, packed: int, local: int) -> tuple[int, int, int]:
        """Fields of the ZIP64 extra stand in this order, and only those that overflow are there."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                size = next(values) if size == FULL else size
                packed = next(values) if packed == FULL else packed
                local = next(values) if local == FULL else local
            at += 4 + n
        return packed, size, local

    def place(self, name: str) -> int:
        """Where a stored member's data begins; its local header may be longer than the directory tells."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} is compressed and can't be read by range")
        head = struct.unpack("<IHHHHHIIIHH", self.range(member["local"], 30))
        if head[0] != LOCAL:
            raise ValueError(f"{name}: bad local header")
        return member["local"] + 30 + head[9] + head[10]

    def close(self) -> None:
        self.file.close()


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n") or "urn:none"


def record(page_id: int, url: str | None, payload: bytes, original: int | None) -> bytes:
    """A response record, or a revisit of ``original``, whose block has the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}').urn}>"
    block = http + payload if original is None else http
    head = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Identified-Page", str(page_id))]
    if original is not None:
        head += [("WARC-Profile", SAME), ("WARC-Refers-To", name(original)), ("WARC-Refers-To-Page", str(original))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_originals(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload, original): the smallest id of equal payloads of at least ``least`` bytes, null for itself.

    Only digests are grouped and joined, with a partial minimum before the shuffle; payloads go along on the large side,
    whose hot digests the adaptive skew join splits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("digest").alias("_digest"), "first")
    joined = rows.join(first.hint("shuffle_hash"), F.col("digest") == F.col("_digest"), "left")
    return joined.select("id", "url", "payload", F.when(F.col("first") != F.col("id"), F.col("first")).alias("original"))


def _write(folder: str, level: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        name, count = f"{folder}/part-{part:06d}.wacz", 0

        def body(out):
            nonlocal count
            package, index, at = StoredZipWriter(out), [], 0
            package.begin(DATA)
            for batch in batches:
                for page_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = gzip.compress(record(page_id or 0, url, payload.encode(), original), level, mtime=0)
                    package.write(raw)
                    index.append(json.dumps({"page": page_id, "offset": at, "length": len(raw), "filename": DATA, "url": _clean(url)}))
                    at, count = at + len(raw), count + 1
            package.end()
            package.begin(INDEX)
            package.write("".join(line + "\n" for line in index).encode())
            package.end()
            package.begin("datapackage.json")
            package.write(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            package.end()
            package.finish()

        common.publish(name, body)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """Write ``pages`` as packages below ``folder``; a row for each file: path, records.

    A null payload counts as empty.  Rows that repeat an id are each written; of equal payloads all rows with the
    smallest id are responses.  A null id is written as a response under no page.  An empty table gives empty packages.
    """
    rows = with_originals(pages, id_col, payload_col, least)
    files = rows.mapInArrow(common.tidy(_write(common.local_path(folder), level)), "path string, records long")
    return common.written(files, "warc-manifest")


def read_index(package: ZipReader) -> list[dict]:
    raw = package.range(package.place(INDEX), package.members[INDEX]["size"])
    return [json.loads(line) for line in raw.decode().splitlines()]


def _read(batches):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            package = ZipReader(path)
            base, rows = package.place(DATA), []
            for line in read_index(package):
                warc, http, payload = parse_record(gzip.decompress(package.range(base + line["offset"], line["length"])))
                digest, kind, to = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"], warc.get("WARC-Refers-To-Page")
                if kind == "response" and (sha1_base32(payload) != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{path}: damaged payload of page {line['page']}")
                rows.append((line["page"], int(http["Content-Length"]), digest, kind, None if to is None else int(to)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            package.close()


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    paths = files.select("path").repartition(common.owners_for(files.sparkSession), "path")
    return paths.mapInArrow(common.tidy(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.new_folder(spark, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, unhex(sha1(html)) AS raw FROM m),
-- base32: 32 digits of five bits each from the 160 bits
d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + 5 * i, 5))::INT, 1)), 'string_agg', '') AS b32
      FROM (SELECT *, raw::BIT::VARCHAR AS bits FROM b))
SELECT page_id, strlen(html) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""
