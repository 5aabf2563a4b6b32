"""Exact dedup by an extendible-hash index on shared files.

Every partition first combines its own copies, so a text that a third of all rows share reaches its owner once
per partition at most.  A text's 64-bit key picks its owner: owner tasks hold contiguous key ranges.  An owner
keeps an extendible-hash index in the shared folder: a directory of 2**depth slots that doubles when a bucket of
the full local depth overflows, fixed-size bucket pages, and a heap of compressed texts.  Entries of equal key are
chained inside the bucket (and over overflow pages when keys cannot be told apart by more bits) and their texts are
compared byte by byte, so a key collision never merges different texts.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PAGE_BYTES = 4096
ENTRY = np.dtype([("key", "<u8"), ("at", "<u8"), ("raw", "<u4"), ("packed", "<u4"), ("keep", "<i8"), ("ties", "<i8"), ("count", "<i8")])
PER_PAGE = (PAGE_BYTES - 16) // ENTRY.itemsize
NO_ID = np.iinfo(np.int64).min  # stands for a null id; every other id is larger


class Page:
    """A bucket page: local depth, entries, and the next page of an overflow chain (-1: none)."""

    __slots__ = ("depth", "entries", "next", "used")

    def __init__(self, depth: int):
        self.depth, self.used, self.next = depth, 0, -1
        self.entries = np.zeros(PER_PAGE, ENTRY)

    def to_bytes(self) -> bytes:
        head = np.array([self.depth, self.used], "<u4").tobytes() + np.array([self.next], "<i8").tobytes()
        return (head + self.entries.tobytes()).ljust(PAGE_BYTES, b"\0")

    @classmethod
    def from_bytes(cls, raw: bytes) -> Page:
        page = cls(int.from_bytes(raw[:4], "little"))
        page.used = int.from_bytes(raw[4:8], "little")
        page.next = int.from_bytes(raw[8:16], "little", signed=True)
        page.entries = np.frombuffer(raw, ENTRY, PER_PAGE, 16).copy()
        return page


class ExtendibleHashIndex:
    """Texts by key on two files of ``folder``; at most ``cached`` pages and one pending heap block are in memory."""

    def __init__(self, folder: str, cached: int = 4096, heap_block: int = 4 << 20):
        os.makedirs(folder, exist_ok=True)
        self.pages_path, self.heap_path = f"{folder}/buckets.bin", f"{folder}/heap.bin"
        self.pages_file, self.heap_file = open(self.pages_path, "w+b"), open(self.heap_path, "w+b")
        self.folder, self.cached, self.heap_block = folder, cached, heap_block
        self.cache: OrderedDict[int, Page] = OrderedDict()
        self.depth, self.n_pages = 0, 0
        self.directory = [self._new(Page(0))]
        self.heap_end, self.pending, self.pending_at = 0, bytearray(), 0
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def _new(self, page: Page) -> int:
        number, self.n_pages = self.n_pages, self.n_pages + 1
        self._hold(number, page)
        return number

    def _hold(self, number: int, page: Page) -> None:
        self.cache[number] = page
        self.cache.move_to_end(number)
        while len(self.cache) > self.cached:
            old, out = self.cache.popitem(last=False)
            self.pages_file.seek(old * PAGE_BYTES)
            self.pages_file.write(out.to_bytes())

    def _page(self, number: int) -> Page:
        page = self.cache.get(number)
        if page is None:
            self.pages_file.seek(number * PAGE_BYTES)
            page = Page.from_bytes(self.pages_file.read(PAGE_BYTES))
        self._hold(number, page)
        return page

    def _slot(self, key: int) -> int:
        """Directory slots go by the low bits: the high bits have chosen the owner."""
        return key & ((1 << self.depth) - 1)

    def _text(self, entry) -> bytes:
        at, packed = int(entry["at"]), int(entry["packed"])
        if at >= self.pending_at:
            raw = bytes(self.pending[at - self.pending_at : at - self.pending_at + packed])
        else:
            self.heap_file.seek(at)
            raw = self.heap_file.read(packed)
        return self.unpack.decompress(raw, max_output_size=max(1, int(entry["raw"])))

    def _append(self, text: bytes) -> tuple[int, int]:
        packed = self.pack.compress(text)
        at = self.heap_end
        self.pending += packed
        self.heap_end += len(packed)
        if len(self.pending) >= self.heap_block:
            self._flush_heap()
        return at, len(packed)

    def _flush_heap(self) -> None:
        self.heap_file.seek(self.pending_at)
        self.heap_file.write(self.pending)
        self.pending, self.pending_at = bytearray(), self.heap_end

    def add(self, key: int, text: bytes, keep: int, ties: int, count: int) -> None:
        """Insert a text, or fold it into the entry that holds the same bytes."""
        number = self.directory[self._slot(key)]
        while number >= 0:
            page = self._page(number)
            for i in np.flatnonzero((page.entries["key"][: page.used] == key) & (page.entries["raw"][: page.used] == len(text))):
                entry = page.entries[i]
                if self._text(entry) == text:
                    if keep > entry["keep"]:
                        entry["keep"], entry["ties"] = keep, ties
                    elif keep == entry["keep"]:
                        entry["ties"] += ties
                    entry["count"] += count
                    return
            number = page.next
        at, packed = self._append(text)
        entry = np.array([(key, at, len(text), packed, keep, ties, count)], ENTRY)
        self._place(entry[0])

    def _place(self, entry) -> None:
        key = int(entry["key"])
        while True:
            number = self.directory[self._slot(key)]
            page = self._page(number)
            if page.next < 0 and page.used < PER_PAGE:
                page.entries[page.used] = entry
                page.used += 1
                return
            if page.next >= 0 or not self._can_split(page, key):
                self._chain(number, entry)
                return
            self._split(number, page)

    def _can_split(self, page: Page, key: int) -> bool:
        """More bits help only while the keys of the bucket differ somewhere above its local depth."""
        return page.depth < 48 and bool(((page.entries["key"] ^ np.uint64(key)) >> np.uint64(page.depth)).any())

    def _chain(self, number: int, entry) -> None:
        page = self._page(number)
        while page.next >= 0 and page.used == PER_PAGE:
            number, page = page.next, self._page(page.next)
        if page.used == PER_PAGE:
            fresh = Page(page.depth)
            fresh.entries[0], fresh.used = entry, 1
            page.next = self._new(fresh)
            self._hold(number, page)
        else:
            page.entries[page.used] = entry
            page.used += 1

    def _split(self, number: int, page: Page) -> None:
        if page.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit, entries = np.uint64(page.depth), page.entries[: page.used].copy()
        one = ((entries["key"] >> bit) & np.uint64(1)).astype(bool)
        page.depth += 1
        other = Page(page.depth)
        for target, rows in ((page, entries[~one]), (other, entries[one])):
            target.used = len(rows)
            target.entries[: len(rows)] = rows
        fresh = self._new(other)
        self._hold(number, page)
        low = int(entries["key"][0]) & ((1 << (page.depth - 1)) - 1)
        step = 1 << (page.depth - 1)
        for slot in range(low + step, len(self.directory), step << 1):
            self.directory[slot] = fresh

    def finish(self) -> None:
        self._flush_heap()
        for number, page in self.cache.items():
            self.pages_file.seek(number * PAGE_BYTES)
            self.pages_file.write(page.to_bytes())
        self.pages_file.flush()
        np.array(self.directory, "<i8").tofile(f"{self.folder}/directory.bin")

    def rows(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(text, keep, ties, count) of every entry, page by page."""
        for number in range(self.n_pages):
            page = self._page(number)
            for entry in page.entries[: page.used]:
                yield self._text(entry), int(entry["keep"]), int(entry["ties"]), int(entry["count"])

    def close(self) -> None:
        self.pages_file.close()
        self.heap_file.close()


COMBINED = "owner int, key long, text binary, keep long, ties long, n long"
GROUPS = "text_sha256 string, keep_id long, ties long, group_size long"


def _combine(owners: int, hold_bytes: int):
    """One row for each distinct text of a partition (of each ``hold_bytes`` of it)."""

    def emit(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        texts = list(held)
        keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
        owner = np.fromiter(((int(k) * owners) >> 64 for k in keys), np.int32, len(texts))
        stats = np.array(list(held.values()), np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()), *(pa.array(stats[:, i]) for i in range(3))], names=["owner", "key", "text", "keep", "ties", "n"])

    def run(batches):
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_pylist()
            for i, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                old = held.get(text)
                if old is None:
                    held[text] = [i, 1, 1]
                    size += len(text) + 200
                else:
                    if i > old[0]:
                        old[0], old[1] = i, 1
                    elif i == old[0]:
                        old[1] += 1
                    old[2] += 1
            if size >= hold_bytes:
                yield emit(held)
                held, size = {}, 0
        if held:
            yield emit(held)

    return run


def _own(folder: str, out_rows: int = 4096):
    """An owner task: index what arrives, then give each group once."""

    def run(batches):
        place = f"{folder}/owner-{uuid.uuid4().hex}"  # of this attempt; a lost attempt's folder is never read
        index = ExtendibleHashIndex(place)
        for batch in batches:
            columns = [batch.column(i) for i in range(1, 6)]
            keys = columns[0].to_numpy().view(np.uint64)
            texts = columns[1].to_pylist()
            keep, ties, n = (c.to_pylist() for c in columns[2:])
            for i, text in enumerate(texts):
                index.add(int(keys[i]), text, keep[i], ties[i], n[i])
        index.finish()
        rows: list[tuple] = []
        for text, keep_id, tie, count in index.rows():
            rows.append((hashlib.sha256(text).hexdigest(), None if keep_id == NO_ID else keep_id, tie, count))
            if len(rows) == out_rows:
                yield _groups(rows)
                rows = []
        yield _groups(rows)
        index.close()

    return run


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["text_sha256", "keep_id", "ties", "group_size"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, hold_bytes: int = 48 << 20) -> DataFrame:
    """The groups of equal texts: text_sha256, keep_id (largest id), ties (rows with that id), group_size."""
    spark = df.sparkSession
    owners = owners or common.owners_for(spark)
    rows = df.select(F.col(id_col).cast("long"), common.text_or_empty(text_col))
    combined = rows.mapInArrow(common.tidy(_combine(owners, hold_bytes)), COMBINED)
    folder = common.local_path(common.new_folder(spark, "extendible-hash"))
    return combined.repartitionById(owners, F.col("owner")).mapInArrow(common.tidy(_own(folder)), GROUPS)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Every row of ``df`` with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal texts the row with the largest id
    stays; a null id is smaller than any other.  If rows repeat that id, exactly one of them stays.  An empty table
    gives an empty result.  Columns of ``df`` named like an added one are replaced.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    groups = common.written(exact_groups(df, id_col, text_col, owners), "exact-groups")
    tied = bool(groups.filter("ties > 1").limit(1).count())
    rows = df.drop(*[c for c in added if c not in (id_col, text_col)])
    inner = [c for c in rows.columns if c not in (id_col, text_col)]
    packed = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in inner] or [F.lit(0).alias("_none")]).alias("_rest"))
    packed = packed.withColumn("text_sha256", F.sha2(common.text_or_empty("_text"), 256))
    joined = packed.join(groups, "text_sha256", "left")
    last = F.col("_id").eqNullSafe(F.col("keep_id"))
    if tied:
        joined = joined.withColumn("_n", F.monotonically_increasing_id())
        joined = joined.withColumn("_n", F.row_number().over(Window.partitionBy("text_sha256", "_id").orderBy("_n")))
        last = last & (F.col("_n") == 1)
    return joined.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), *[F.col(f"_rest.`{c}`") for c in inner], "keep_id", "group_size", last.alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
