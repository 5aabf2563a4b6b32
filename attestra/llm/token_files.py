"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the documents of one id range, a frame for each document, in ascending order.  After the frames come two
skippable frames, which any zstandard decoder passes over: the document ids, and last the seek table of the public
seekable format: for each frame its compressed size, decompressed size and checksum (the low 32 bits of the frame's
XXH64), then the number of frames, a descriptor byte and the closing magic number.  A reader takes the last nine bytes,
the table, and then only the byte ranges of the documents asked for.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pretokens import BatchEncoder, Vocabulary, class_table

# Fixed values of the public formats: skippable frame magics (the seek table's and one for the ids) and the footer.
SEEK_FRAME, IDS_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
FOOT, DESCRIPTOR = 9, 0x80  # descriptor: entries have checksums


class TokenFileWriter:
    """Appends documents to an open binary file; memory grows by 20 bytes a document."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.known: list[bool] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        raw = tokens.astype("<u4").tobytes()
        if len(raw) >= 1 << 32:
            raise ValueError("a frame of the seekable format holds less than 4 GiB")
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)

    def finish(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes() + np.packbits(np.array(self.known, bool)).tobytes()
        table = np.array(self.entries, ENTRY).tobytes()
        foot = np.uint32(len(self.entries)).astype("<u4").tobytes() + bytes([DESCRIPTOR]) + np.array([SEEK_MAGIC], "<u4").tobytes()
        for magic, body in ((IDS_FRAME, ids), (SEEK_FRAME, table + foot)):
            self.out.write(np.array([magic, len(body)], "<u4").tobytes() + body)


class TokenFileReader:
    """Reads the seek table of a file, then any document by its place."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        size = self.file.seek(0, os.SEEK_END)
        foot = self._range(size - FOOT, FOOT)
        if int.from_bytes(foot[5:], "little") != SEEK_MAGIC or foot[4] != DESCRIPTOR:
            raise ValueError(f"{path}: no seek table with checksums at the end")
        n = int.from_bytes(foot[:4], "little")
        at = size - FOOT - n * ENTRY.itemsize
        self.entries = np.frombuffer(self._range(at, n * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        ids = self._range(int(self.starts[-1]) + 8, 8 * n + (n + 7) // 8)
        known = np.unpackbits(np.frombuffer(ids[8 * n :], np.uint8))[:n].astype(bool)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(ids[: 8 * n], "<i8"), known, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def read(self, place: int) -> np.ndarray:
        """The ids of one document; only its frame is read and its checksums are verified."""
        entry = self.entries[place]
        raw = self.unpack.decompress(self._range(int(self.starts[place]), int(entry["packed"])), max_output_size=max(1, int(entry["raw"])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"] or len(raw) != entry["raw"]:
            raise ValueError(f"frame {place} is damaged")
        return np.frombuffer(raw, "<u4")

    def close(self) -> None:
        self.file.close()


_encoders: dict[str, BatchEncoder] = {}


def _encoder(path: str, classes: bytes) -> BatchEncoder:
    """This worker's encoder: the tokenizers library encodes each distinct pre-split word, the cache repeats it."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        words = lambda ws: [e.ids for e in library.encode_batch_fast(ws, add_special_tokens=False)]
        _encoders[path] = BatchEncoder(Vocabulary(path), classes, words)
    return _encoders[path]


def _write(folder: str, path: str, classes: bytes, end_id: int):
    def run(batches):
        encoder, part = _encoder(path, classes), TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.tok.zst"
        docs = tokens = 0
        end = np.array([end_id], np.uint32)

        def body(out):
            nonlocal docs, tokens
            writer = TokenFileWriter(out)
            for batch in common.slices(batches):
                names = iter(batch.column(0).to_pylist())
                for part in encoder.parts(batch.column(1).to_pylist()):
                    for ids in part:
                        writer.add(next(names), np.append(ids, end))
                        docs, tokens = docs + 1, tokens + len(ids) + 1
            writer.finish()

        common.publish(name, body)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([tokens])], names=["part", "path", "docs", "tokens"])

    return run


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write the token files of ``df`` below ``folder``; a row for each file: part, path, docs, tokens, start.

    Files follow one another in ascending id order, a null id first; rows that repeat an id are ordered by their text's
    hash and their place, so that no key has to fit one file.  A null text counts as empty and gives the end id alone.
    An empty table gives no documents.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    order = ["id", "h", "n"]
    dealt = rows.repartitionByRange(parts or common.owners_for(spark), *order).sortWithinPartitions(*order).select("id", "text")
    files = dealt.mapInArrow(common.tidy(_write(common.local_path(folder), tokenizer, class_table(tokenizer), end_id)), "part int, path string, docs long, tokens long")
    files = common.written(files, "token-manifest")  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = TokenFileReader(path)
            rows: list[tuple] = []
            for place in range(len(reader)):
                ids = reader.read(place)
                rows.append((reader.ids[place], start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            reader.close()


def read_digests(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens and the ids' crc32 of every document, a task for a few files."""
    paths = files.select("path", "start").repartition(common.owners_for(files.sparkSession), "path")
    return paths.mapInArrow(common.tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import tokenizer_path

    files = write_token_files(common.documents(spark, sf_dir), tokenizer_path(), common.new_folder(spark, "token-files"))
    return read_digests(files)
