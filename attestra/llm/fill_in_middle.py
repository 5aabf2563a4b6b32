"""Fill-in-middle transformation of whole Arrow batches.

A batch's texts lie in one UTF-8 buffer.  Each byte gets its class from a table of 256 entries; a table of pairs of
classes says, for each two adjacent bytes, whether a unit starts at the second; the units are counted by one cumulative
sum, taken anew for each document by subtracting what it was before the document; and one binary search in that sum finds
the cuts of all rows together.  The pieces are then joined into one output buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 22  # bytes handled at once; a longer document is counted in blocks of so many
TAIL, BODY, SPACE, LINE, EDGE = range(5)  # classes of bytes; EDGE stands before a document's first byte
SENTINELS = ("<P>", "<S>", "<M>")  # fixed values: before prefix, suffix and middle


def byte_classes() -> np.ndarray:
    table = np.full(256, BODY, np.uint8)
    table[0x80:0xC0] = TAIL
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[0x0A] = LINE
    return table


def unit_pairs(unit: str) -> np.ndarray:
    """[class of the byte before, class of the byte]: whether a unit starts at the byte."""
    pairs = np.zeros((5, 5), bool)
    if unit == "char":
        pairs[:, [BODY, SPACE, LINE]] = True
    elif unit == "word":  # a word with the white space after it; white space before all words is a unit
        pairs[[SPACE, LINE], BODY] = True
    elif unit == "line":
        pairs[LINE, :] = True
    else:
        raise ValueError(f"no such unit: {unit!r}")
    pairs[EDGE, :] = True
    return pairs


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Raise if an output could spell a sentinel where none was put: then texts could not be rebuilt."""
    for x in sentinels:
        for y in sentinels:
            if not x or (x is not y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels overlap: {x!r}, {y!r}")


class Kernel:
    def __init__(self, unit: str, sentinels: tuple[str, str, str]):
        check_sentinels(sentinels)
        self.classes, self.pairs = byte_classes(), unit_pairs(unit)
        self.sentinels = [s.encode() for s in sentinels]

    def starts(self, data: np.ndarray, first: np.ndarray, before: int = EDGE) -> np.ndarray:
        """Where units start; ``first``: where documents start, ``before``: the class of the byte before ``data``."""
        cls = self.classes[data]
        previous = np.empty_like(cls)
        previous[0], previous[1:] = before, cls[:-1]
        previous[first] = EDGE
        return self.pairs[previous, cls]

    def spelt(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which documents contain a sentinel."""
        found = np.zeros(len(bounds) - 1, bool)
        for s in self.sentinels:
            at = np.flatnonzero(data[: max(len(data) - len(s) + 1, 0)] == s[0])
            for k, byte in enumerate(s[1:], 1):
                at = at[data[at + k] == byte]
            doc = np.searchsorted(bounds, at, "right") - 1
            found[doc[at + len(s) <= bounds[doc + 1]]] = True
        return found

    def cut(self, data: np.ndarray, bounds: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of units, [prefix, middle] ends in units, the same as places in ``data``) of each document.

        ``draws``: two numbers a document; the ends are their remainders modulo the number of units and one.
        """
        low, high = bounds[:-1], bounds[1:]
        if len(low) == 1 and high[0] - low[0] > CHUNK:
            return self._cut_long(data, draws)
        sums = np.cumsum(self.starts(data, low[high > low]), dtype=np.int32) if len(data) else np.zeros(1, np.int32)
        base = np.where(low > 0, sums[low - 1], 0).astype(np.int64)
        n = np.where(high > low, sums[high - 1] - base, 0)
        ends = np.sort(draws % (n + 1)[:, None], axis=1)
        places = np.searchsorted(sums, base[:, None] + ends + 1)
        return n, ends, np.where(ends < n[:, None], places, high[:, None])

    def _cut_long(self, data: np.ndarray, draws: np.ndarray):
        """One document, block by block, so that masks and sums are of one block only."""
        blocks = range(0, len(data), CHUNK)
        mask = lambda at: self.starts(data[at : at + CHUNK], np.zeros(0, np.int64), self.classes[data[at - 1]] if at else EDGE)
        sums = np.cumsum([np.count_nonzero(mask(at)) for at in blocks])
        n = int(sums[-1])
        ends = np.sort(draws[0] % (n + 1))
        places = []
        for k in ends.tolist():
            b = int(np.searchsorted(sums, k, "right"))
            places.append(len(data) if k == n else blocks[b] + int(np.flatnonzero(mask(blocks[b]))[k - (sums[b - 1] if b else 0)]))
        return np.array([n]), ends[None, :], np.array([places])

    def joined(self, data: np.ndarray, bounds: np.ndarray, places: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The outputs laid end to end, and their bounds."""
        body, (p, s, m) = memoryview(data), self.sentinels
        pieces: list = []
        for low, high, (a, b), whole, suffix_first in zip(bounds[:-1].tolist(), bounds[1:].tolist(), places.tolist(), plain.tolist(), spm.tolist(), strict=True):
            if whole:
                pieces.append(body[low:high])
            elif suffix_first:
                pieces += (s, body[b:high], p, body[low:a], m, body[a:b])
            else:
                pieces += (p, body[low:a], s, body[b:high], m, body[a:b])
        sizes = np.diff(bounds) + np.where(plain, 0, len(p) + len(s) + len(m))
        return b"".join(pieces), np.concatenate([[0], np.cumsum(sizes)])


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the bounds of its texts; no copy is made."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, body = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _transformed(unit: str, sentinels: tuple[str, str, str], plain_percent: int, spm_percent: int):
    def run(batches):
        kernel = Kernel(unit, sentinels)
        for batch in common.slices(batches):
            data, bounds = _buffer(batch.column(1))
            draws = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1)
            at = 0
            while at < batch.num_rows:  # as many texts as CHUNK bytes hold, one at least
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
                part, own = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
                n, ends, places = kernel.cut(part, own, draws[at:to, :2])
                plain = (n == 0) | kernel.spelt(part, own) | (draws[at:to, 2] % 100 >= 100 - plain_percent)
                spm = draws[at:to, 3] % 100 < spm_percent
                body, out = kernel.joined(part, own, places, plain, spm)
                texts = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(out.astype(np.int64)), pa.py_buffer(body)).cast(batch.column(1).type)
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                count = lambda x, plain=plain: pa.array(x.astype(np.int64), mask=plain)
                columns = [batch.column(0).slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), count(ends[:, 0]), count(ends[:, 1] - ends[:, 0]), texts]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_units", "middle_units", "output"])
                at = to

    return run


def draws_of(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of the SHA-256 of seed, colon and decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(df: DataFrame, seed: int = 1, unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output) of every row, n counting units: char, word or line.

    A text is plain if it is empty (null counts as empty), spells a sentinel, or is among ``plain_percent`` of a hundred
    draws; ``spm_percent`` of a hundred others have the suffix first.  Draws come from the id, so rows that repeat are
    transformed alike, and those with a null id draw alike.  An empty table gives an empty result; other columns, whatever
    their names, are not read.  Texts are cut whole: masks and sums of a text longer than CHUNK bytes are of CHUNK bytes at
    a time, and memory holds a long text with its output and nothing else that grows with it.
    """
    check_sentinels(sentinels)
    unit_pairs(unit)
    rows = df.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"), *draws_of(id_col, seed))
    schema = "id long, n long, form string, prefix_units long, middle_units long, output string"
    return rows.mapInArrow(common.tidy(_transformed(unit, sentinels, plain_percent, spm_percent)), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` was given, from its output and form alone; null if either is."""
    check_sentinels(sentinels)
    quoted = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in sentinels)
    parts = F.split(output, quoted, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
