"""Token counts by rank-synchronous merging of arrays.

Texts are split into pre-tokens, of which those not seen before are laid end to end as a ragged array of byte symbols.
In each step every sequence merges all pairs of its own lowest rank at once (of overlapping ones every second from the
left), for all sequences together; a sequence without a mergeable pair leaves, and what it has left is its count.  This is
what merging one pair at a time gives, as a merge never makes a pair of a lower rank than its own: the parts of a merge
are made by earlier ones, which the table checks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe_automaton import tokenizer_path
from .pretokens import CHUNK, Vocabulary, class_table, token_starts

NONE = np.int32(2**31 - 1)  # rank of a pair that no merge joins
MOST = 200_000  # words a worker keeps the counts of, each of KEPT characters at most; it starts anew beyond
KEPT = 64


class Merges:
    """Pairs of symbols in one sorted array, with rank and product."""

    def __init__(self, vocabulary: Vocabulary):
        left, right, made = (np.array(x, np.int64) for x in zip(*vocabulary.merges, strict=True)) if vocabulary.merges else (np.zeros(0, np.int64) for _ in range(3))
        rank = np.arange(len(made))
        born = np.full(vocabulary.size, len(made))
        self.byte = np.array([vocabulary.ids[bytes([b])] for b in range(256)], np.int64)
        born[self.byte] = -1
        if len(np.unique(made)) < len(made) or (born[made] < 0).any():
            raise ValueError("two merges make one token")
        born[made] = rank
        if len(made) and (np.maximum(born[left], born[right]) >= rank).any():
            raise ValueError("a merge comes before one that makes its parts")
        self.size, self.made = vocabulary.size, made
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(rank[order].astype(np.int32), NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def survivors(self, body: bytes, sizes: np.ndarray) -> np.ndarray:
        """The number of symbols that each sequence of bytes is left with; ``body`` has them end to end."""
        counts, rows = sizes.copy(), np.flatnonzero(sizes > 1)
        symbols = self.byte[np.frombuffer(body, np.uint8)[np.repeat(sizes > 1, sizes)]]
        sizes = sizes[rows]
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = NONE
        while len(rows):
            low = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            live = low != NONE
            if not live.all():
                counts[rows[~live]] = sizes[~live]
                stay = np.repeat(live, sizes)
                symbols, rank, rows, sizes, low = symbols[stay], rank[stay], rows[live], sizes[live], low[live]
                if not len(rows):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            nth = np.arange(len(at))
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) != 1
            if not head.all():  # a pair that overlaps the one before it: every second of such a run is merged
                at = at[(nth - np.maximum.accumulate(np.where(head, nth, 0))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            sizes = sizes - np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(sizes))
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, rank = symbols[stay], rank[stay]
            at = at - np.arange(len(at))  # where the products are now; only their pairs are new
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            rank[at[last[at]]] = NONE
            new = np.concatenate([at, at[at > 0] - 1])
            new = new[~last[new]]
            rank[new] = self.rank(symbols[new], symbols[new + 1])
        return counts


class Counter:
    """Tokens of texts; a worker keeps it, with the counts of words that it has met, for its next tasks."""

    def __init__(self, path: str, classes: bytes):
        vocabulary = Vocabulary(path)
        self.merges = Merges(vocabulary)
        self.table = np.frombuffer(zlib.decompress(classes), np.uint8)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token spelt in a text is one."""
        total = np.zeros(len(texts), np.int64)
        owners: list[int] = []
        pieces: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            parts = self.added.split(text) if self.added else [text]
            total[i] += len(parts) - 1
            for part in parts:
                for piece in cut(part):
                    if pieces and size + len(piece) > CHUNK:
                        self._chunk(pieces, owners, total)
                        owners, pieces, size = [], [], 0
                    if piece:
                        owners.append(i)
                        pieces.append(piece)
                        size += len(piece)
        if pieces:
            self._chunk(pieces, owners, total)
        return total

    def _chunk(self, pieces: list[str], owners: list[int], total: np.ndarray) -> None:
        whole = "".join(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        first = np.concatenate([[0], ends[:-1]])
        start = token_starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), first, self.table)
        edges = [*start.tolist(), len(whole)]
        words = [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(self.known) > MOST:
            self.known.clear()
        fresh = list({w for w in words if w not in self.known})
        found = self.known
        if fresh:
            coded = [w.encode() for w in fresh]
            counts = self.merges.survivors(b"".join(coded), np.fromiter(map(len, coded), np.int64, len(coded))).tolist()
            long = {w: n for w, n in zip(fresh, counts, strict=True) if len(w) > KEPT}
            self.known.update((w, n) for w, n in zip(fresh, counts, strict=True) if len(w) <= KEPT)
            found = self.known | long if long else self.known
        n = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
        np.add.at(total, owners, np.add.reduceat(n, np.searchsorted(start, first)))


_BEFORE_SPACE = re.compile(r"\S(?=[ \n])")


def cut(text: str, most: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of some ``most`` characters, cut before a blank or line end that follows another character: there a
    pre-token starts whatever stands on either side."""
    at = 0
    while len(text) - at > most:
        edge = _BEFORE_SPACE.search(text, at + most - 1)
        if not edge:
            break
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


_built: dict[str, Counter] = {}


def _counted(path: str, classes: bytes):
    def run(batches):
        if path not in _built:
            _built[path] = Counter(path, classes)
        for batch in common.slices(batches):
            n = _built[path].counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: bytes of the text in UTF-8, tokens, and whether these are more than
    ``limit``.

    A null or empty text has none.  Rows that repeat, or share an id, are counted each; an empty table gives an empty
    result; other columns, whatever their names, are not read.  A long text is counted in parts cut where a pre-token
    starts in any case, so memory follows CHUNK or the longest run without a blank, some 100 bytes a character.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(common.text_or_empty(text_col)).cast("long").alias("n_bytes"), common.text_or_empty(text_col).alias("text"))
    rows = rows.mapInArrow(common.tidy(_counted(path, class_table(path))), "id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), tokenizer_path())
