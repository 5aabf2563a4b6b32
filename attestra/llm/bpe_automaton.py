"""BPE encoding by a tokenization automaton, decoding by its arc labels.

Construction (one merge gadget after another, in rank order).  The automaton of no merges has one state with a loop for
every byte.  For the merge u v -> w: let q be where arcs labelled u lead.  If q has an arc labelled v, every state with an
arc u gets an arc w to where v leads, and all arcs u are moved to a copy of q that lacks v, so that u before v can no
longer be read apart.  All arcs of a label always lead to one state, so the automaton needs a target for each label, and
for each copied state its parent, the label it lacks and the merge that made it; whether a state has an arc follows from
these, and is filed in a transition table when first asked for.

The automaton accepts exactly one token sequence for a byte string, the BPE one.  So does it for every prefix: encoding
walks the word once, keeps for each byte position the single state reached there, and follows the arcs from it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretokens import BatchEncoder, Vocabulary, class_table

TABLE_ROWS = 300_000  # transitions on file at most, about 30 MB; the table starts anew beyond


class Automaton:
    def __init__(self, vocabulary: Vocabulary):
        size = vocabulary.size
        self.born, self.left = [-1] * size, [-1] * size
        self.target = [-1] * size  # -1: no arc has this label
        for b in range(256):
            self.target[vocabulary.ids[bytes([b])]] = 0
        self.parent, self.lacks, self.made = [-1], [-1], [-1]
        for rank, (u, v, w) in enumerate(vocabulary.merges):
            if self.target[w] >= 0:
                raise ValueError(f"two merges make token {w}")
            q = self.target[u]
            if q < 0 or self.target[v] < 0 or not self.has_arc(q, v):
                continue
            self.target[w], self.born[w], self.left[w] = self.target[v], rank, u
            self.parent.append(q)
            self.lacks.append(v)
            self.made.append(rank)
            self.target[u] = len(self.parent) - 1
        self.trie: dict = {}  # byte -> [token that ends here or -1, the next bytes]
        for label, token in vocabulary.ids.items():
            if self.target[token] >= 0:
                rest, node = self.trie, None
                for b in label:
                    node = rest.setdefault(b, [-1, {}])
                    rest = node[1]
                node[0] = token
        self.longest = max(map(len, vocabulary.ids))
        self.table: dict[int, bool] = {}

    def has_arc(self, state: int, token: int) -> bool:
        """A copy has its parent's arcs but one, and later merges add w wherever u is."""
        while True:
            born = self.born[token]
            while state and self.made[state] > born:
                if self.lacks[state] == token:
                    return False
                state = self.parent[state]
            if born < 0:
                return True
            token = self.left[token]

    def encode(self, word: bytes) -> list[int]:
        n, table, target = len(word), self.table, self.target
        if len(table) > TABLE_ROWS:
            table.clear()
        states, via = [0] + [-1] * n, [0] * (n + 1)
        back = [0] * (n + 1)
        trie, longest = self.trie, self.longest
        for s in range(n):
            state, rest, e = states[s], trie, s
            if state < 0:
                continue
            for b in word[s : s + longest]:
                node = rest.get(b)
                if node is None:
                    break
                e += 1
                token, rest = node
                if token < 0 or states[e] >= 0:
                    continue
                key = state << 20 | token
                arc = table.get(key)
                if arc is None:
                    arc = table[key] = self.has_arc(state, token)
                if arc:
                    states[e], via[e], back[e] = target[token], token, s
        out = []
        while n:
            out.append(via[n])
            n = back[n]
        return out[::-1]


_built: dict[str, tuple] = {}


class Labels:
    """Byte strings by id in one buffer; a run of ids is spelt with one gather."""

    def __init__(self, labels: list[bytes]):
        self.sizes = np.fromiter(map(len, labels), np.int64, len(labels))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.body = np.frombuffer(b"".join(labels), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        total = int(size.sum())
        return self.body[np.repeat(self.starts[ids] - at, size) + np.arange(total)].tobytes()


def _tools(path: str, classes: bytes):
    """This worker's encoder, arc labels and decimal numbers; a worker keeps them, and its cache of words, for its next
    tasks."""
    if path not in _built:
        vocabulary = Vocabulary(path)
        machine = Automaton(vocabulary)
        encoder = BatchEncoder(vocabulary, classes, lambda words: [machine.encode(w.encode()) for w in words])
        _built[path] = encoder, Labels(vocabulary.labels), Labels([b"%d," % i for i in range(vocabulary.size)])
    return _built[path]


def decode(ids, labels: Labels) -> str:
    """The arcs' labels one after another; bytes that are not UTF-8 become replacement characters."""
    return labels.spell(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def _encoded(path: str, classes: bytes, digests: bool):
    """Rows for a few texts at a time: memory holds one part of a batch, as flat arrays."""

    def run(batches):
        encoder, labels, decimal = _tools(path, classes)
        for batch in common.slices(batches):
            done = 0
            for part in encoder.parts(batch.column(1).to_pylist()):
                names = batch.column(0).slice(done, len(part))
                done += len(part)
                texts = [decode(ids, labels) for ids in part]
                if digests:
                    columns = [pa.array([len(ids) for ids in part], pa.int64()), pa.array([hashlib.sha256(decimal.spell(ids)[:-1]).hexdigest() for ids in part]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                    yield pa.RecordBatch.from_arrays([names, *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    bounds = np.concatenate([[0], np.cumsum([len(ids) for ids in part])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(part).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([names, ids, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row.

    A null or empty text has no ids and decodes to the empty text.  An added token spelt in a text becomes its id.  Rows
    that repeat are encoded alike; an empty table gives an empty result.  Other columns are not read.  A text is encoded
    as a whole, however long, in some 60 bytes of memory a character.
    """
    return _rows(df, id_col, text_col).mapInArrow(common.tidy(_encoded(path, class_table(path), False)), "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, as ``encode`` has them."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(df, id_col, text_col).mapInArrow(common.tidy(_encoded(path, class_table(path), True)), schema).withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), tokenizer_path())
