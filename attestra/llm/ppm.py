"""Language-model scoring: prediction by partial matching over a byte-context trie, beside a unigram base.

Training counts every (context, next byte) of ``ORDER`` preceding bytes over all training texts, A-Z lower-cased; a text is
preceded by ORDER start bytes 0xFE and followed by the end byte 0xFF, neither of which UTF-8 has.  Shorter contexts' counts
are sums of longer ones'.  The code length of a byte starts at the longest context that training has seen: a context gives
a byte its count over (total + distinct), and the escape to the next shorter context distinct over the same (method C);
bytes seen in the longer context are excluded from the shorter one's counts; behind the empty context all remaining bytes
are equally likely.

The trie is cut by the last two bytes of the context, so that a node and its suffixes of two bytes and more lie in one
shard; a bucket of shards is a file of sorted arrays in the shared folder that scoring tasks map into memory.  Contexts of
one and no byte are at most 65,792 counts and go to every task.  The unigram counts are files of the same kind, cut by
hash.  Tasks look up the distinct contexts and words of a block of texts, bucket by bucket, whatever the model's size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
START, END = 0xFE, 0xFF
SYMBOLS = 255  # every byte but the start byte
BLOCK = 4 << 20  # bytes of text counted or scored at once
FILE_ROWS = 2_000_000  # of a bucket of the trie or the word table
FIELD = np.uint64(8)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER context bytes and the byte that follows, as one number, of every byte and end; grams of each text)."""
    raw = np.frombuffer(b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    g = np.zeros(len(raw) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        g = g << FIELD | raw[k : k + len(g)]
    real = np.ones(len(g), bool)  # windows that start in one text and end in the next text's start bytes
    at = np.cumsum(n + ORDER)[:-1]
    for k in range(ORDER):
        real[at - ORDER + k] = False
    return g[real], n


def _blocks(batches, columns: int):
    """Lists of rows of about BLOCK bytes of text; texts as lower-cased bytes."""
    held, size = [], 0
    for batch in batches:
        texts = [t.lower() for t in batch.column(columns - 1).cast(pa.binary()).to_pylist()]
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns - 1)), texts, strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count(batches):
    """(gram, null, n) and (null, word, n) of each block; the end of a text is the empty word."""
    words: Counter = Counter()

    def give():
        keys = pa.array(list(words), pa.binary())
        n = pa.array(list(words.values()), pa.int64())
        words.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), keys, n], names=["gram", "word", "n"])

    for block in _blocks(batches, 1):
        texts = [t for (t,) in block]
        for t in texts:
            words.update(t.split())
        words[b""] += len(texts)
        if len(words) > 300_000:
            yield give()
        keys, n = np.unique(_grams(texts)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n, pa.int64())], names=["gram", "word", "n"])
    yield give()


def _bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two context bytes, spread by a multiplication."""
    shard = (gram >> FIELD) & np.uint64(0xFFFF)
    return ((shard * np.uint64(40503)) % np.uint64(65536) * np.uint64(buckets) // np.uint64(65536)).astype(np.int64)


def _shorter(keys: np.ndarray, n: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of contexts one byte shorter: the oldest byte is dropped and equal keys are added up."""
    short = keys & np.uint64(mask)
    order = np.argsort(short, kind="stable")
    short, n = short[order], n[order]
    first = np.r_[True, short[1:] != short[:-1]] if len(short) else np.zeros(0, bool)
    return short[first], np.add.reduceat(n, np.flatnonzero(first)) if len(short) else n


def _contexts(keys: np.ndarray, n: np.ndarray, below) -> tuple[np.ndarray, ...]:
    """(context, total, distinct, total of its bytes in the next shorter context) from sorted (context, byte) counts."""
    ctx = keys >> FIELD
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    distinct = np.diff(np.r_[first, len(ctx)])
    return ctx[first], np.add.reduceat(n, first), distinct, np.add.reduceat(below, first)


class Trie:
    """A bucket's arrays by order 4..2, and the dense counts of orders 1 and 0."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]], n1: np.ndarray, n0: np.ndarray):
        self.levels, self.n1, self.n0 = levels, n1, n0
        self.t1, self.d1 = n1.sum(1), (n1 > 0).sum(1)
        self.x1 = ((n1 > 0) * n0).sum(1)
        self.t0, self.d0 = int(n0.sum()), int((n0 > 0).sum())

    @staticmethod
    def build(keys: np.ndarray, n: np.ndarray, n1: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(keys, n, contexts, totals, distinct, excluded) for orders ORDER..2 from the longest grams' counts."""
        counts = [(keys, n)]
        for order in range(ORDER - 1, 1, -1):
            counts.append(_shorter(*counts[-1], (1 << 8 * (order + 1)) - 1))
        levels = []
        for i, (k, c) in enumerate(counts):
            order = ORDER - i
            short = k & np.uint64((1 << 8 * order) - 1)
            if order > 2:
                below = counts[i + 1][1][np.searchsorted(counts[i + 1][0], short)]
            else:
                below = n1[(short >> FIELD).astype(np.int64), (short & np.uint64(255)).astype(np.int64)]
            levels.append((k, c, *_contexts(k, c, below)))
        return levels

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after its context."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        ex_t, ex_d = np.zeros(len(grams)), np.zeros(len(grams))
        for order in range(ORDER, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            g = grams[at] & np.uint64((1 << 8 * (order + 1)) - 1)
            total, distinct, count, excluded = self._look(order, g)
            t, d = total - ex_t[at], distinct - ex_d[at]
            known = (total > 0) & (d > 0)  # else the context is new or has nothing left to tell
            hit = known & (count > 0)
            out[at[hit]] += np.log10(count[hit] / (t + d)[hit])
            miss = known & (count == 0)
            out[at[miss]] += np.log10(d[miss] / (t + d)[miss])
            open_[at[hit]] = False
            seen = total > 0
            ex_t[at[seen]], ex_d[at[seen]] = excluded[seen], distinct[seen]
        out[open_] -= np.log10(SYMBOLS - self.d0)
        return out

    def _look(self, order: int, g: np.ndarray):
        symbol, ctx = (g & np.uint64(255)).astype(np.int64), g >> FIELD
        if order == 0:
            return (np.full(len(g), float(self.t0)), np.full(len(g), float(self.d0)), self.n0[symbol].astype(float), np.zeros(len(g)))
        if order == 1:
            c = ctx.astype(np.int64)
            return tuple(x.astype(float) for x in (self.t1[c], self.d1[c], self.n1[c, symbol], self.x1[c]))
        keys, n, contexts, totals, distinct, excluded = self.levels[ORDER - order]
        if not len(keys):
            return tuple(np.zeros(len(g)) for _ in range(4))
        at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
        there = contexts[at] == ctx
        spot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return (*(np.where(there, x[at], 0).astype(float) for x in (totals, distinct)), np.where(keys[spot] == g, n[spot], 0).astype(float), np.where(there, excluded[at], 0).astype(float))


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    for i, a in enumerate(arrays):
        common.publish(f"{folder}/{name}-{i:02d}.npy", lambda out, a=a: np.save(out, a))


def _load(folder: str, name: str, n: int) -> list[np.ndarray]:
    return [np.load(f"{folder}/{name}-{i:02d}.npy", mmap_mode="r") for i in range(n)]


def _write_trie(folder: str, n1: np.ndarray):
    def run(batches):
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(keys)
        levels = Trie.build(keys[order], n[order], n1) if len(keys) else [tuple(np.zeros(0, np.uint64 if i in (0, 2) else np.int64) for i in range(6))] * (ORDER - 1)
        _save(folder, f"trie-{TaskContext.get().partitionId():06d}", [a for level in levels for a in level])
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["rows"])

    return run


def _write_words(folder: str):
    def run(batches):
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        if len(keys) and (keys[1:] == keys[:-1]).any():
            raise ValueError("two words have one hash: train with another seed")
        _save(folder, f"words-{TaskContext.get().partitionId():06d}", [keys, n])
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["rows"])

    return run


def _word_keys(seed: int):
    """(bucket by the hash's high bits is left to the caller) hash and count of each word."""

    def run(batches):
        for batch in batches:
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1), pa.array((keys >> np.uint64(40)).astype(np.int64))], names=["key", "n", "high"])

    return run


class Model:
    """Where a trained model lies, its sizes, and its short contexts."""

    def __init__(self, folder: str, tries: int, words: int, n1: np.ndarray, tokens: int, types: int, seed: int):
        self.folder, self.tries, self.words, self.n1 = folder, tries, words, n1
        self.tokens, self.types, self.seed = tokens, types, seed


def train(texts: DataFrame, text_col: str = "text", seed: int = 1) -> Model:
    """Count all of ``texts``.  Nulls count as empty texts; no texts give a model of equally likely bytes."""
    spark = texts.sparkSession
    folder = common.local_path(common.new_folder(spark, "ppm"))
    rows = texts.select(common.text_or_empty(text_col)).mapInArrow(common.tidy(_count), "gram long, word binary, n long")
    sums = common.written(rows.groupBy("gram", "word").agg(F.sum("n").alias("n")), "ppm-counts")
    grams, words = sums.filter("gram is not null").select("gram", "n"), sums.filter("word is not null").select("word", "n")
    n_grams = grams.count()
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n1 = np.zeros((256, 256), np.int64)
    for pair, n in grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        n1[pair >> 8, pair & 255] = n
    tries, files = max(1, -(-n_grams // FILE_ROWS)), max(1, -(-types // FILE_ROWS))
    shard = F.shiftrightunsigned("gram", 8).bitwiseAND(0xFFFF)
    bucket = F.floor((shard * 40503) % 65536 * tries / 65536).cast("int")
    grams.repartitionById(tries, bucket).mapInArrow(common.tidy(_write_trie(folder, n1)), "rows long").agg(F.sum("rows")).first()
    keyed = words.mapInArrow(common.tidy(_word_keys(seed)), "key long, n long, high long")
    keyed.repartitionById(files, F.floor(F.col("high") * files / (1 << 24)).cast("int")).select("key", "n").mapInArrow(common.tidy(_write_words(folder)), "rows long").agg(F.sum("rows")).first()
    return Model(folder, tries, files, n1, int(tokens), int(types), seed)


def _scores(model: Model):
    n0 = model.n1.sum(0)
    floor = model.tokens + 0.5 * (model.types + 1)

    def by_bucket(keys: np.ndarray, bucket: np.ndarray, buckets: int, look) -> np.ndarray:
        out = np.zeros(len(keys))
        for b in np.unique(bucket).tolist() if buckets > 1 else [0]:
            here = bucket == b
            out[here] = look(b, keys[here])
        return out

    def trie(b: int, grams: np.ndarray) -> np.ndarray:
        flat = _load(model.folder, f"trie-{b:06d}", 6 * (ORDER - 1))
        return Trie([tuple(flat[i : i + 6]) for i in range(0, len(flat), 6)], model.n1, n0).log10(grams)

    def word_counts(b: int, keys: np.ndarray) -> np.ndarray:
        table, n = _load(model.folder, f"words-{b:06d}", 2)
        if not len(table):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, n[at], 0)

    def run(batches):
        for block in _blocks(batches, 3):
            texts = [r[2] for r in block]
            grams, n = _grams(texts)
            keys, inverse = np.unique(grams, return_inverse=True)
            bits = by_bucket(keys, _bucket_of(keys, model.tries), model.tries, trie)[inverse]
            score = np.add.reduceat(bits, np.cumsum(n) - n)
            counted = [Counter(t.split()) for t in texts]
            for c in counted:
                c[b""] = 1
            words = list(set().union(*counted))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=model.seed) for w in words), np.uint64, len(words))
            order = np.argsort(hashes)
            sorted_ = hashes[order]
            bucket = ((sorted_ >> np.uint64(40)).astype(np.int64) * model.words) >> 24
            c = np.empty(len(words))
            c[order] = by_bucket(sorted_, bucket, model.words, word_counts)
            value, known = dict(zip(words, np.log10((c + 0.5) / floor).tolist(), strict=True)), {w for w, x in zip(words, c.tolist(), strict=True) if x > 0}
            rows = []
            for (i, out, _), d, s in zip(block, counted, score.tolist(), strict=True):
                rows.append((i, out, d.total(), sum(n for w, n in d.items() if w in known), model.tokens, sum(n * value[w] for w, n in d.items()), s))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the trie's log10 probability of the text and its end, ``base_score`` the unigram one of its words and
    end.  A null or empty text has the end alone.  Repeated rows score alike; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long"), held_out(id_col), common.text_or_empty(text_col))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(common.tidy(_scores(model)), schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs.filter(~held_out("doc_id"))))
