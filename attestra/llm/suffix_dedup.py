"""Dedup of long repeated passages with run-length compressed Burrows-Wheeler indexes.

One index of a whole corpus does not fit a task, so texts are cut where they can match.  Any 50 bytes hold an anchor, the
20 bytes of least hash among their 31, and equal strings have equal anchors.  Such a string also holds the 15 bytes before
or the 15 bytes after its anchor; these extended anchors are put in a bit map of fixed size when they occur twice or more
in the corpus.  The bytes around an anchor with a marked extension, its context, hold every 50-byte string that it
anchors.  Contexts meet by anchor; distinct contexts, each with the least document it comes from, are put in run-length
indexes block by block and streamed through them, which tells for each 50-byte string of a context the least document
where it starts.  Occurrences of contexts then learn which of their strings start in a smaller document.

Contexts are made distinct inside each partition before they are shuffled, so a passage that a third of all rows share
is one row a partition; occurrences and answers meet in a join that the adaptive skew join can split.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretokens import Powers, _mixed
from .run_length_index import RunLengthIndex
from .shingles import finish

LONG = 50  # bytes of a repeated string
ANCHOR = 20
SPAN = LONG - ANCHOR + 1  # anchors in such a string
CHUNK = 1 << 20  # bytes whose anchors are found at once
CACHED = 1 << 15  # of them, in arrays that a processor's cache holds
SIDE = (LONG - ANCHOR) // 2  # one side of the anchor has so many bytes of the string or more
MAP_BITS = 28  # the anchors' bit map has 2**28 bits, 32 MB, for any input; more set bits only send more contexts
BLOCK = 1 << 17  # bytes of contexts in an index
NONE = np.iinfo(np.int64).min

_powers = Powers()
_values, _others = _mixed(np.arange(256)), _mixed(np.arange(256, 512))


def _sliding(x: np.ndarray, f) -> np.ndarray:
    """f over SPAN = 31 neighbours from each place on."""
    m = x
    for step in (1, 2, 4, 8):
        m = f(m[:-step], m[step:])
    return f(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])


class Anchors:
    """The anchors of a few texts laid end to end, as flat arrays.

    ``text``: which text; ``at``: place in ``raw``; ``begin`` and ``end``: the text's bounds there; ``hash``, and the hashes
    with the bytes before and with those after, 0 where the text is too short.  Texts of fewer than LONG bytes have none.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        if n < LONG:
            self.text = self.at = self.begin = self.end = np.zeros(0, np.int64)
            self.hash = self.before = self.after = np.zeros(0, np.uint64)
            return
        self.up, self.down = _powers.get(n + 1)
        self.sums = _sums(raw, self.up, _values)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        crossing = (ends[:-1, None] - np.arange(LONG - 1, 0, -1)).ravel()  # windows that run into the next text
        crossing = np.sort(crossing[crossing >= 0])
        found = [self._in_block(a, min(a + CACHED, n - ANCHOR + 1), n, crossing) for a in range(0, n - ANCHOR + 1, CACHED)]
        self.at, self.hash = (np.concatenate([f[k] for f in found]) for k in range(2))
        at = self.at
        self.text = np.searchsorted(ends, at, "right")
        self.end = ends[self.text]
        self.begin = self.end - sizes[self.text]
        self.before, self.after = _sides(self.sums, self.down, at, self.begin, self.end)

    def _in_block(self, a: int, b: int, n: int, crossing: np.ndarray):
        """(places, hashes) of the anchors from a to b; a window's least hash is its anchor."""
        lo, hi = max(0, a - SPAN + 1), min(n - ANCHOR + 1, b + SPAN - 1)
        h = finish((self.sums[lo + ANCHOR : hi + ANCHOR] - self.sums[lo:hi]) * self.down[lo:hi]) | np.uint64(1)
        low = np.zeros(b - a + SPAN - 1, np.uint64)  # of the windows that hold places from a to b, none at the ends
        skip, starts = SPAN - 1 - (a - lo), hi - lo - SPAN + 1
        if starts > 0:
            low[skip : skip + starts] = _sliding(h, np.minimum)
            cross = crossing[np.searchsorted(crossing, lo) : np.searchsorted(crossing, lo + starts)]
            low[skip + cross - lo] = 0
        at = np.flatnonzero(_sliding(low, np.maximum) == h[a - lo : b - lo])
        return at + a, h[at + (a - lo)]

    def keep(self, on: np.ndarray) -> None:
        for name in ("text", "at", "begin", "end", "hash", "before", "after"):
            setattr(self, name, getattr(self, name)[on])

    def contexts(self):
        """(first places, sizes, 64-bit keys, other 32-bit hashes) of the bytes around each anchor."""
        if not len(self.at):
            return self.at, self.at, self.hash, np.zeros(0, np.int32)
        first = np.maximum(self.begin, self.at - (LONG - ANCHOR))
        last = np.minimum(self.end, self.at + LONG)
        key = finish((self.sums[last] - self.sums[first]) * self.down[first] + self.hash)
        other = _sums(self.raw, self.up, _others)
        check = finish((other[last] - other[first]) * self.down[first] + (last - first).astype(np.uint64))
        return first, last - first, key, (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sums(raw: np.ndarray, up: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    for a in range(0, len(raw), CACHED):
        part = values[raw[a : a + CACHED]]
        part *= up[a : a + len(part)]
        np.cumsum(part, out=part)
        np.add(part, sums[a], out=sums[a + 1 : a + 1 + len(part)])
    return sums


def _sides(sums, down, at, begin, end) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of anchors with the SIDE bytes before them, and with those after; 0 where there are not so many."""
    a, b = np.maximum(at - SIDE, 0), np.minimum(at + ANCHOR + SIDE, len(sums) - 1)
    before = np.where(at - SIDE >= begin, finish((sums[at + ANCHOR] - sums[a]) * down[a]), 0)
    after = np.where(at + ANCHOR + SIDE <= end, finish((sums[b] - sums[at]) * down[at] + np.uint64(1)), 0)
    return before, after


def _chunks(texts: list[bytes]):
    """(number of texts before, Anchors) for as many texts at once as CHUNK bytes hold."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, Anchors(texts[first : i + 1])
            first, size = i + 1, 0
    if first < len(texts):
        yield first, Anchors(texts[first:])


def _texts(batch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _dealt(ranges: int):
    """Extended anchors' hashes (at most twice each) of a block of texts, sorted, cut into ranges: (range, hashes)."""

    def give(held):
        values, times = np.unique(np.concatenate(held), return_counts=True)
        values = np.repeat(values, np.minimum(times, 2))
        cut = np.searchsorted(values, np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1))
        parts = [(r, p.tobytes()) for r, p in enumerate(np.split(values, cut)) if len(p)]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["range", "hashes"])

    def run(batches):
        held, size = [], 0
        for batch in common.slices(batches):
            for _, found in _chunks(_texts(batch, 0)):
                held += [found.before[found.before > 0], found.after[found.after > 0]]
                size += 2 * len(found.at)
                if size > 2_000_000:
                    yield give(held)
                    held, size = [], 0
        if held:
            yield give(held)

    return run


def _marked(folder: str, ranges: int):
    """Writes the slice of the bit map of each range: extended anchors that occur twice or more."""
    width = (1 << MAP_BITS) // ranges

    def run(batches):
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(r, []).append(raw)
        for r, raws in parts.items():
            values = np.sort(np.frombuffer(b"".join(raws), np.uint64))
            twice = values[1:][values[1:] == values[:-1]]
            mask = np.zeros(width, bool)
            mask[(twice >> np.uint64(64 - MAP_BITS)).astype(np.int64) - r * width] = True
            common.publish(f"{folder}/{r}", lambda out, mask=mask: out.write(np.packbits(mask, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32())], names=["range"])

    return run


def shared_anchors(texts: DataFrame) -> tuple[str, int]:
    """(folder, ranges) of the bit map: a file for each range, in the shared folder; 2**MAP_BITS / 8 bytes in all."""
    spark = texts.sparkSession
    ranges = 1 << max(6, (common.owners_for(spark) - 1).bit_length())
    folder = common.local_path(common.new_folder(spark, "anchors"))
    dealt = texts.mapInArrow(common.tidy(_dealt(ranges)), "range int, hashes binary")
    dealt.repartitionById(ranges, F.col("range")).mapInArrow(common.tidy(_marked(folder, ranges)), "range int").count()
    return folder, ranges


_maps: dict[str, np.ndarray] = {}


def _map(folder: str, ranges: int) -> np.ndarray:
    """The bit map; a worker keeps the last one."""
    if folder not in _maps:
        _maps.clear()
        width = (1 << MAP_BITS) // ranges // 8
        mask = np.zeros(ranges * width, np.uint8)
        for r in range(ranges):
            if os.path.exists(f"{folder}/{r}"):
                mask[r * width : (r + 1) * width] = np.fromfile(f"{folder}/{r}", np.uint8)
        _maps[folder] = mask
    return _maps[folder]


def _shared(texts: list[bytes], mask: np.ndarray):
    """``_chunks`` with the marked anchors alone."""

    def marked(h: np.ndarray) -> np.ndarray:
        bit = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return ((mask[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1) & (h > 0)

    for first, found in _chunks(texts):
        found.keep(marked(found.before) | marked(found.after))
        yield first, found


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _binary(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """body[first : first + size] of each pair as an Arrow array, by one gather."""
    ends = np.cumsum(size)
    data = body[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


CONTEXT = "anchor long, key long, check int, context binary, at int, least long, greatest long"
CONTEXT_NAMES = ["anchor", "key", "check", "context", "at", "least", "greatest"]


def _distinct(place: tuple[str, int]):
    """The contexts of a partition, each once a chunk: anchor, key, check, bytes, the anchor's place, least and greatest
    document."""

    def run(batches):
        mask = _map(*place)
        for batch in common.slices(batches):
            ids = batch.column(0).fill_null(NONE).to_numpy()
            for start, found in _shared(_texts(batch, 1), mask):
                first, size, key, check = found.contexts()
                order = np.lexsort((check, key))
                k, c = key[order], check[order]
                cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(k)])
                if not len(cut):
                    continue
                doc = ids[start + found.text[order]]
                one = order[cut]
                columns = [_signed(found.hash[one]), _signed(key[one]), pa.array(check[one]), _binary(found.raw, first[one], size[one]), pa.array((found.at - first)[one].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.minimum.reduceat(doc, cut)), pa.array(np.maximum.reduceat(doc, cut))], names=CONTEXT_NAMES)

    return run


def _answers(batches):
    """Of contexts sorted by (anchor, key, check): the least document of each 50-byte string, where it matters.

    A context that shares no extended anchor with another of its anchor shares no string with it either: its strings'
    least document is its own.  The others go through indexes.  ``least`` has one number if it holds for all strings,
    else one for each.
    """

    def rows(key, check, least: pa.Array):
        return pa.RecordBatch.from_arrays([_signed(key), pa.array(check), least], names=["key", "check", "least"])

    def answered(table):
        anchor, key, check = (table.column(i).to_numpy() for i in range(3))
        same = (anchor[1:] == anchor[:-1]) & (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        cut = np.flatnonzero(np.r_[True, ~same])
        least = np.minimum.reduceat(table.column(5).to_numpy(), cut)
        greatest = np.maximum.reduceat(table.column(6).to_numpy(), cut)
        anchor, key, check = anchor[cut], key[cut].view(np.uint64), check[cut]
        bodies = table.column(3).combine_chunks().take(pa.array(cut))
        bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies
        texts = bodies.to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        up, down = _powers.get(len(raw) + 1)
        at = ends - sizes + table.column(4).to_numpy()[cut]
        met = np.zeros(len(cut), bool)
        for side in _sides(_sums(raw, up, _values), down, at, ends - sizes, ends):
            _, where, times = np.unique(side, return_inverse=True, return_counts=True)
            met |= (times[where] > 1) & (side > 0)
        one = np.flatnonzero(~met & (least < greatest) & (sizes >= LONG))
        if len(one):
            yield rows(key[one], check[one], _binary(least.view(np.uint8), one * 8, np.full(len(one), 8)))
        # of the others, groups by anchor in which documents differ, in blocks of whole groups
        met = np.flatnonzero(met)
        if not len(met):
            return
        group = np.cumsum(np.r_[0, anchor[met][1:] != anchor[met][:-1]])
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        differ = np.minimum.reduceat(least[met], start) < np.maximum.reduceat(greatest[met], start)
        met, group = met[differ[group]], group[differ[group]]
        if not len(met):
            return
        total = np.cumsum(sizes[met])
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        block = (np.r_[0, total[start[1:] - 1]] // BLOCK)[np.cumsum(np.r_[0, group[1:] != group[:-1]])]
        for part in np.split(met, np.flatnonzero(block[1:] != block[:-1]) + 1):
            index = RunLengthIndex([texts[i] for i in part.tolist()], least[part], LONG)
            found, base, windows = index.flat_stream()
            full = np.flatnonzero(windows > 0)
            if not len(full):
                continue
            low, high = np.minimum.reduceat(found, base[full]), np.maximum.reduceat(found, base[full])
            told = low < greatest[part[full]]
            width = np.where(low == high, 1, windows[full])[told]
            who = part[full[told]]
            if len(who):
                yield rows(key[who], check[who], _binary(found.view(np.uint8), base[full[told]] * 8, width * 8))

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < 40_000 or batch.column(0)[0] == batch.column(0)[-1]:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        anchor = whole.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield from answered(whole.slice(0, cut).combine_chunks())
        held, count = [whole.slice(cut)], len(anchor) - cut
    if held:
        yield from answered(pa.concat_tables(held).combine_chunks())


def _occurrences(place: tuple[str, int]):
    """(key, check, row, document, place, size) of every marked context."""

    def run(batches):
        mask = _map(*place)
        for batch in common.slices(batches):
            ids, names = batch.column(0).fill_null(NONE).to_numpy(), batch.column(2).to_numpy()
            for start, found in _shared(_texts(batch, 1), mask):
                first, size, key, check = found.contexts()
                text = start + found.text
                columns = [_signed(key), pa.array(check), pa.array(names[text]), pa.array(ids[text]), pa.array((first - found.begin).astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "check", "row", "doc", "begin", "size"])

    return run


def _spans(batches):
    """(row, begin, end) of the bytes covered by strings that start in a smaller document."""
    for batch in batches:
        row, doc, begin, size = (batch.column(i).to_numpy() for i in range(4))
        if not len(row):
            continue
        least = batch.column(4)
        offsets = np.frombuffer(least.buffers()[1], np.int32)[least.offset : least.offset + len(least) + 1].astype(np.int64)
        value = np.frombuffer(least.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
        first, width = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
        one = (width == 1) & (value[first] < doc)
        rows, begins, ends = [row[one]], [begin[one]], [begin[one] + size[one]]
        # strings of the others, all together: runs of strings that start in a smaller document, no further apart than LONG
        many = np.flatnonzero(width > 1)
        if len(many):
            w = width[many]
            owner, at = np.repeat(many, w), np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            on = value[np.repeat(first[many], w) + at] < doc[owner]
            owner, at = owner[on], at[on]
            if len(at):
                new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > LONG)]
                a, b = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
                rows.append(row[owner[a]])
                begins.append(begin[owner[a]] + at[a])
                ends.append(begin[owner[a]] + at[b] + LONG)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(begins).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], names=["row", "begin", "end"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches):
    for batch in common.slices(batches):
        rows = []
        for t, spans in zip(_texts(batch, 1), batch.column(2).to_pylist(), strict=True):
            runs = merged([(s["begin"], s["end"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(t[at:a])
                at = b
            kept.append(t[at:])
            rows.append((runs, b"".join(kept)))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        spans = pa.array([[{"begin": a, "end": b} for a, b in r] for r, _ in rows], kind)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in r) for r, _ in rows], pa.int64()), spans, pa.array([k for _, k in rows], pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, n_bytes, n_removed, spans (maximal removed runs, in bytes) and kept, the
    remaining bytes (or, with ``digest``, kept_sha256 in its place; then texts without repeats are never shuffled).

    Null texts count as empty; texts of fewer than 50 bytes lose nothing.  Rows that repeat an id never match each other,
    for neither id is smaller; a null id is smaller than any other.  An empty table gives an empty result.  Other columns
    are not read.  A text is handled as a whole, however long, in some 100 bytes of memory a byte.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    place = shared_anchors(docs.select("text"))
    owners = common.owners_for(df.sparkSession)
    contexts = docs.mapInArrow(common.tidy(_distinct(place)), CONTEXT)
    dealt = contexts.repartition(owners, "anchor").sortWithinPartitions("anchor", "key", "check")
    answers = dealt.mapInArrow(common.tidy(_answers), "key long, check int, least binary")
    common.release(df.sparkSession)  # the anchors' shuffle
    answers = common.written(answers, "repeated-strings")
    del contexts, dealt
    common.release(df.sparkSession)  # the contexts' shuffle
    named = docs.select("id", "text", F.xxhash64("id", "text").alias("row"))
    found = named.mapInArrow(common.tidy(_occurrences(place)), "key long, check int, row long, doc long, begin int, size int").join(answers, ["key", "check"])
    spans = found.select("row", "doc", "begin", "size", "least").mapInArrow(common.tidy(_spans), "row long, begin int, end int")
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = common.written(spans, "repeated-spans")
    del found
    common.release(df.sparkSession)
    joined = named.join(spans.hint("shuffle_hash"), "row", "left").select("id", "text", "spans")
    out = "id long, n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary"
    rows = joined.mapInArrow(common.tidy(_removed), out)
    if digest:
        rows = rows.select("id", "n_bytes", "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_passages(common.documents(spark, sf_dir), digest=True)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
