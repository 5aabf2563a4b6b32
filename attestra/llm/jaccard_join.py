"""N-gram Jaccard join with count-vector R-trees.

Shingles are hashed into groups and a set becomes the point of its group counts; two sets share at most the sum over
groups of the smaller count.  An R-tree over such points keeps, for each node, the largest count of every group and the
least and greatest set size, so a whole subtree is passed over when even its summed minima with the query's counts stay
below what a link needs.  Pairs that survive, whatever their sizes, are verified on the sets themselves, made again from
the texts with another hash function; sets that agree under the first one are equal only if they agree under both.

A single tree cannot be spread over a cluster, so sets are first dealt into blocks, each with a tree of its own.  A link
needs overlap of at least 3/4 of either set, so two linked sets share one of their first n - ceil(3n/4) + 1 shingles in
any common order (shingles of very many documents last, then by hash).  Each of these shingles is a block: no link is
lost.  The trees of a task's blocks are a forest that all its sets probe together, level by level.

Before that, equal sets are collapsed, and each set is verified against the leader of its minhash bands that it shares
most bands with, one pair a set.  Trees then look only for pairs of sets that are not connected yet.  Texts that share a
long passage make very many pairs that just miss a link, so pairs of short sets are not handed out:
their trees name the groups of sets that such pairs connect, a group's sets meet once, whatever the number of its blocks,
and give a spanning forest of their links, fewer rows than there are sets.  Pairs with a set of more than ``LONG``
shingles are handed out and verified one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import finish, shingle_sets

GROUPS, MOST_GROUPS = 64, 1024  # of a tree's boxes, and of a point at most
FULL = 15  # counts are kept in four bits; what a group holds beyond is counted apart
BINS, ROWS = 36, 3  # one-permutation minhash bins, and bins in a band
PERCENT = 75
COMMON_SHARE = 0.0003  # shingles of more than this share of rows come last in the order
FILTER_BITS = 1 << 26  # of the broadcast filter, whatever the input; more set bits only let more rows through
LEAF, FAN = 4, 8
PAIRS = 1 << 16  # bounds that are computed at once
WIDE = 64  # sets of a block that are all compared by size and room
LONG = 512  # shingles of a set that is not sent to its groups: its pairs are verified one by one
TILE, COLUMNS = 1024, 8192  # sets, and shingles, whose products are in memory at once
NONE = np.iinfo(np.int64).min


def linked(overlap, a, b):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 100 * overlap >= PERCENT * (a + b - overlap)


def least_overlap(a, b):
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def count_vector(s: np.ndarray) -> bytes:
    """Counts in about a quarter as many groups as the set has shingles, two in a byte."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << (max(len(s) - 1, 1) // 4).bit_length()))
    count = np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)
    return (count[0::2] | count[1::2] << 4).tobytes()


class Points:
    """Count vectors of different lengths: a matrix for each length, and all of them folded to GROUPS groups."""

    def __init__(self, vectors: list[bytes], sizes: np.ndarray, room: np.ndarray | None = None):
        length = np.fromiter(map(len, vectors), np.int64, len(vectors))
        self.groups, self.row, self.matrix = length * 2, np.zeros(len(vectors), np.int64), {}
        self.folded = np.zeros((len(vectors), GROUPS), np.int32)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            raw = np.frombuffer(b"".join([vectors[i] for i in at.tolist()]), np.uint8).reshape(len(at), n)
            counts = np.empty((len(at), 2 * n), np.uint8)
            counts[:, 0::2], counts[:, 1::2] = raw & FULL, raw >> 4
            self.matrix[2 * n], self.row[at] = counts, np.arange(len(at))
            self.folded[at] = self._fold(counts, GROUPS)
        self.sizes = sizes
        self.room = sizes if room is None else room  # at most so many shingles can be shared in this block
        self.over = sizes - self.folded.sum(1)  # shingles beyond full counts: they may meet any others

    @staticmethod
    def _fold(counts: np.ndarray, groups: int) -> np.ndarray:
        return counts if counts.shape[1] == groups else counts.reshape(len(counts), -1, groups).sum(1, dtype=np.int32)

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most so many shingles do the sets i and j share, in as many groups as both have."""
        out = np.empty(len(i), np.int64)
        kind = self.groups[i] << 16 | self.groups[j]
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            x, y, groups = self.matrix[k >> 16], self.matrix[k & 0xFFFF], min(k >> 16, k & 0xFFFF)
            for part in np.array_split(at, len(at) * groups // (PAIRS * GROUPS) + 1):
                a, b = self._fold(x[self.row[i[part]]], groups), self._fold(y[self.row[j[part]]], groups)
                out[part] = np.minimum(a, b).sum(1, dtype=np.int64)
        return out + self.over[i] + self.over[j]


class CountForest:
    """R-trees over the points of many blocks, bulk-loaded and searched level by level.

    A block's points are ordered by size window, fullest group and size; LEAF to a leaf, FAN nodes to a parent, up to one
    root a block.  ``opened`` counts the nodes whose boxes were compared with a probe.
    """

    def __init__(self, block: np.ndarray, keys: np.ndarray, points: Points):
        sizes = points.sizes
        window = (np.log(sizes) / np.log(100 / PERCENT)).astype(np.int64)
        self.order = np.lexsort((keys, sizes, points.folded.argmax(1), window, block))
        self.points, self.sizes, self.block = points, sizes[self.order], block[self.order]
        self.levels, self.opened = [], 0
        level = (np.arange(len(block)), self.block, points.folded[self.order], self.sizes, self.sizes, points.over[self.order], points.room[self.order])
        width = LEAF
        while True:
            first, blocks, tops, least, most, over, room = level
            starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            place = np.arange(len(blocks)) - np.repeat(starts, np.diff(np.r_[starts, len(blocks)]))
            cut = np.flatnonzero(place % width == 0)
            level = (first[cut], blocks[cut], np.maximum.reduceat(tops, cut, axis=0), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(over, cut), np.maximum.reduceat(room, cut))
            self.levels.append((*level, np.r_[cut, len(blocks)]))  # last: where each node's children begin
            if len(cut) == len(starts):
                break
            width = FAN

    def search(self, wanted: np.ndarray, part: np.ndarray):
        """(i, j, bound): pairs of points of one block, but of different parts, that may be linked; each pair once, where
        its later point is in ``wanted``."""
        place_of = np.empty(len(self.order), np.int64)
        place_of[self.order] = np.arange(len(self.order))
        roots = np.searchsorted(self.levels[-1][1], self.block[place_of[wanted]])
        spread = np.bincount(self.block - self.block[0])[self.block[place_of[wanted]] - self.block[0]]
        slice_of = np.cumsum(spread) // (8 * PAIRS)
        for k in np.unique(slice_of).tolist():
            at = slice_of == k
            found = self._descend(wanted[at], place_of[wanted[at]], roots[at], part)
            if len(found[0]):
                yield found

    def _descend(self, probe, place, node, part):
        p = self.points
        for first, _, tops, least, most, over, room, child in reversed(self.levels):
            size = p.sizes[probe]
            fit = (first[node] < place) & (least[node] * PERCENT <= size * 100) & (size * PERCENT <= most[node] * 100)
            fit &= np.minimum(p.room[probe], room[node]) >= least_overlap(size, least[node])
            probe, place, node = probe[fit], place[fit], node[fit]
            self.opened += len(node)
            keep = np.zeros(len(node), bool)
            for a in range(0, len(node), PAIRS):
                i, k = probe[a : a + PAIRS], node[a : a + PAIRS]
                bound = np.minimum(p.folded[i], tops[k]).sum(1) + p.over[i] + over[k]
                keep[a : a + PAIRS] = bound >= least_overlap(p.sizes[i], least[k])
            probe, place, node = probe[keep], place[keep], node[keep]
            width = child[node + 1] - child[node]
            at = np.cumsum(width) - width
            node = np.repeat(child[node] - at, width) + np.arange(int(width.sum()))
            probe, place = np.repeat(probe, width), np.repeat(place, width)
        other = self.order[node]
        a, b = p.sizes[probe], p.sizes[other]
        fit = (node < place) & (part[probe] != part[other]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * PERCENT)
        fit &= np.minimum(p.room[probe], p.room[other]) >= least_overlap(a, b)
        probe, other = probe[fit], other[fit]
        bound = p.bound(probe, other)
        fit = bound >= least_overlap(p.sizes[probe], p.sizes[other])
        return probe[fit], other[fit], bound[fit]


# ------------------------------------------------------------------ per document


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _bands(s: np.ndarray) -> list[int]:
    edge = np.searchsorted(s, (np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)))
    last = np.append(edge[1:], len(s))
    low = np.where(edge < last, s[np.minimum(edge, len(s) - 1)], 0)
    out = []
    for i in range(0, BINS, ROWS):
        part = low[i : i + ROWS]
        if part.any():
            out.append(xxhash.xxh3_64_intdigest(part.tobytes(), seed=i + 1))
    return out


def _texts(batch) -> list[bytes]:
    return batch.column(1).cast(pa.binary()).to_pylist()


PROFILE = "id long, n long, set_id long, check long, counts binary, bands array<long>, common long, times long"

NAMES = ["id", "n", "set_id", "check", "counts", "bands", "common", "times"]


class Keys:
    """Names of sets: 64 bits of the first hash function, and of the second as well where ``shared`` says that two sets have
    the former in common."""

    def __init__(self, shared: list[int] = ()):
        self.shared = frozenset(shared)

    def of(self, s: np.ndarray, other) -> int:
        """``other``: gives the set under the second hash function, when it is needed."""
        key = set_key(s)
        if not self.shared:
            return key
        signed = int(_signed(key))
        return int(np.int64(signed ^ int(_signed(set_key(other())))).view(np.uint64)) if signed in self.shared else key


def _profile(share: float, block_docs: int):
    """A row for each document, and rows (common, times) for the shingles that a block of documents repeats most."""

    def out(ids, sets, others):
        filled = [s if len(s) else None for s in sets]
        checks = [int(_signed(set_key(s))) if len(s) else None for s in others]
        keys = [None if s is None else int(_signed(set_key(s))) for s in filled]
        counts = [None if s is None else count_vector(s) for s in filled]
        bands = [[] if s is None else _signed(np.array(_bands(s), np.uint64)).tolist() for s in filled]
        empty = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(counts, pa.binary()), pa.array(bands, pa.list_(pa.int64())), empty, empty], names=NAMES)

    def frequent(held, docs):
        values, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= max(4, share * docs)
        k = int(often.sum())
        no = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([no, no, no, no, pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.array(_signed(values[often])), pa.array(times[often], pa.int64())], names=NAMES)

    def run(batches):
        held, docs, size = [], 0, 0
        for batch in common.slices(batches):
            texts = _texts(batch)
            sets = shingle_sets(texts)
            yield out(batch.column(0), sets, shingle_sets(texts, family=1))
            held += sets
            docs, size = docs + len(sets), size + sum(map(len, sets))
            if docs >= block_docs or size >= 3_000_000:
                yield frequent(held, docs)
                held, docs, size = [], 0, 0
        if size:
            yield frequent(held, docs)

    return run


def _prefixes(common_hashes: bytes, names: Keys):
    """(shingle, set, n, room) of every document's first n - ceil(3n/4) + 1 shingles; common ones last, rarest first.

    ``room``: the set's shingles from this one on.  Two sets whose first common shingle this is share no more."""
    last = np.frombuffer(common_hashes, np.uint64)  # in order
    by_hash = np.argsort(last)
    sorted_last = last[by_hash]

    def first(s: np.ndarray) -> np.ndarray:
        k = len(s) + (-PERCENT * len(s) // 100) + 1
        if not len(last):
            return s[:k]
        at = np.minimum(np.searchsorted(sorted_last, s), len(last) - 1)
        often = sorted_last[at] == s
        rare = s[~often]
        if len(rare) >= k:
            return rare[:k]
        return np.concatenate([rare, last[np.sort(by_hash[at[often]])]])[:k]

    def run(batches):
        seen: set[int] = set()
        for batch in common.slices(batches):
            sigs, keys, sizes, rooms = [], [], [], []
            texts = _texts(batch)
            for text, s in zip(texts, shingle_sets(texts), strict=True):
                if not len(s):
                    continue
                key = names.of(s, lambda text=text: shingle_sets([text], family=1)[0])
                if key in seen:  # an equal set of this partition has been dealt
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                head = first(s)
                sigs.append(head)
                keys.append(np.full(len(head), key, np.uint64))
                sizes.append(np.full(len(head), len(s), np.int32))
                rooms.append(np.arange(len(s), len(s) - len(head), -1, np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sigs))), pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rooms))], names=["sig", "set_id", "n", "room"])

    return run


def _shared(batches):
    """Of rows sorted by (sig, n, set): each once, where some other set of the sig has a size and a room that can link.

    Sets of a sig that has more than ``WIDE`` of them all pass; no more than that are held back.
    """
    names = ["sig", "set_id", "n", "room"]

    def partnered(rows):
        if not len(rows[0]):
            return np.zeros(0, bool)
        sig, _, n, room = (x.astype(np.int64) for x in rows)
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        width = np.diff(np.r_[start, len(sig)])
        keep = np.repeat(width > WIDE, width)
        for step in range(1, WIDE):
            same = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(same):
                break
            i, j = same, same + step
            fit = (n[i] * 100 >= n[j] * PERCENT) & (np.minimum(room[i], room[j]) >= least_overlap(n[i], n[j]))
            keep[i[fit]] = keep[j[fit]] = True
        return keep

    held, passing, before = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        new = np.r_[before != (rows[0][0], rows[1][0]), (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
        rows = [x[new] for x in rows]
        sig = rows[0]
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig, sig[-1]))  # the last sig may go on
        keep = partnered([x[:cut] for x in rows])
        if passing is not None:  # and the first sig may be the rest of a wide one
            keep[: int(np.searchsorted(sig[:cut], passing, "right"))] = True
        if sig[-1] == passing or len(sig) - cut > WIDE:
            keep, passing, before, held = np.r_[keep, np.ones(len(sig) - cut, bool)], sig[-1], (sig[-1], rows[1][-1]), None
        else:
            held, before = [x[cut:] for x in rows], None
        yield pa.RecordBatch.from_arrays([pa.array(x[: len(keep)][keep]) for x in rows], names=names)
    if held is not None:
        keep = partnered(held)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in held], names=names)


# ------------------------------------------------------------------ candidates and links


def _whole_blocks(batches, most_rows: int = 100_000):
    """Column lists of batches sorted by their first column, sig, cut so that no block is split."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        sig = held[-1].column(0)
        if sig[0] == sig[-1] == held[0].column(0)[0] or sum(x.num_rows for x in held) < most_rows:
            continue  # the block may go on
        whole = pa.concat_tables(held).combine_chunks()
        sig = whole.column(0).to_numpy()
        cut = int(np.searchsorted(sig, sig[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _candidates(batches):
    """Of blocks, rows sorted by sig: what the trees cannot rule out between sets of different components.

    Rows (group, a, null): short set ``a`` is in a group of a block's short sets that such pairs connect; a group is named
    by its sets, so that blocks with the same group give the same rows.  Rows (null, a, b): a pair with a long set.
    """
    names = ["group", "a", "b"]
    for table in _whole_blocks(batches):
        sig, keys, sizes, room, comps = (table.column(i).to_numpy().astype(np.int64) for i in range(5))
        block = np.cumsum(np.r_[False, sig[1:] != sig[:-1]])
        forest = CountForest(block, keys, Points(table.column(5).to_pylist(), sizes, room))
        root, pairs = {}, set()

        def find(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j, _ in forest.search(np.arange(len(sig)), comps):
            short = (sizes[i] <= LONG) & (sizes[j] <= LONG)
            pairs.update(zip(keys[i[~short]].tolist(), keys[j[~short]].tolist(), strict=True))
            for x, y in zip(i[short].tolist(), j[short].tolist(), strict=True):
                root[find(root.setdefault(x, x))] = find(root.setdefault(y, y))
        groups: dict[int, list[int]] = {}
        for x in root:
            groups.setdefault(find(x), []).append(x)
        rows = set()
        for members in groups.values():
            own = np.sort(keys[members])
            rows.update((xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), k) for k in own.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
        a, b = ([p[k] for p in pairs] for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)


def _places(bodies: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place in ``values``, sorted, and set) of each shingle that is there; the number of sets."""
    where = np.repeat(np.arange(len(bodies)), np.fromiter(map(len, bodies), np.int64, len(bodies)))
    flat = np.concatenate(bodies)
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    there = values[at] == flat
    at, where = at[there], where[there]
    order = np.argsort(at, kind="stable")
    return at[order], where[order], len(bodies)


def _overlaps(rows, columns, width: int) -> np.ndarray:
    """How many shingles each set of ``rows`` shares with each of ``columns``: products of 0/1 matrices."""
    both = np.zeros((rows[2], columns[2]), np.float32)
    for low in range(0, width, COLUMNS):
        grids = []
        for at, where, n in (rows, columns):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            grid = np.zeros((n, min(COLUMNS, width - low)), np.float32)
            grid[where[a:b], at[a:b] - low] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    return both


def _forest_links(batches):
    """Of groups, rows (group, set_id, component, body) sorted by group: a spanning forest of each group's links between
    components, compared on whole sets, a tile of them at a time."""
    for table in _whole_blocks(batches, 2_000):
        sig, keys, comps = (table.column(i).to_numpy().astype(np.int64) for i in range(3))
        bodies = [np.frombuffer(x, np.uint64) for x in table.column(3).to_pylist()]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        links: set = set()
        for at, end in zip(first.tolist(), np.r_[first[1:], len(sig)].tolist(), strict=True):
            sizes = np.fromiter(map(len, bodies[at:end]), np.int64, end - at)
            root = np.unique(comps[at:end], return_inverse=True)[1]
            for a in range(0, end - at, TILE):
                values = np.unique(np.concatenate(bodies[at + a : min(at + a + TILE, end)]))
                rows = _places(bodies[at + a : min(at + a + TILE, end)], values)
                for b in range(a, end - at, TILE):
                    columns = rows if a == b else _places(bodies[at + b : min(at + b + TILE, end)], values)
                    both = _overlaps(rows, columns, len(values))
                    i, j = np.nonzero(linked(both, sizes[a : a + TILE, None], sizes[None, b : b + TILE]))
                    i, j = i + a, j + b
                    fresh = (i < j) & (root[i] != root[j])
                    for x, y in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
                        if root[x] != root[y]:
                            root[root == root[y]] = root[x]
                            links.add((int(keys[at + x]), int(keys[at + y])))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in range(2)], names=["u", "v"])


def _sets_of(bits: bytes, names: Keys):
    """(set_id, set under the second hash function) of the rows whose id passes the filter; no other text is split."""
    mask = np.frombuffer(bits, np.uint8)

    def run(batches):
        for batch in common.slices(batches):
            bit = _bit(batch.column(0).fill_null(NONE).to_numpy(), len(mask) * 8)
            texts = _texts(batch.filter(pa.array((mask[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))))
            rows = [(names.of(s, lambda x=x: x), x) for s, x in zip(shingle_sets(texts), shingle_sets(texts, family=1), strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(_signed([r[0] for r in rows])), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["set_id", "body"])

    return run


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (finish(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)


def filter_bits(ids: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit map of ids, made in slices by the executors; its size is fixed by ``bits``."""
    slices = 64

    def own(batches):
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bit(batch.column(0).fill_null(NONE).to_numpy(), bits)
            for part in np.unique(at * slices // bits).tolist():
                mask = marks.setdefault(part, np.zeros(bits // slices, bool))
                mask[at[at * slices // bits == part] - part * (bits // slices)] = True
        for part, mask in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(mask, bitorder="little").tobytes()])], names=["part", "mask"])

    def merge(batches):
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mask = np.frombuffer(raw, np.uint8)
                marks[part] = marks[part] | mask if part in marks else mask
        for part, mask in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mask.tobytes()])], names=["part", "mask"])

    made = ids.mapInArrow(common.tidy(own), "part int, mask binary").repartition(min(slices, common.owners_for(ids.sparkSession)), "part").mapInArrow(common.tidy(merge), "part int, mask binary")
    whole = bytearray(bits // 8)
    for row in made.collect():  # at most bits / 8 bytes
        at = row.part * (bits // slices // 8)
        whole[at : at + len(row.mask)] = row.mask
    return bytes(whole)


def passes(bits: bytes, ids):
    """A column: whether an id, never null, may be among those of ``filter_bits``; false is sure."""
    mask = np.frombuffer(bits, np.uint8)

    @F.arrow_udf("boolean")
    def found(ids: pa.Array) -> pa.Array:
        bit = _bit(ids.to_numpy(zero_copy_only=False), len(mask) * 8)
        return pa.array((mask[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))

    return found(ids)


def _verify(batches):
    """Rows (hub, salt, role, set_id, body), a hub's own row before the sets that are compared with it: the links."""
    held = None
    for batch in common.slices(batches):
        out = []
        for hub, salt, role, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(body, np.uint64)
            if not role:
                held = hub, salt, x
            elif held and held[:2] == (hub, salt):
                x, y = (x, held[2]) if len(x) <= len(held[2]) else (held[2], x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if linked(int((y[at] == x).sum()), len(x), len(y)):
                    out.append((key, hub))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["u", "v"])


class _Join:
    """One run of the join: what its steps share."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession
        self.owners = common.owners_for(self.spark)
        # a third of all rows may be one set: minima are combined before the shuffle
        self.profile = common.written(docs.mapInArrow(common.tidy(_profile(COMMON_SHARE, 8192)), PROFILE), "profiles")
        self.names = Keys()
        self.nodes = self._nodes()
        # of n sets, some n * n / 2**65 share 64 bits with another; they are named anew
        met = [r.set_id for r in self.nodes.filter("check != other").select("set_id").collect()]
        if met:
            self.names = Keys(met)
            anew = F.when(F.col("set_id").isin(met), F.col("set_id").bitwiseXOR(F.col("check"))).otherwise(F.col("set_id"))
            self.profile = self.profile.withColumn("set_id", anew)
            self.nodes = self._nodes()
        self.links = self.spark.createDataFrame([], "u long, v long")
        self.comps = None

    def _nodes(self) -> DataFrame:
        sets = self.profile.filter("set_id is not null").groupBy("set_id")
        sets = sets.agg(F.min("id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("counts").alias("counts"), F.first("bands").alias("bands"), F.min("check").alias("check"), F.max("check").alias("other"))
        return common.written(sets, "sets")

    def _sets(self, keys: DataFrame) -> DataFrame:
        """(set_id, body) of ``keys`` and a few others, from the texts."""
        reps = self.nodes.join(keys, "set_id", "left_semi").select("rep")
        return self.docs.mapInArrow(common.tidy(_sets_of(filter_bits(reps), self.names)), "set_id long, body binary")

    def verified(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) that are links.  A set is the ``a`` of a few pairs and may be the ``b``, the hub, of very many;
        a hub's pairs are salted with ``a``, and its set is sent to the tasks that need it."""
        pairs = pairs.select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.lit(self.owners)).alias("salt"))
        roles = pairs.select(F.col("a").alias("set_id"), "hub", "salt", F.lit(1).alias("role"))
        roles = roles.unionByName(pairs.select(F.col("hub").alias("set_id"), "hub", "salt", F.lit(0).alias("role")).distinct())
        sets = roles.join(self._sets(roles.select("set_id").distinct()), "set_id").select("hub", "salt", "role", "set_id", "body")
        dealt = sets.repartition(self.owners, "hub", "salt").sortWithinPartitions("hub", "salt", "role")
        self.links = self.links.unionByName(common.written(dealt.mapInArrow(common.tidy(_verify), "u long, v long"), "links"))

    def connect(self) -> None:
        self.comps = common.written(components(self.links), "components")
        common.release(self.spark)

    def placed(self) -> DataFrame:
        """set_id, component, and the other columns of ``nodes``."""
        if self.comps is None:
            return self.nodes.withColumn("component", F.col("set_id"))
        return self.nodes.join(self.comps.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))

    def stars(self) -> None:
        """Verify each set against the one of its bands' leaders that it shares most bands with.

        A band has two leaders, the sets of least and of greatest key.  Sets that share less than a quarter of their bands
        are left to the trees.
        """
        rows = self.nodes.select("set_id", "n", F.size("bands").alias("bands"), F.explode("bands").alias("band"))
        ends = rows.groupBy("band").agg(F.min(F.struct("set_id", "n")).alias("lo"), F.max(F.struct("set_id", "n")).alias("hi")).filter("lo.set_id != hi.set_id")
        near = rows.join(ends, "band").select("set_id", "n", "bands", F.explode(F.array("lo", "hi")).alias("end"))
        fits = (F.least("n", "end.n") * 100 >= F.greatest("n", "end.n") * PERCENT) & (F.col("set_id") != F.col("end.set_id"))
        shared = near.filter(fits).groupBy("set_id", F.col("end.set_id").alias("b")).agg(F.count("*").alias("times"), F.first("bands").alias("bands")).filter("4 * times >= bands")
        best = shared.groupBy("set_id").agg(F.max(F.struct("times", "b")).alias("best"))
        self.verified(common.written(best.select(F.col("set_id").alias("a"), F.col("best.b").alias("b")), "star-pairs"))
        self.connect()

    def blocks(self) -> None:
        total = self.profile.filter("common is null").count()
        often = self.profile.filter("common is not null").groupBy("common").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(4.0, COMMON_SHARE * total))
        # at most the mean set size / COMMON_SHARE shingles can be that common
        last = [r.common for r in often.orderBy("times", "common").collect()]
        body = np.array(last, np.int64).tobytes()
        rows = "sig long, set_id long, n int, room int"
        dealt = self.docs.mapInArrow(common.tidy(_prefixes(body, self.names)), rows)
        shared = dealt.repartition(self.owners, "sig").sortWithinPartitions("sig", "n", "set_id").mapInArrow(common.tidy(_shared), rows)
        self.shared = common.written(shared, "blocks")
        del dealt, shared
        common.release(self.spark)

    def trees(self) -> None:
        """Add the links between components that the blocks' trees find."""
        rows = self.shared.join(self.placed().select("set_id", "component"), "set_id").repartition(self.owners, "sig")
        mixed = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("sig")
        rows = common.written(rows.join(mixed, "sig", "left_semi"), "mixed-blocks")
        points = rows.join(self.nodes.select("set_id", "counts"), "set_id").select("sig", "set_id", "n", "room", "component", "counts")
        found = points.repartition(self.owners, "sig").sortWithinPartitions("sig").mapInArrow(common.tidy(_candidates), "group long, a long, b long")
        found = common.written(found, "candidates")
        del rows, mixed, points
        common.release(self.spark)
        pairs = found.filter("b is not null").select("a", "b").distinct()
        if not pairs.isEmpty():
            self.verified(pairs)
        short = found.filter("b is null").select("group", F.col("a").alias("set_id")).distinct()
        sets = self._sets(short.select("set_id").distinct()).dropDuplicates(["set_id"])
        short = short.join(self.placed().select("set_id", "component"), "set_id").join(sets, "set_id").select("group", "set_id", "component", "body")
        links = short.repartition(self.owners, "group").sortWithinPartitions("group").mapInArrow(common.tidy(_forest_links), "u long, v long")
        self.links = self.links.unionByName(common.written(links.distinct(), "links"))
        self.connect()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id (least id reachable by links, itself included).

    A null or empty text, or one without words, has an empty set and is linked with nothing.  Rows that repeat an id are
    compared as texts of their own.  Null ids are never a component's least id; a component of null ids only has null.
    An empty table gives an empty result.  Other columns are not read.  A text is split as a whole, however long, in some
    40 bytes of memory a byte.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("text"))
    join = _Join(docs)
    join.stars()
    join.blocks()
    join.trees()
    sets = join.placed().select("set_id", "rep", "component")
    least = sets.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = sets.join(least, "component").select("set_id", "component_id")
    rows = join.profile.filter("common is null").select("id", "n", "set_id").join(named, "set_id", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(common.documents(spark, sf_dir))
