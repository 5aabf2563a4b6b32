"""A run-length compressed Burrows-Wheeler index of many short texts, built and streamed with array operations.

Suffixes are ordered by prefix doubling; a text ends with a terminator smaller than any byte, terminators in text order.
The transform is kept as runs of equal symbols, cut also where two neighbouring suffixes stop sharing ``depth`` bytes, so
every run lies in one class of equal ``depth``-byte strings.  A run keeps its symbol, its start, the start's image under
last-to-first mapping, and a sample: the least owner of its suffixes.  The suffix array itself is dropped.

Streaming a text walks it backwards from its terminator by last-to-first mapping over the runs, all texts in step; at
each position the class of the run gives the matching statistic that is asked for: the least owner of any text in which
the same ``depth`` bytes start.
"""

from __future__ import annotations

import numpy as np

NOBODY = np.iinfo(np.int64).max
PACK = 4  # symbols of nine bits in the first key
PLACE = 21  # bits of a place that is sorted along with its key


def _ranks(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, dense rank) of keys; ``least`` bits hold every key.

    Where key and place fit one number, numbers are sorted, which is several times faster than sorting places by key.
    """
    n = len(keys)
    if least + PLACE <= 63 and n < 1 << PLACE:
        packed = keys << PLACE | np.arange(n)
        packed.sort()
        order, sorted_ = packed & ((1 << PLACE) - 1), packed >> PLACE
    else:
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


class RunLengthIndex:
    def __init__(self, texts: list[bytes], owners: np.ndarray, depth: int):
        if depth < PACK:
            raise ValueError(f"depth is at least {PACK}")
        self.depth, self.count = depth, len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        self.ends = np.cumsum(self.sizes + 1) - 1  # places of the terminators
        symbols[self.ends] = 0
        n = len(symbols)
        text_of = np.repeat(np.arange(self.count), self.sizes + 1)
        room = self.ends[text_of] - np.arange(n)  # symbols before the terminator
        key = np.zeros(n, np.int64)
        for k in range(PACK):
            at = np.minimum(np.arange(n) + k, n - 1)
            key = key << 9 | np.where(room >= k, symbols[at], 0)
        order, rank = _ranks(key, 9 * PACK)
        bits = n.bit_length()
        length, near = PACK, None
        longest = int(self.sizes.max(initial=0)) + 1
        while length < longest:
            if near is None and 2 * length > depth >= length:
                near = (length, rank)
            at = np.minimum(np.arange(n) + length, n - 1)
            second = np.where(room >= length, rank[at] + 1, 0)
            order, rank = _ranks(rank << bits | second, 2 * bits)
            length *= 2
        if near is None:
            near = (min(length, depth), rank)
        # equal suffixes of different texts stand in text order, as their terminators do: the sort is stable
        self._compress(order, symbols, room, near, owners[text_of])

    def _compress(self, order, symbols, room, near, owner) -> None:
        n = len(order)
        length, rank = near
        shift = self.depth - length
        full = room[order] >= self.depth
        head, tail = rank[order], rank[np.minimum(order + shift, n - 1)]
        same = np.zeros(n, bool)
        same[1:] = full[1:] & full[:-1] & (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])
        bwt = np.where(order > 0, symbols[np.maximum(order - 1, 0)], 0)
        first = ~same
        first[1:] |= bwt[1:] != bwt[:-1]
        self.start = np.flatnonzero(first)
        self.symbol = bwt[self.start]
        sizes = np.diff(np.r_[self.start, n])
        # image of a run's start: symbols before it in the alphabet, and equal ones before it in the transform
        by_symbol = np.argsort(self.symbol, kind="stable")
        image = np.empty(len(self.start), np.int64)
        image[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        self.image = image
        run_class = np.cumsum(~same[self.start]) - 1
        least = np.minimum.reduceat(owner[order], self.start)
        class_at = np.flatnonzero(np.r_[True, run_class[1:] != run_class[:-1]])
        best = np.minimum.reduceat(least, class_at)
        self.least = np.where(full[self.start], best[run_class], NOBODY)

    @property
    def runs(self) -> int:
        return len(self.start)

    def stream(self) -> list[np.ndarray]:
        """For each text and each position with ``depth`` bytes from it on: the least owner of these bytes."""
        out, _, windows = self.flat_stream()
        return np.split(out, np.cumsum(windows)[:-1]) if self.count else []

    def flat_stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same in one array, with each text's first place in it and number of positions."""
        windows = np.maximum(self.sizes - self.depth + 1, 0)
        base = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), NOBODY)
        row, left, text = np.arange(self.count), self.sizes.copy(), np.arange(self.count)
        run = np.searchsorted(self.start, row, "right") - 1
        while len(row):
            live = left > 0
            if not live.all():
                row, left, text, run = row[live], left[live], text[live], run[live]
                if not len(row):
                    break
            row = self.image[run] + (row - self.start[run])
            run = np.searchsorted(self.start, row, "right") - 1
            left = left - 1
            whole = left < windows[text]
            out[base[text[whole]] + left[whole]] = self.least[run[whole]]
        return out, base, windows
