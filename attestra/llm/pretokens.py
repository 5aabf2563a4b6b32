"""Byte-level BPE text splitting and word caches, vectorised over many documents.

The split is the public byte-level pattern: contractions, an optional space with letters, numbers or other characters,
and runs of white space of which the last character goes with what follows.  Its boundaries depend on the classes of
neighbouring characters only, so they are found by comparing shifted class arrays rather than by a regex engine.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np

OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 9
CHUNK = 1 << 19  # characters handled at once; a longer document is a chunk of its own


def class_table(tokenizer_json: str) -> bytes:
    """The class of every code point as the library's own splitter sees it, compressed; built once on the driver."""
    from tokenizers.pre_tokenizers import ByteLevel

    one = lambda text, split=ByteLevel(add_prefix_space=False).pre_tokenize_str: len(split(text)) == 1
    kinds = {LETTER: "a", NUMBER: "1", OTHER: "!"}
    # surrogates, which no text has, stay OTHER; the library may know code points that this Python has not assigned yet
    table = np.zeros(0x110000, np.uint8)
    for at in [*range(0, 0xD800, 256), *range(0xE000, 0x110000, 256)]:
        block = [chr(c) for c in range(at, at + 256)]
        same = next((k for k, x in kinds.items() if one(x + "".join(block))), None)
        table[at : at + 256] = [next((k for k, y in kinds.items() if one(y + x)), SPACE) for x in block] if same is None else same
    return zlib.compress(table.tobytes(), 1)


def byte_chars() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, after = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in names:
            names[b], after = chr(after), after + 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """What the operators need of a byte-level BPE file: token bytes by id, merges by rank, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec.get("normalizer") and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if not plain or odd:
            raise ValueError(f"not a plain byte-level BPE: {odd or spec['pre_tokenizer']}")
        back = {ord(c): b for b, c in enumerate(byte_chars())}
        to_bytes = lambda s: bytes(back[ord(c)] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.labels = [b""] * self.size
        for s, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.labels[i] = s


_STEP = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)  # odd, and 1 less has two low zero bits only
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


class Powers:
    """Powers of the hash step and of its inverse, as long as the longest chunk so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            grow = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
            self.up, self.down = grow(_STEP), grow(_BACK)
        return self.up, self.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def token_starts(cp: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where tokens start in ``cp``, code points of texts laid end to end; ``first``: where each (non-empty) text starts."""
    n = len(cp)
    cls = table[cp]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, cls[:-1]
    before[first] = EDGE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, cls[1:]
    after[first[1:] - 1] = EDGE
    space = cls == SPACE
    blank = cp == 0x20
    glued = np.zeros(n, bool)  # the character before is a space that goes with this one
    glued[1:] = blank[:-1]
    glued &= before == SPACE
    # a white-space run starts a token at its first character, and at its last one if text follows
    run_end = (after != SPACE) & (after != EDGE)
    start = np.where(space, (before != SPACE) | run_end, (before != cls) & ~glued)
    mark = np.flatnonzero((cp == 0x27) & start)
    if len(mark):
        ends = np.append(first[1:], n)
        room = ends[np.searchsorted(first, mark, "right") - 1] - mark
        at = lambda k: np.where(room > k, cp[np.minimum(mark + k, n - 1)], 0)
        a, b = at(1), at(2)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(two, 2, np.where(three, 3, 0))
        mark, size, room = mark[size > 0], size[size > 0], room[size > 0]
        start[mark + 1] = False
        more = room > size
        start[(mark + size)[more]] = True
    return np.flatnonzero(start)


class WordCache:
    """Ids of words: found by 64-bit hash in sorted arrays, then compared with the words themselves.

    Code points of the words on file lie in one buffer.  A word that meets another one's hash is encoded by itself, so
    results never rest on a hash.  The buffers hold ``most`` code points and as many ids; then the cache starts anew.
    """

    def __init__(self, encode_words: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 6_000_000):
        self.encode_words, self.most = encode_words, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n, self.text_at, self.text_n = (np.zeros(0, np.int32) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint32), 0

    def places(self, hashes: np.ndarray, cp: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: str) -> tuple[np.ndarray, np.ndarray]:
        """(offset in ``flat``, number of ids) of the words cp[start:stop], which follow one another."""
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.text_used > self.most or self.used > self.most:
            self._clear()
        slot = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[slot] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            self._add(unique[new], cp, start[where[new]], stop[where[new]], whole)
            slot = np.searchsorted(self.keys, unique)
        slot = slot[inverse]
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        size = stop - start
        other = self.text_n[slot] != size
        # every code point against the one on file; words of another length are compared as far as they fit the buffer
        from_ = np.repeat(self.text_at[slot] - start, size) + np.arange(start[0], stop[-1])
        differs = self.text[np.minimum(from_, len(self.text) - 1)] != cp[start[0] : stop[-1]]
        other |= np.logical_or.reduceat(differs, start - start[0])
        met = np.flatnonzero(other)
        if len(met):
            words = [whole[a:b] for a, b in zip(start[met].tolist(), stop[met].tolist(), strict=True)]
            distinct = list(dict.fromkeys(words))
            place = dict(zip(distinct, zip(*self._file(self.encode_words(distinct)), strict=True), strict=True))
            at[met], n[met] = [place[w][0] for w in words], [place[w][1] for w in words]
        return at, n

    def _file(self, ids: Sequence[Sequence[int]]) -> tuple[list[int], list[int]]:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        self.flat = _room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter((x for w in ids for x in w), np.uint32, total)
        at = self.used + np.cumsum(n) - n
        self.used += total
        return at.tolist(), n.tolist()

    def _add(self, keys: np.ndarray, cp: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: str) -> None:
        at, n = self._file(self.encode_words([whole[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]))
        size = stop - start
        total = int(size.sum())
        text_at = np.cumsum(size) - size
        self.text = _room(self.text, self.text_used + total)
        self.text[self.text_used : self.text_used + total] = cp[np.repeat(start - text_at, size) + np.arange(total)]
        text_at += self.text_used
        self.text_used += total
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.at, self.n = np.insert(self.at, spot, at), np.insert(self.n, spot, n)
        self.text_at, self.text_n = np.insert(self.text_at, spot, text_at), np.insert(self.text_n, spot, size)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, longer if it has fewer than ``n`` places."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x) // 2, n - len(x)), x.dtype)])


class BatchEncoder:
    """Token ids of many texts; ``encode_words`` gives the ids of distinct pre-split words."""

    def __init__(self, vocabulary: Vocabulary, classes: bytes, encode_words):
        self.table = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.added = vocabulary.added
        self.cache, self.powers = WordCache(encode_words), Powers()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned 32-bit integers."""
        return [ids for part in self.parts(texts) for ids in part]

    def parts(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The same, for as many texts at once as CHUNK characters hold."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            yield self._chunk(texts[i:j])
            i = j

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        if not any(special in t for special in self.added for t in texts):
            return self._plain(texts)
        pieces, plan = [], []
        for t in texts:  # texts that spell an added token: its id stands between the ids of the pieces around it
            parts: list[str | int] = [t]
            for special, number in self.added.items():
                parts = [y for x in parts for y in ([x] if isinstance(x, int) else [z for k, p in enumerate(x.split(special)) for z in ([number, p] if k else [p])])]
            plan.append([(len(pieces), pieces.append(p))[0] if isinstance(p, str) else ~p for p in parts])
        ids = self._plain(pieces)
        return [np.concatenate([ids[k] if k >= 0 else np.array([~k], np.uint32) for k in ks]) for ks in plan]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32) for _ in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = (ends - sizes)[sizes > 0]
        start = token_starts(cp, first, self.table)
        up, down = self.powers.get(len(cp) + 1)
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_mixed(cp) * up[: len(cp)], out=sums[1:])
        stop = np.append(start[1:], len(cp))
        hashes = (sums[stop] - sums[start]) * down[start]
        at, n = self.cache.places(hashes, cp, start, stop, whole)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])
        total = int(before[-1])
        ids = self.cache.flat[np.repeat(at - before[:-1], n) + np.arange(total)]
        bounds = before[np.searchsorted(start, ends - sizes)], before[np.searchsorted(start, ends)]
        return [ids[a:b] for a, b in zip(*bounds, strict=True)]
