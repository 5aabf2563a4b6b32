"""Token counts against the library, and the merging kernel against merging one pair at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm import token_counts as tc
from attestra.llm.bpe_automaton import tokenizer_path
from attestra.llm.pretokens import Vocabulary, class_table

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, hard, small, library):
    df = hard.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = df.collect()
    want = [len(e) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    got = tc.token_counts(df.withColumn("n_tokens", F.lit("clash")), PATH, limit=50).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(((r.doc_id, len((r.text or "").encode()), n, n > 50) for r, n in zip(rows, want, strict=True)), key=key)


def odd_texts():
    r = random.Random(5)
    out = ["a" * n for n in (1, 2, 3, 4, 5, 7, 31, 1000)] + ["ab" * 500 + "a", "aab" * 300, "=" * 999, "the" * 400, " " * 700 + "x", "\n" * 300, "　 x   y z", "'" * 9 + "s't'll"]
    out += ["".join(r.choice("abcdef0123456789") for _ in range(5000)), "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "".join(r.choice("aAbB 'é\n\t") for _ in range(4000))]
    return out + ["<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "<|endoftext|>" * 50]


@pytest.mark.parametrize("chunk", [1 << 19, 64, 5])
def test_long_texts_in_parts(library, monkeypatch, chunk):
    monkeypatch.setattr(tc, "CHUNK", chunk)
    monkeypatch.setattr(tc.cut, "__defaults__", (chunk,))
    monkeypatch.setattr(tc, "MOST", 100)
    counter = tc.Counter(PATH, class_table(PATH))
    texts = odd_texts() + [" ".join(odd_texts())]
    assert counter.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all("".join(tc.cut(t, chunk)) == t for t in texts)


def test_kernel_merges_in_rank_order():
    """Small alphabets with nested and overlapping merges, against one merge at a time from the left."""
    r = random.Random(3)
    for _ in range(40):
        v = Vocabulary.__new__(Vocabulary)
        v.ids = {bytes([b]): b for b in range(256)}
        v.merges, v.added = [], {}
        while len(v.merges) < 12:
            a, b = r.choice([*b"ab", *range(256, 256 + len(v.merges))]), r.choice([*b"ab", *range(256, 256 + len(v.merges))])
            name = [k for k, i in v.ids.items() if i == a][0] + [k for k, i in v.ids.items() if i == b][0]
            if name not in v.ids:
                v.ids[name] = 256 + len(v.merges)
                v.merges.append((a, b, v.ids[name]))
        v.size = 256 + len(v.merges)
        order = {(a, b): (k, w) for k, (a, b, w) in enumerate(v.merges)}
        words = [bytes(r.choice(b"ab") for _ in range(r.choice([1, 2, 3, 9, 40]))) for _ in range(60)] + [b""]
        want = []
        for word in words:
            s = list(word)
            while pairs := [(order[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in order]:
                _, i = min(pairs)
                s[i : i + 2] = [order[s[i], s[i + 1]][1]]
            want.append(len(s))
        got = tc.Merges(v).survivors(b"".join(words), np.array(list(map(len, words))))
        assert got.tolist() == want
    v.merges = [(97, 300, 301), (97, 98, 300)]
    v.size = 302
    with pytest.raises(ValueError):
        tc.Merges(v)


def test_empty_table(empty):
    assert tc.token_counts(empty, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tc.token_counts(empty, PATH).count() == 0
