"""Operators do the whole job on inputs that the given tables do not have."""

import hashlib
import math
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm import bpe_automaton, common, jaccard_join, source_mix, token_files
from attestra.llm.shingles import shingle_sets


# ------------------------------------------------------------------ source mix


def test_mix_closes_with_any_document(spark):
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 400]
    rows = [(100 * s + i, f"s{s:02}", n) for s in range(40) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("u_", source_mix.uniform(F.col("doc_id"), F.col("source"), seed=20))
    sources = defaultdict(list)
    for r in source_mix.mix(docs, size=F.col("n"), weights=(1,)).collect():
        sources[r.source].append(r)
    assert len(sources) == 40
    for rs in sources.values():
        ratio = rs[0].target / rs[0].source_size
        whole = math.floor(ratio + 1e-12)
        mean = sum(r.size * math.log(r.size + 2) for r in rs) / rs[0].source_size

        def rank(r, part=ratio - whole, mean=mean):
            p = min(max(part * math.log(r.size + 2) / mean, 1e-9), 1 - 1e-9)
            return r.u_ / (1 - r.u_) / (p / (1 - p))

        rs.sort(key=rank)
        gap, want = rs[0].target - whole * rs[0].source_size, set()
        for r in rs:
            if r.size > gap:
                break
            gap -= r.size
            want.add(r.doc_id)
        spare = [(abs(r.size - gap), rank(r), r.doc_id) for r in rs if r.doc_id not in want]
        if min(spare)[0] < gap:
            want.add(min(spare)[2])
        assert {r.doc_id for r in rs if r.taken == (whole + 1) * r.size} == want


# ------------------------------------------------------------------ tokens


def test_letters_of_later_unicode_versions(spark):
    path = bpe_automaton.tokenizer_path()
    texts = [f"a{x}'s {x}'ll 1{x}2 !{x}" for x in "\u1c89\u1c8a\ua7cb\U00013460\ue000\U000e0fff"]
    got = bpe_automaton.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    library = Tokenizer.from_file(path)
    assert {r.doc_id: list(r.ids) for r in got} == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


# ------------------------------------------------------------------ pipeline


def test_stages_keep_clashing_columns(spark):
    names = "copies size source_size target taken keep_id group_size kept text_sha256 _rest _copy".split()
    rows = [(i, f"words of text {i} " * 20, "s", *[f"{c}{i}" for c in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for stage in (corpus_pipeline.exact, corpus_pipeline.mixture):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert got and got <= set(rows)


def test_near_decides_by_row(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, prose(0)), (5, prose(1)), (None, prose(1) + " tail"), (None, prose(2)), (None, prose(2) + " tail"), (None, prose(2)),
            (7, prose(3)), (7, prose(4)), (6, prose(4) + " tail"), (8, prose(5)), (8, prose(5)), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()), key=repr)
    two = [r for r in got if r[1] and r[1].startswith("w2x")]
    assert len(two) == 1 and two[0] in rows
    want = [(None, prose(0)), (5, prose(1)), (7, prose(3)), (6, prose(4) + " tail"), (8, prose(5)), (9, ""), (9, ""), (None, None)]
    assert [r for r in got if r not in two] == sorted(want, key=repr)


def thue_morse(letters: int, one: str, two: str) -> str:
    return "".join(one if bin(i).count("1") % 2 == 0 else two for i in range(letters))


def test_words_that_meet_in_a_linear_hash(spark):
    """Sums of powers modulo 2**64 take these two words for one; tokens and links must not."""
    words = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    path = bpe_automaton.tokenizer_path()
    library = Tokenizer.from_file(path)
    ids = [library.encode(w, add_special_tokens=False).ids for w in words]
    got = bpe_automaton.digests(docs, path).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in got] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256(w.encode()).hexdigest() for w in words]
    files = token_files.write_token_files(docs, path, common.new_folder(spark, "t"), parts=1)
    crc = {r.doc_id: r.ids_crc32 for r in token_files.read_digests(files).collect()}
    assert crc == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in enumerate(ids)}
    assert [r.component_id for r in jaccard_join.similar_groups(docs).orderBy("doc_id").collect()] == [0, 1]


def test_sets_that_agree_under_one_hash_function(spark):
    """Two words that the first function takes for one; links and equal sets are confirmed under the second."""
    one, two = "eszycidpabcdefgh", "vbacdjny>+%g56u#"
    assert shingle_sets([f"{one} a b c d".encode()])[0].tolist() == shingle_sets([f"{two} a b c d".encode()])[0].tolist()
    words = [f"w{i}" for i in range(40)]
    mixed = lambda w: " ".join(x if i % 4 else w for i, x in enumerate(words))  # noqa: E731  all shingles have the word
    texts = [f"{one} alpha beta gamma delta", f"{two} alpha beta gamma delta", f"{one} alpha beta gamma delta", mixed(one), mixed(two), mixed(two) + " tail", mixed(one).upper()]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 4}


def test_tiles_and_column_slices_give_all_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 11)
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 10**6, 40).astype(np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) < 0.93], r.integers(0, 10**6, 2).astype(np.uint64)])) for b in base for _ in range(8)]
    table = pa.table({"group": [5] * len(sets), "set_id": range(len(sets)), "component": range(len(sets)), "body": [s.tobytes() for s in sets]})
    links = [p for b in jaccard_join._forest_links(iter(table.to_batches())) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]

    def roots(pairs):
        root = list(range(len(sets)))
        for x, y in pairs:
            a, b = root[x], root[y]
            root = [b if k == a else k for k in root]
        return [root.index(k) for k in root]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert every and roots(links) == roots(every) and len(links) <= len(sets)
