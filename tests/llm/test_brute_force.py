"""Operators that SQL cannot express, against plain Python versions; and every operator's defined edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm import bpe_automaton, common, exact_dedup, jaccard_join, ppm, quality_rules, secret_scan, source_mix, suffix_dedup, token_files, trigram_query, warc_zip
from attestra.llm.run_length_index import NOBODY, RunLengthIndex

PATH = bpe_automaton.tokenizer_path()
KEY = lambda rows: sorted(map(tuple, rows), key=repr)


def collected(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# ------------------------------------------------------------------ exact dedup


def test_exact_dedup(spark, hard):
    rows = hard.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_dedup(hard.withColumn("ties", F.lit("kept by the caller")), owners=3).collect()
    assert len(got) == len(rows) and got[0].ties == "kept by the caller"
    kept = Counter()
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        kept[r.text or ""] += r.kept
    assert set(kept.values()) == {1}


def test_extendible_hash_splits_and_chains(tmp_path):
    index = exact_dedup.ExtendibleHashIndex(str(tmp_path / "i"), cached=3, heap_block=100)
    for i in range(3000):  # a third collide on one key
        index.add(7 if i % 3 == 0 else i * 2654435761 % (1 << 64), b"t%d" % i, i, 1, 1)
    for i in range(3000):
        index.add(7 if i % 3 == 0 else i * 2654435761 % (1 << 64), b"t%d" % i, i + 1, 1, 2)
    index.finish()
    rows = list(index.rows())
    assert len(rows) == 3000 and index.depth > 2
    assert {(t, k, n) for t, k, _, n in rows} == {(b"t%d" % i, i + 1, 3) for i in range(3000)}
    index.close()


# ------------------------------------------------------------------ secrets


def test_trigram_queries():
    assert trigram_query.mandatory("abcd") == [["abc", "bcd"]]
    assert trigram_query.mandatory("(ab|cd)") == []
    assert trigram_query.mandatory("[0-9a-f]{32,}") == []
    assert trigram_query.mandatory("x?abc+") == [["abc"]] or trigram_query.mandatory("x?abc+") == []
    assert trigram_query.mandatory("(foo|bars)=") == [["ars", "bar", "rs="], ["foo", "oo="]]
    for rule in secret_scan.RULES:
        assert rule.branches or rule.kind == "hex"


# ------------------------------------------------------------------ language model


def brute_ppm(train):
    table = defaultdict(Counter)
    for t in train:
        b = b"\xfe" * 4 + t + b"\xff"
        for p in range(4, len(b)):
            for o in range(5):
                table[b[p - o : p]][b[p]] += 1

    def log10(context, symbol):
        out, seen = 0.0, set()
        for o in range(4, -1, -1):
            counts = {s: n for s, n in table.get(context[4 - o :], {}).items() if s not in seen}
            if table.get(context[4 - o :]):
                total, distinct = sum(counts.values()), len(counts)
                if symbol in counts:
                    return out + math.log10(counts[symbol] / (total + distinct))
                if distinct:
                    out += math.log10(distinct / (total + distinct))
                seen |= set(table[context[4 - o :]])
        return out - math.log10(255 - len(table.get(b"", ())))

    return log10


@pytest.mark.parametrize("which", ["hard", "none"])
def test_ppm(spark, hard, empty, which, monkeypatch):
    monkeypatch.setattr(ppm, "FILE_ROWS", 500)  # several buckets
    docs = hard.filter("length(text) < 2000 OR text IS NULL")
    train = docs.filter(~ppm.held_out("doc_id")) if which == "hard" else empty
    texts = [(t or "").encode().lower() for _, t in collected(train)]
    log10 = brute_ppm(texts)
    counts = Counter(w for t in texts for w in [*t.split(), b""])
    floor = counts.total() + 0.5 * (len(counts) + 1)
    rows = {(r.doc_id, round(r.base_score, 6), round(r.score, 6), r.n_tokens, r.n_known) for r in ppm.score(docs, ppm.train(train)).collect()}
    want = set()
    for i, t in collected(docs):
        b = (t or "").encode().lower()
        padded = b"\xfe" * 4 + b + b"\xff"
        words = [*b.split(), b""]
        want.add((i, round(sum(math.log10((counts[w] + 0.5) / floor) for w in words), 6), round(sum(log10(padded[p - 4 : p], padded[p]) for p in range(4, len(padded))), 6), len(words), sum(counts[w] > 0 for w in words)))
    assert rows == want


# ------------------------------------------------------------------ tokens


def test_automaton_equals_the_library(hard, small):
    library = Tokenizer.from_file(PATH)
    rows = collected(hard) + collected(small)
    texts = [t or "" for _, t in rows]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = bpe_automaton.encode(hard.select("doc_id", "text").unionByName(small.select("doc_id", "text")), PATH).collect()
    assert KEY((r.doc_id, tuple(r.ids), r.decoded) for r in got) == KEY((i, tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)) for (i, _), e in zip(rows, want, strict=True))
    digests = bpe_automaton.digests(hard, PATH).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in collected(hard)]
    assert KEY(digests) == KEY((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in want)


def test_token_files(spark, hard, tmp_path):
    library = Tokenizer.from_file(PATH)
    files = token_files.write_token_files(hard, PATH, f"file://{tmp_path}", parts=3)
    got = sorted(token_files.read_digests(files).collect(), key=lambda r: r.start)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in collected(hard)]
    assert [r.doc_id for r in got] == sorted((i for i, _ in collected(hard)), key=lambda i: -1 if i is None else i)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert KEY((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == KEY((i, len(x), crc(x)) for (i, _), x in zip(collected(hard), ids, strict=True))
    path = files.first().path
    whole = open(path, "rb").read()
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()) % 4 == 0  # any decoder passes over the tables
    broken = bytearray(whole)
    broken[8] ^= 1
    open(path, "wb").write(bytes(broken))
    with pytest.raises(Exception):  # noqa: B017
        reader = token_files.TokenFileReader(path)
        [reader.read(k) for k in range(len(reader))]


# ------------------------------------------------------------------ archives


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\n", None), (5, "u", ""), (9, "v", "日" * 5000)], "page_id long, url string, html string")
    files = warc_zip.write_archives(pages, f"file://{tmp_path}")
    got = {r.page_id: r for r in warc_zip.read_archives(files).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("response", None, 8), 2: ("revisit", 1, 8), 3: ("response", None, 0), 5: ("revisit", 3, 0), 9: ("response", None, 15000)}
    assert got[2].payload_digest == warc_zip.sha1_base32(b"<p>x</p>")
    import zipfile

    for f in files.collect():
        assert zipfile.ZipFile(f.path).testzip() is None


def test_plain_zip_directories(tmp_path):
    import zipfile

    path = str(tmp_path / "p.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.txt", b"hello")
        z.comment = b"PK\x05\x06 in a comment"
    reader = warc_zip.ZipReader(path)
    assert reader.range(reader.place("a.txt"), 5) == b"hello"


# ------------------------------------------------------------------ quality and mix


def test_cascade_order_does_not_change_the_verdict(hard):
    rules = quality_rules.default_rules(common.text_or_empty("text"))
    one = hard.filter(quality_rules.verdict(rules).isNull())
    two = hard.filter(quality_rules.verdict(rules[::-1]).isNull())
    three = quality_rules.quality_filter(hard)
    assert KEY(one.select(*hard.columns).collect()) == KEY(two.select(*hard.columns).collect()) == KEY(three.collect())


def test_mix(hard):
    got = source_mix.mix(hard.withColumn("u", F.lit(1)).withColumn("rank", F.lit(2))).collect()
    assert len(got) == hard.count() and got[0].u == 1
    size = defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        size[r.source] += r.size
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
        left, free = 1.5 * sum(size.values()) - sum(target.values()), free - set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
    again = source_mix.mix(hard.repartition(5)).collect()
    assert KEY((r.doc_id, r.taken) for r in again) == KEY((r.doc_id, r.taken) for r in got)


def brute_mix(rows, targets):
    """The taken words of each row: certain copies, then a Pareto order sample and its closing document."""
    out = {}
    for source, (total, target) in targets.items():
        mine = [r for r in rows if r[1] == source]
        whole = math.floor(target / total + 1e-12) if total else 0
        left = (max(target / total - whole, 0.0) if total else 0.0) * total
        docs = [r for r in mine if r[2]]
        weight = {r[0]: math.log(r[2] + 2.0) for r in docs}
        sure = set()
        while left > 0:  # documents whose inclusion would exceed 1 are certain; the others share the rest anew
            free = [r for r in docs if r[0] not in sure]
            level = (left - sum(r[2] for r in docs if r[0] in sure)) / sum(r[2] * weight[r[0]] for r in free)
            more = {r[0] for r in free if level * weight[r[0]] >= 1}
            if not more:
                break
            sure |= more
        taken = {r[0]: whole for r in mine}
        if left > 0:
            rank = {r[0]: 0.0 if r[0] in sure else r[3] / (1 - r[3]) / (level * weight[r[0]] / (1 - level * weight[r[0]])) for r in docs}
            reached = 0
            for r in sorted(docs, key=lambda r: (rank[r[0]], r[2], r[0])):
                if reached + r[2] > left:
                    break
                reached += r[2]
                taken[r[0]] += 1
            spare = [r for r in docs if taken[r[0]] == whole and abs(r[2] - (left - reached)) < left - reached]
            if spare:
                taken[min(spare, key=lambda r: (abs(r[2] - (left - reached)), rank[r[0]]))[0]] += 1
        out |= {r[0]: taken[r[0]] * r[2] for r in mine}
    return out


def test_mix_takes_the_documents_of_the_sample(small):
    for docs in (small, small.withColumn("source", F.lit("one")), small.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")))):
        rows = source_mix.mix(docs.withColumn("u_", source_mix.uniform(F.col("doc_id"), F.col("source"), seed=20))).collect()
        want = brute_mix([(r.doc_id, r.source, r.size, r.u_) for r in rows], {r.source: (r.source_size, r.target) for r in rows})
        assert {r.doc_id: r.taken for r in rows} == want


def test_columns_with_clashing_names(hard):
    own = ["row", "u", "p", "rank", "bucket", "state", "more", "whole", "part", "level", "copies", "_rejected_by", "kept", "words", "n"]
    docs = hard.select(F.create_map(F.lit("k"), F.lit(1)).alias("map"), "*", *[F.lit(-5).alias(c) for c in own])
    for out in (source_mix.mix(docs), quality_rules.quality_filter(docs)):
        for r in out.collect():
            assert r.map == {"k": 1} and all(r[c] == -5 for c in own)


def test_mix_comes_near(small):
    rows = source_mix.mix(small.withColumn("source", F.lit("s"))).collect()
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2


# ------------------------------------------------------------------ near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        if n is not None:
            least[find(i)] = min(least.get(find(i), n), n)
    return [(n, len(s), least.get(find(i)) if s else n) for i, ((n, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_join(hard, small):
    for docs in (hard, small):
        got = jaccard_join.similar_groups(docs).collect()
        assert KEY((r.doc_id, r.n_shingles, r.component_id) for r in got) == KEY(brute_groups(collected(docs)))


def random_sets(rng):
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64)) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))]
    sets += [s[rng.random(len(s)) < 0.93] for s in sets]
    return sets


def test_r_tree_loses_nothing():
    rng = np.random.default_rng(1)
    sets = random_sets(rng)
    sizes = np.array([len(s) for s in sets])
    points = jaccard_join.Points([jaccard_join.count_vector(s) for s in sets], sizes)
    block = np.tile(rng.integers(0, 3, len(sets) // 2), 2)  # copies stay with their sets
    forest = jaccard_join.CountForest(block, np.arange(len(sets)), points)
    found = {frozenset(p) for i, j, _ in forest.search(np.arange(len(sets)), np.arange(len(sets))) for p in zip(i.tolist(), j.tolist(), strict=True)}
    links = 0
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(np.intersect1d(s, t))
            assert points.bound(np.array([i]), np.array([j]))[0] >= both
            if block[i] == block[j] and jaccard_join.linked(both, len(s), len(t)):
                links += 1
                assert frozenset((i, j)) in found
    assert links > 30 and len(found) < 2 * links and len(forest.levels) > 2
    assert forest.opened < len(sets) ** 2 / 12  # most boxes of other trees and subtrees are never opened


def test_without_trees_links_are_lost(small, monkeypatch):
    """The trees are the search: with no band to lead sets together they find every link, and none is found without."""
    monkeypatch.setattr(jaccard_join._Join, "stars", lambda self: None)
    got = jaccard_join.similar_groups(small).collect()
    want = KEY(brute_groups(collected(small)))
    assert KEY((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    with monkeypatch.context() as long:
        long.setattr(jaccard_join, "LONG", 20)  # most pairs are handed out
        assert KEY((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(small).collect()) == want
    monkeypatch.setattr(jaccard_join._Join, "trees", lambda self: None)
    lost = KEY((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(small).collect())
    assert lost != want


def test_blocks_are_streamed_across_batches():
    import pyarrow as pa

    # (sig, set, n): repeated rows, a set alone, sizes too far apart, 20 which fits 26 but not 40, and a wide sig
    rows = [(1, 5, 9), (1, 5, 9), (2, 1, 20), (2, 1, 20), (2, 3, 26), (2, 3, 26), (2, 4, 40), (3, 9, 8), (4, 1, 30), (4, 2, 40), (5, 1, 10), (5, 2, 90)]
    rows += [(6, i // 2, 100 * (i // 2)) for i in range(2 * jaccard_join.WIDE + 20)] + [(7, 1, 5), (7, 2, 5)]
    want = [(2, 1), (2, 3), (4, 1), (4, 2), *((6, i) for i in range(jaccard_join.WIDE + 10)), (7, 1), (7, 2)]
    for width in (1, 2, 3, 20, 500):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + width]]) for k in (0, 1, 2, 2)], names=["sig", "set_id", "n", "room"]) for i in range(0, len(rows), width)]
        got = [(s, k) for b in jaccard_join._shared(iter(parts)) for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert [x for x in got if x[0] != 6] == [x for x in want if x[0] != 6], width
        assert [x for x in got if x[0] == 6] == [x for x in want if x[0] == 6], width


# ------------------------------------------------------------------ repeated passages


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b, n = (t or "").encode(), -1 if i is None else i
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, n), n)
    out = []
    for i, t in rows:
        b, n = (t or "").encode(), -1 if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < n:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(hard, small):
    for docs in (hard, small):
        got = suffix_dedup.repeated_passages(docs, digest=True).collect()
        assert KEY((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == KEY(brute_repeats(collected(docs)))


def test_run_length_index():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(60)]
    owners = rng.integers(0, 1000, len(texts))
    index = RunLengthIndex(texts, owners, 9)
    least = {}
    for t, o in zip(texts, owners, strict=True):
        for p in range(len(t) - 8):
            least[t[p : p + 9]] = min(least.get(t[p : p + 9], NOBODY), int(o))
    for t, got in zip(texts, index.stream(), strict=True):
        assert got.tolist() == [least[t[p : p + 9]] for p in range(max(0, len(t) - 8))]


# ------------------------------------------------------------------ empty tables


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert secret_scan.scan(empty).count() == 0
    assert ppm.score(empty, ppm.train(empty)).count() == 0
    assert token_files.read_digests(token_files.write_token_files(empty, PATH, common.new_folder(spark, "t"))).count() == 0
    assert quality_rules.statistics(empty).count() == 0 and quality_rules.quality_filter(empty).count() == 0
    assert source_mix.mix(empty).count() == 0
    assert bpe_automaton.digests(empty, PATH).count() == 0
    assert jaccard_join.similar_groups(empty).count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read_archives(warc_zip.write_archives(pages, common.new_folder(spark, "w"))).count() == 0
