"""The fill-in-middle transformation against plain Python, in every unit, form and size of chunk."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import fill_in_middle as fim


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def brute(doc_id, text, unit="char", plain=10, spm=20):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units(text, unit)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def own_rows():
    odd = ["<P>", "a<S>b", "x" * 50 + "<M>", "<P", "P><", "<<<P", "\U0001f642" * 40, "é<é>S", "\n\n a\n b", " lead", "tail \n", "日本 語\n"]
    return [(100 + i, t) for i, t in enumerate(odd)] + [(i, f"<S {i} > " * (i % 7)) for i in range(200, 300)]


@pytest.mark.parametrize("chunk", [1 << 22, 300, 7])
def test_transform(spark, hard, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)  # 7: nearly every text is longer than a chunk
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(own_rows(), "doc_id long, text string"))
    batches = df.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *fim.draws_of("doc_id", 1)).toArrow().combine_chunks().to_batches()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for unit in ("char", "line", "word"):
        got = [tuple(r.values()) for b in fim._transformed(unit, fim.SENTINELS, 10, 20)(batches) for r in b.to_pylist()]
        assert sorted(got, key=repr) == sorted((brute(i, t, unit) for i, t in rows), key=repr), unit


def test_query_columns_and_restoring(spark, hard):
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(own_rows(), "doc_id long, text string"))
    for plain, spm in ((0, 0), (0, 100), (0, 50), (100, 0)):
        out = fim.transform(df.withColumn("output", F.lit(1)).withColumn("n", F.lit("clash")), plain_percent=plain, spm_percent=spm)
        got = out.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(r.doc_id, r.text, plain=plain, spm=spm) for r in df.collect()), key=repr)


def test_empty_table_and_sentinels(spark, empty):
    assert fim.transform(empty).columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    assert fim.transform(empty).count() == 0
    for bad in (("ab", "ba", "c"), ("x", "xy", "z"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    with pytest.raises(ValueError):
        fim.transform(empty, unit="page")


def test_a_long_text_is_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 1000)
    text = "né \U0001f642日\n" * 3000
    data = np.frombuffer(text.encode(), np.uint8)
    kernel = fim.Kernel("char", fim.SENTINELS)
    for draws in ([0, 10**9], [17, 17], [len(text), 5], [12345, 4321]):
        n, ends, places = kernel.cut(data, np.array([0, len(data)]), np.array([draws]))
        assert n[0] == len(text)
        a, b = ends[0]
        assert (data[: places[0][0]].tobytes().decode(), data[places[0][0] : places[0][1]].tobytes().decode()) == (text[:a], text[a:b])
