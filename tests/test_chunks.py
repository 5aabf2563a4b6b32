"""Chunks of elements, tables and texts against plain Python, with blocks of a few rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.operators import blocks, ordered

TOKEN = re.compile(r"\w+|[^\w\s]")
count = lambda text: len(TOKEN.findall(text))

ELEMENTS = "doc string, at long, kind string, text string, page int, section string, printed_page string, element_id string, parent_element_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def folded(rows, room):
    """First positions, row by row: rows are (at, weight, starts, alone)."""
    out, total, first = [], None, None
    for at, weight, starts, alone in rows:
        if starts or alone or total is None or total + weight > room:
            total, first = 0, at
        total += weight
        out.append(first)
        if alone or total > room:
            total = None
    return out


@pytest.mark.parametrize(("block", "fan"), [(10_000, 256), (5, 256), (3, 2)])
def test_groups_over_any_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(ordered, "FAN", fan)
    r = random.Random(block)
    rows, want = [], {}
    for key in ("a", "b", None, "c"):
        own = [(i, r.choice([0, 1, 2, 3, 5, 30]), r.random() < 0.04, r.random() < 0.04) for i in range(60 if key != "c" else 1)]
        rows += [(key, *x, f"text {x[0]}") for x in own]
        want |= {(key, x[0]): f for x, f in zip(own, folded(own, 12), strict=True)}
    df = spark.createDataFrame(rows, "key string, at long, w int, s boolean, o boolean, text string").repartition(3)
    got = ordered.budget_groups(df, "key", "at", F.col("w"), F.lit(12), F.col("s"), F.col("o"), 12, block).collect()
    assert {(x.key, x.at): x.first for x in got} == want and len(got) == len(rows)
    assert all(x.text == f"text {x.at}" for x in got)
    assert ordered.budget_groups(df.limit(0), "key", "at", F.col("w"), F.lit(12), F.col("s"), F.col("o"), 12).count() == 0


def test_functions_compose():
    r = random.Random(2)
    for _ in range(50):
        rows = [(i, r.randrange(6), r.random() < 0.05, r.random() < 0.05) for i in range(40)]
        cut = r.randrange(1, 39)
        arrays = lambda part: [__import__("numpy").array(c) for c in (*[[x[k] for x in part] for k in (0, 1)], [9] * len(part), [x[2] for x in part], [x[3] for x in part])]
        whole = ordered.block_function(*arrays(rows), 9)
        both = ordered.composed(ordered.block_function(*arrays(rows[:cut]), 9), ordered.block_function(*arrays(rows[cut:]), 9))
        pick = lambda f, s: (f[0][0 if len(f[0]) == 1 else s], f[1][0 if len(f[1]) == 1 else s])
        assert all(pick(whole, s) == pick(both, s) for s in range(len(both[0])))


def test_blocks_merge_within_page_and_section(spark):
    box = lambda y: (10.0, float(y), 90.0, y + 8.0)
    rows = [("d", 0, "text", "first  block", 1, "s", "1", "e0", None, box(0)), ("d", 1, "text", "second\r\nblock", 1, "s", "1", "e1", None, box(10)), ("d", 2, "text", "third", 1, "t", "1", "e2", "p", None),
            ("d", 3, "table", "| a |", 1, "t", "1", "e3", None, box(30)), ("d", 4, "text", "four", 1, "t", "1", "e4", None, box(40)), ("d", 5, "text", "five", 2, "t", "2", "e5", None, box(0)),
            ("d", 6, "text", "six", 2, "t", "2", "e6", None, None), ("d", 7, "text", None, 2, "t", "2", "e7", None, box(3)), ("d", 8, "text", "w " * 12, 2, "t", "2", "e8", None, box(4)), ("d", 9, "text", "tail", 2, "t", "2", "e9", None, box(5))]
    for block in (10_000, 2):
        out = blocks.coalesce_blocks(spark.createDataFrame(rows, ELEMENTS), "doc", "at", 8, block).orderBy("first").collect()
        assert [(r.first, r.elements, r.kind, r.text) for r in out] == [(0, 2, "text", "first block\n\nsecond\nblock"), (2, 1, "text", "third"), (3, 1, "table", "| a |"), (4, 1, "text", "four"), (5, 3, "text", "five\n\nsix"), (8, 1, "text", "w " * 12), (9, 1, "text", "tail")]
        assert tuple(out[0].bbox) == (10.0, 0.0, 90.0, 18.0) and out[4].bbox is None and out[0].parent_element_id == "e0"
        assert out[0].element_id.startswith("elem-text-group-") and out[1].element_id == "e2" and out[1].parent_element_id == "p"
        assert max(r.tokens for r in out if r.elements > 1) <= 8 and sum(r.elements for r in out) == len(rows)


def test_row_groups_repeat_their_header(spark):
    head, rule = "| name | value |", "| --- | --- |"
    table = "\n".join([head, rule, *[f"| method-{i} | {i}.0 |" for i in range(7)], "| " + "wide " * 40 + "| x |", "| last | 1 |"])
    df = spark.createDataFrame([("t", table), ("prose", "no table\nat all\nhere"), ("none", None), ("short", "| a |\n| --- |")], "id string, text string")
    rows = blocks.markdown_rows(df, "id", F.col("text"))
    assert {r.id for r in rows.collect()} == {"t"}
    h = count(head + "\n" + rule)
    for block in (10_000, 2):
        out = blocks.table_row_groups(rows, "id", "at", F.col("line"), F.col("header"), h + 18, h + 30, block).orderBy("first").collect()
        assert [(r.first, r.n_rows) for r in out] == [(1, 2), (3, 2), (5, 2), (7, 1), (8, 1), (9, 1)]
        assert all(r.text.startswith(head + "\n" + rule + "\n") and r.tokens == count(r.text) for r in out)
        assert all(r.tokens <= h + 18 for r in out if r.first != 8)
        assert "\n".join(x for r in out for x in r.text.split("\n")[2:]) == "\n".join(table.split("\n")[2:])
        assert [(r.first, r.n_rows) for r in blocks.table_row_groups(rows, "id", "at", F.col("line"), F.col("header"), h + 18, h, block).collect()] == [(1, 9)]
    assert blocks.table_row_groups(rows.limit(0), "id", "at", F.col("line"), F.col("header"), 40, 50).count() == 0


def searched(text, most, overlap):
    """The same windows by trying every place."""
    if count(text) <= most:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = max(e for e in range(start + 1, len(text) + 1) if count(text[start:e]) <= most)
        if end < len(text):
            half = start + max(1, (end - start) // 2)
            cut = max(text.rfind(m, half, end) for m in ("\n\n", "\n", ". ", "; ", " "))
            cut = end if cut < 0 else cut + (2 if text[cut : cut + 2] in {"\n\n", ". ", "; "} else 1)
            if cut > start and count(text[start:cut]) >= most // 2:
                end = cut
        raw = text[start:end]
        a, b = start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())
        if b > a:
            out.append((a, b))
        if end >= len(text):
            break
        again = min(m for m in range(start, end + 1) if count(text[m:end]) <= overlap) if overlap else end
        start = again if again > start else end
    return out


def test_windows_end_at_natural_boundaries(spark):
    r = random.Random(7)
    texts = ["", "one", " \n ", "x" * 300, "a.b;c d\n\n" * 9] + ["".join(r.choice(["ab", "c", " ", " ", "\n", "\n\n", ". ", "; ", "é", "日本", "-", "_9"]) for _ in range(r.randrange(20, 160))) for _ in range(60)]
    for most, overlap in ((10, 3), (7, 0), (4, 3), (1, 0)):
        for text in texts:
            assert blocks.boundary_spans(text, most, overlap) == searched(text, most, overlap), (text, most, overlap)
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    got = blocks.boundary_chunks(df, "id", "text", 10, 3).collect()
    assert {x.id for x in got} == set(range(len(texts))) and all(x.chunk == texts[x.id][x.start : x.end] for x in got)
    covered = [m for m in TOKEN.finditer(texts[-1]) if not any(x.start <= m.start() and m.end() <= x.end for x in got if x.id == len(texts) - 1)]
    assert not covered
    with pytest.raises(ValueError):
        blocks.boundary_chunks(df, "id", "text", 5, 5)
