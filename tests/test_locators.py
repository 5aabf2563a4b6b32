"""Number tokens, precise references, evaluation modes and context around visuals, on cases and against plain Python."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from attestra.functions.numbers import NUMBER_WORDS, normalized_numbers
from attestra.operators import locators as L

EVIDENCE = "evidence_id string, document_id string, page int, element_id string, parent_element_id string, kind string, method string, snippet string, has_span boolean, has_crop boolean, cells array<struct<raw_text:string,row_header:string,column_header:string>>"


def plain_numbers(value):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9.\-])[-+]?(?:\d{1,3}(?:[,   ]\d{3})+|\d+)(?:\.\d+)?(?:\s*[×xX%])?", value):
        body = m[0].rstrip("×xX% ")
        braces = value[: m.start()].rstrip().endswith("{") and value[m.end() :].lstrip().startswith("}")
        split = "," in body and (braces or not re.fullmatch(r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", body))
        parts = body.split(",") if split else [body]
        out += [re.sub(r"[\s,]", "", p + (m[0][len(body) :] if i == len(parts) - 1 else "")).lower().replace("x", "×") for i, p in enumerate(parts) if p]
    return list(dict.fromkeys(out + [n for w, n in NUMBER_WORDS.items() if re.search(rf"\b{w}\b", value.casefold())]))


def test_numbers(spark):
    r = random.Random(9)
    texts = ["", "1,024 and 1 024 or 1 024", "{1,024}", "{ 1,2,8 }", "1,2,8", "A100 v2.5 x-7 -7 +3.5", "4x 12 % 1.9×-11.8×", "five of Ten, tenth", "3.14.15", "12,34 and 1,234.5%", "128K 64 GB", "1,234,567x", "{16}", "{ 12,345 x }"]
    texts += ["".join(r.choice(["1", "23", "456", ",", " ", ".", "-", "x", "%", "{", "}", "K", "one ", "\n"]) for _ in range(r.randrange(3, 25))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    got = {x.id: x.n for x in df.select("id", normalized_numbers(F.col("text")).alias("n")).collect()}
    assert got.pop(-1) == []
    assert got == {i: plain_numbers(t) for i, t in enumerate(texts)}


def passage(name, snippet, page=1, element="e", parent=None, kind="text", span=True, cells=None, document="d", method="native_text", crop=False):
    return (name, document, page, element, parent, kind, method, snippet, span, crop, cells)


def references(spark, text, refs, evidence):
    claims = spark.createDataFrame([("c", text, refs)], "claim_id string, text string, refs array<string>")
    found = L.numeric_locators(claims, spark.createDataFrame(evidence, EVIDENCE))
    return L.with_locators(claims, found).first().refs


def test_numeric_references(spark):
    whole = passage("whole", "Throughput is 42% on the table", element="table-1", span=False)
    cell = passage("cell", "| 42% |", element="cell-1", parent="table-1", kind="table", span=False, cells=[("42%", "row", "column")])
    assert references(spark, "It reaches 42% here", ["whole"], [whole, cell]) == ["whole", "cell"]
    # two cells of the object: a tie there, and none shares two words
    assert references(spark, "It reaches 42% here", ["whole"], [whole, cell, passage("cell2", "| 42% |", element="cell-2", parent="table-1", kind="table", span=False, cells=[("x", "42%", None)])]) == ["whole"]
    # the cited passage is precise already
    assert references(spark, "It reaches 42% here", ["exact"], [passage("exact", "42% measured"), cell]) == ["exact"]
    # spaces and commas in thousands are equal
    assert references(spark, "uses 1,024 tokens of context", ["a"], [passage("a", "a window of 1 024 tokens", element="f", span=False), passage("b", "window 1024", element="f")]) == ["a", "b"]
    aggregate = passage("figure", "One summary of all runs has a 256K row.", page=4, element="figure-05", span=False)
    narrative = passage("narrative", "It compares five public engines in this work.", page=10, element="p1")
    decoy = passage("decoy", "An annex lists five cooling limits for racks.", page=11, element="p2")
    text = "This work looks at 5 public engines across workloads."
    assert references(spark, text, ["figure"], [aggregate, narrative, decoy]) == ["figure", "narrative"]
    # another document does not count, and neither does an unknown reference
    assert references(spark, text, ["figure", "gone"], [aggregate, passage("far", narrative[7], document="other")]) == ["figure", "gone"]
    near, far = passage("near", "engines in workloads: 5", page=5, element="p3"), passage("far", "engines in workloads: 5", page=9, element="p4")
    assert references(spark, text, ["figure"], [aggregate, near, far]) == ["figure", "near"]
    assert references(spark, text, ["figure"], [aggregate, near, passage("near2", "engines in workloads: 5", page=3, element="p4")]) == ["figure"]
    assert references(spark, text, [], [narrative]) == [] and references(spark, None, ["figure"], [aggregate]) == ["figure"]


def plain_references(claims, evidence):
    numbers = lambda t: plain_numbers(t or "")
    words = lambda t: {w.casefold().strip("._+-/") for w in re.findall(r"[A-Za-z][A-Za-z0-9_.+/-]{2,}", t or "")} - {"", "the", "and", "with", "from", "that", "this", "result", "results"}
    by, out = {e[0]: e for e in evidence}, set()

    def precise(e, n):
        if e[5] == "table":
            return any(n in numbers(v) for c in e[10] or [] for v in c)
        return bool(e[9]) if e[6] == "vision" else bool(e[8])

    for name, text, refs in claims:
        cited = [by[x] for x in refs or [] if x in by]
        for place, n in enumerate(numbers(text)):
            holding = [e for e in cited if n in numbers(e[7])]
            if any(precise(e, n) for e in holding):
                continue
            fit = [e for e in evidence if e[0] not in refs and n in numbers(e[7]) and precise(e, n)]
            same = [e for e in fit if any(e[1:3] == p[1:3] and {x for x in e[3:5] if x} & {x for x in p[3:5] if x} for p in holding)]
            how = "object"
            if len(same) != 1:
                how, scored = "document", []
                for e in fit:
                    pages = [p[2] for p in cited if p[1] == e[1] and p[2] is not None]
                    gap = min((abs(e[2] - p) for p in pages), default=None) if e[2] is not None else None
                    shared = len(words(text) & words(e[7]))
                    if any(p[1] == e[1] for p in cited) and shared >= 2:
                        scored.append(((shared, *((-1, -10_000) if gap is None else (int(gap == 0), -gap))), e))
                top = max((s for s, _ in scored), default=None)
                same = [e for s, e in scored if s == top]
            if len(same) == 1:
                out.add((name, place, n, same[0][0], how))
    return out


def test_numeric_references_against_a_loop(spark):
    r = random.Random(4)
    say = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "5", "7%", "five", "1,000"]) for _ in range(5))
    evidence = [passage(f"e{i}", r.choice([say(), say(), None]), r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice(["a", "p", None]), r.choice(["text", "table"]), r.choice([True, False, None]),
                        [(say(), None, say())] if r.random() < 0.5 else None, r.choice(["d1", "d2"]), r.choice(["vision", "native_text"]), r.choice([True, False])) for i in range(60)]
    claims = [(f"c{i}", say(), [f"e{r.randrange(70)}" for _ in range(r.randrange(4))]) for i in range(60)] + [("none", None, ["e1"])]
    got = L.numeric_locators(spark.createDataFrame(claims, "claim_id string, text string, refs array<string>"), spark.createDataFrame(evidence, EVIDENCE).repartition(3)).collect()
    want = plain_references(claims, evidence)
    assert {tuple(x) for x in got} == want and {x[4] for x in want} == {"object", "document"}
    assert L.numeric_locators(spark.createDataFrame(claims, "claim_id string, text string, refs array<string>").limit(0), spark.createDataFrame(evidence, EVIDENCE)).count() == 0


def test_evidence_is_read_once(spark):
    """A passage is one row of the index, whatever its numbers, and no join or expression after it reads texts again."""
    claims = [("c", " or ".join(str(k) for k in range(200)) + " alpha beta", ["cited"])]
    evidence = [passage("cited", "no number", element="x"), *(passage(f"e{k}", f"{k} alpha beta", element=f"p{k}") for k in range(200)), passage("twin", "7 alpha beta", element="q")]
    index = L._numbers_of(spark.createDataFrame(evidence, EVIDENCE))
    assert index.count() == len(evidence) and {x.evidence_id: (x.numbers, x.exact) for x in index.filter("evidence_id IN ('e7', 'cited')").collect()} == {"e7": (["7"], ["7"]), "cited": ([], [])}
    found = L.numeric_locators(spark.createDataFrame(claims, "claim_id string, text string, refs array<string>"), spark.createDataFrame(evidence, EVIDENCE))
    assert {(x.place, x.number, x.evidence_id, x.how) for x in found.collect()} == {(k, str(k), f"e{k}", "document") for k in range(200) if k != 7}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and "regexp" not in plan


def test_evaluation_modes(spark):
    cited = passage("cited", "Latency falls to 4 ms for the tiered cache prototype", page=4)
    setup = passage("setup", "The tiered cache prototype latency is emulated on servers", page=3)
    other = passage("other", "Power of the tiered cache prototype latency was simulated", page=9)

    def mode(*evidence, description="latency of the tiered cache prototype"):
        observations = spark.createDataFrame([("o", description, ["cited"])], "observation_id string, description string, refs array<string>")
        return [tuple(x) for x in L.evaluation_modes(observations, spark.createDataFrame(evidence, EVIDENCE)).collect()]

    assert mode(cited, setup) == [("o", "emulated", "setup")]
    assert mode(cited, setup, other) == []  # both share as many words
    assert mode(cited, setup, passage("weak", "a cache was measured", page=4)) == [("o", "emulated", "setup")]
    assert mode(cited, passage("both", "tiered cache prototype latency measured and simulated")) == []
    assert mode(cited, setup, passage("setup0", setup[7], page=4)) == [("o", "emulated", "setup0")]  # the cited page is nearer
    assert mode(cited, passage("b", setup[7], page=3), passage("a", setup[7], page=5)) == [("o", "emulated", "a")]
    assert mode(cited, passage("far", setup[7], document="else")) == [] and mode(cited, setup, description=None) == []


CHUNKS = "chunk_id string, document_id string, document_version string, page int, kind string, text string, element_id string, parent_element_id string, object_label string, y0 double, y1 double"


def chunk(name, text, kind="text", y0=None, y1=None, label=None, element=None, parent=None, page=1):
    return (name, "d", None, page, kind, text, element, parent, label, y0, y1)


def expand(spark, rows, selected, most=2):
    chosen = spark.createDataFrame([("r", c, i) for i, c in enumerate(selected)], "request string, chunk_id string, place long")
    return [tuple(x)[1:5] for x in L.context_expansion(spark.createDataFrame(rows, CHUNKS), chosen, most).orderBy("anchor_id", "place").collect()]


def test_context_of_a_table(spark):
    rows = [chunk("before", "TABLE I has all runs, with sizes {1, 2, 8}.", y0=100.0, y1=220.0), chunk("caption", "TABLE I. RUNS AND SIZES", "caption", 236.0, 253.0, "Table I", "caption-1"),
            chunk("continuation", "2, 8}. Longer runs follow", y0=253.2, y1=270.0), chunk("table", "| Model |", "table", 275.0, 430.0, "Table I", None, "caption-1"), chunk("footer", "unrelated", y0=700.0, y1=720.0)]
    assert expand(spark, rows, ["table", "caption"]) == [("table", "before", 2, 55.0), ("table", "continuation", 3, 5.0)]
    assert expand(spark, rows, ["table"]) == [("table", "caption", 0, 22.0), ("table", "before", 2, 55.0)]
    assert expand(spark, rows, []) == [] and expand(spark, rows, ["before"]) == []


def test_context_is_bounded_and_given_once(spark):
    rows = [chunk("caption", "Table 1. Runs", "caption", 200.0, 220.0, "Table 1")] + [chunk(f"n{i}", f"line {i}", y0=221.0 + i, y1=222.0 + i) for i in range(5)]
    assert [x[1] for x in expand(spark, rows, ["caption", "caption"])] == ["n0", "n1"]
    two = rows + [chunk("t1", "|", "table", 218.0, 219.0), chunk("t2", "|", "table", 219.0, 220.0), chunk("bare", "no box")]
    got = expand(spark, two, ["t2", "t1", "caption"])
    assert [x[1] for x in got if x[0] == "t2"] == ["n0", "n1"] and [x[1] for x in got if x[0] == "t1"] == ["n2", "n3"]  # t2 was selected first; the caption is no anchor beside tables
    assert expand(spark, two, ["t1"], most=0) == []


def test_pages_of_any_batch(spark):
    """Pages stream through a task one after the other, and one that is cut by a batch stays whole."""
    rows = [chunk(f"p{p:02}-{k}", f"line {k}", "table" if k == 3 else "text", float(k), k + 0.5, page=p) for p in range(20) for k in range(8)]
    selected = spark.createDataFrame([("r", f"p{p:02}-{k}", k) for p in range(20) for k in (2, 3)], "request string, chunk_id string, place long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = L.context_expansion(spark.createDataFrame(rows, CHUNKS), selected)
        assert sorted(tuple(x)[1:] for x in found.collect()) == [(f"p{p:02}-3", f"p{p:02}-{k}", 3, d, n) for p in range(20) for k, d, n in ((1, 1.5, 2), (4, 0.5, 1))]
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_against_sorting():
    r = random.Random(6)
    for _ in range(30):
        pick = lambda *x: r.choice(x)
        rows = [chunk(f"c{i:02}", pick("see Table 1", "text", "TABLE 2 and table 1"), pick("text", "caption"), *(pick((None, None), (float(y := r.randrange(50)), y + 3.0))), pick(None, "Table 1", "table 2"), pick("", "e1", "e2"), pick(None, "p1", "e1")) for i in range(25)]
        anchors = [dict(zip(("chunk_id", "y0", "y1", "object_label", "element_id", "parent_element_id"), (f"a{i}", *pick((None, None), (10.0, 20.0), (30.0, 31.0)), pick(None, "Table 1", "Table 2"), pick(None, "e1", "p1"), pick("", "e2", "p1")), strict=True)) for i in range(5)]
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        page = {c: np.array([x[names.index(c)] or "" for x in rows], object) for c in ("chunk_id", "text", "element_id", "parent_element_id", "object_label")}
        page |= {c: np.array([np.nan if x[names.index(c)] is None else x[names.index(c)] for x in rows]) for c in ("y0", "y1")}
        known, want = set(), []
        for a in anchors:
            options = []
            for x in (dict(zip(names, x, strict=True)) for x in rows):
                e, p = a["element_id"], a["parent_element_id"]
                linked = (e and x["parent_element_id"] == e) or (p and p in (x["element_id"], x["parent_element_id"]))
                label = (a["object_label"] or "").lower()
                relation = 0 if linked else 1 if label and label == (x["object_label"] or "").lower() else 2 if label and label in x["text"].lower() else 3
                gap = float("inf") if a["y0"] is None or x["y0"] is None else max(a["y0"] - x["y1"], x["y0"] - a["y1"], 0.0)
                if x["chunk_id"] not in known and (relation < 3 or gap < float("inf")):
                    options.append((relation, gap, x["chunk_id"]))
            for relation, gap, name in sorted(options)[:2]:
                known.add(name)
                want.append((a["chunk_id"], name, relation, gap))
        assert L.neighbours(anchors, page, 2) == want
