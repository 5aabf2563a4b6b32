"""Phrase dictionaries, visual labels and ranking, quantities, exact top k: on cases and against plain Python."""

import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import quantities as Q
from attestra.functions import visuals as X
from attestra.operators import dictionary as D
from attestra.operators import retrieval as V


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, monkeypatch):
    monkeypatch.setattr(D, "MOST_BYTES", 8 << 20 if request.param == "broadcast" else 0)


def test_contained_phrases(spark, way):
    r = random.Random(3)
    piece = lambda: r.choice(["ab", "cab", "b", "x", " ", " ", "-", "é", "日本", "+", "_", ". "])
    texts = ["".join(piece() for _ in range(r.randrange(0, 30))) for _ in range(120)] + [None, "", "whole sentence with words inside it"]
    phrases = ["".join(piece() for _ in range(r.randrange(1, 7))) for _ in range(120)] + [None, "", "+", " ", "entence with wor", "abcdefghijkl"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "id long, text string")
    got = D.contained(left, spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")).collect()
    want = [(i, k) for i, t in [*enumerate(texts), (0, texts[0])] for k, p in enumerate(phrases) if t is not None and p and p in t]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
    assert D.contained(left, spark.createDataFrame([], "phrase_id long, phrase string")).count() == 0


SEP = r"[\s\-‐‑‒–—―−]"


def named(name, text):
    parts = [p for p in re.split(SEP + "+", name.strip()) if p]
    return bool(parts) and re.search(r"(?<!\w)" + (SEP + "*").join(map(re.escape, parts)) + r"(?!\w)", text, re.IGNORECASE) is not None


def test_names(spark, way):
    r = random.Random(4)
    parts = ["kv", "cache", "C++", "4.0", "Zip", ".NET", "é"]
    names = ["-".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(40)] + ["KV Cache", "kvcache", "", None, "++", "- -"]
    texts = ["".join(r.choice([*parts, "KV", "Cache", " ", "-", "–", "x", ".", "\n"]) for _ in range(r.randrange(1, 14))) for _ in range(300)] + [None, "KV-Cache", "kv\n cache", "kvcaches", "akv cache"]
    got = D.names_in(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(names)), "phrase_id long, phrase string")).collect()
    want = {(i, k) for i, t in enumerate(texts) for k, n in enumerate(names) if t is not None and n and re.search(r"\w", n) and named(n, t)}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100


def test_identities(spark, way):
    technologies = spark.createDataFrame([("tierx", "TI-ERX", "TIERX: A Layered View of Slow Caches, arXiv:2401.12345v2", "https://arxiv.org/abs/2401.12345"), ("short", "Qx", "Two words", None), ("none", None, None, None)], "tech_id string, name string, paper string, url string")
    rows = {"name": ("The TI erx study", ""), "title": (None, "we read tierx a layered-view of slow caches today"), "number": ("", "see 2401.12345 for more"), "part": ("", "Two words and TIERXs, 12401.12345"), "empty": (None, None)}
    sources = spark.createDataFrame([(k, *v) for k, v in rows.items()], "source_id string, title string, excerpt string")
    assert sorted(map(tuple, D.identities(sources, technologies).collect())) == [("name", "tierx"), ("number", "tierx"), ("title", "tierx")]


@pytest.mark.parametrize("open_names", [False, True])
def test_identities_in_parts(spark, monkeypatch, open_names):
    """Technologies in several passes, texts in slices, against plain Python; sources of several rows give a pair once."""
    for name, n in (("PASS_BYTES", 900), ("SLICE", 30)):
        monkeypatch.setattr(D, name, n, raising=False)
    r = random.Random(11)
    parts = ["kv", "cache", "ab", "x_y", "é", "of", "_", "_ab"]
    some = lambda a, b, joins: "".join(r.choice(parts) + r.choice(joins) for _ in range(r.randrange(a, b)))
    texts = [some(0, 25, [" ", " ", "-", ". ", "_", "\n", " – ", ""]) + r.choice(["", "", " 2401.1234%d" % r.randrange(9)]) for _ in range(150)] + [None, "", "2401.12340"]
    names = ["-".join(r.choice(["kv", "cache", "ab", "x_y", "of"]) for _ in range(r.choice([1, 2, 2]))) for _ in range(40)] + [None, "", "- -"] + ["C++", "kv-cache-ab", "é"] * open_names
    rows = [(f"t{i}", n, some(1, 8, [" ", " ", "-", "_"]), r.choice([None, "https://arxiv.org/abs/2401.1234%d" % r.randrange(12)])) for i, n in enumerate(names)]
    sources = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(0, None, texts[0])], "source_id long, title string, excerpt string").repartition(3)
    got = D.identities(sources, spark.createDataFrame(rows, "tech_id string, name string, paper string, url string"))
    only = lambda x: re.findall(r"[^\W_]+", x.lower())
    run = lambda words, text: len(words) >= 4 and f" {' '.join(words)} " in f" {' '.join(only(text))} "
    want = {(i, k) for i, t in enumerate(texts) for k, n, p, u in rows if t and (n and re.search(r"\w", n) and named(n, t) or run(only(p), t) or u and re.search(rf"(?<![\w.]){u[-10:]}(?!\w|\.\d)", t))}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_identities_shuffle_no_pairs(spark):
    """60,000 pairs come from 300 texts without being shuffled, and so do none of their words."""
    sources = spark.createDataFrame([(i, None, f"About the KV cache of {i}, which all the others have too") for i in range(300)], "source_id long, title string, excerpt string")
    technologies = spark.createDataFrame([(i, "KV-Cache", "which all the others have", None) for i in range(200)], "tech_id long, name string, paper string, url string")
    before = shuffled_rows(spark)
    assert D.identities(sources, technologies).count() == 60_000 and shuffled_rows(spark) - before < 2000


def test_relinked(spark, way):
    quote = "The cache is  compressed to a tenth of its size"
    evidence = [("e1", "One title", "http://a/long", "full_text", f"Before. {quote.lower()} after"), ("e2", "ONE  title", "http://a", "full_text", f"x {quote}"), ("e3", "other", "u", "snippet", quote), ("e4", "Else", "u", "full_text", "nothing here")]
    claims = [("found", quote, "cache"), ("short", "The cache is", "cache"), ("subject", quote, "engine"), ("none", None, None), ("blank", quote, " "), ("gone", "A quote that no source has had at all", "quote")]
    frame = lambda rows: D.relinked(spark.createDataFrame(claims, "citation_id string, quote string, subject string"), spark.createDataFrame(rows, "evidence_id string, title string, url string, access_status string, body string")).collect()
    assert [tuple(x) for x in frame(evidence)] == [("found", "e2")]
    assert frame([*evidence, ("e5", "Another title", "u", "full_text", quote)]) == []


# ------------------------------------------------------------------ visuals


def test_object_labels(spark):
    cases = {"Table IV": ("table-04", "Table 4"), "Fig. IX": ("figure-09", "Figure 9"), "Table A.1": ("table-a-01", "Table A.1"), "chart No. 12": ("chart-12", "Chart 12"), "diagram 3b": ("diagram-03b", "Diagram 3b"), "Figure S7": ("figure-s-07", "Figure S7"),
             "table 2.10": ("table-02-10", "Table 2.10"), "TABLE IIII": ("table-iiii", "Table IIII"), "  figure 007: x": ("figure-07", "Figure 7"), "FIG 120": ("figure-120", "Figure 120")}
    rows = [(k, "caption", "e") for k in cases] + [(None, "table", "e1"), ("see Table 1", "caption", "e2")]
    got = spark.createDataFrame(rows, "label string, kind string, element string").withColumn("o", X.object_locator(F.col("label"), F.col("kind"), F.col("element"))).collect()
    assert {r.label: tuple(r.o) for r in got[: len(cases)]} == cases
    assert got[-2].o.key.startswith("table-unlabeled-") and got[-1].o.key.startswith("figure-unlabeled-") and got[-1].o.label is None


def test_roman_numbers(spark):
    tens = lambda n, a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c][n]
    rows = [(n, "M" * (n // 1000) + tens(n // 100 % 10, "C", "D", "M") + tens(n // 10 % 10, "X", "L", "C") + tens(n % 10, "I", "V", "X")) for n in range(1, 4000, 7)]
    got = spark.createDataFrame([*rows, (0, "IIX"), (0, ""), (0, "ABC"), (4, "iv")], "n int, x string").withColumn("v", X.roman_number(F.col("x"))).collect()
    assert all((r.v or 0) == r.n for r in got)


def test_visual_ranking(spark):
    item = lambda i, kind, label, text, score=0.5, cells=False, crop=False, box=False: (i, kind, label, None, text, cells, crop, box, score)
    rows = [item("cap", "caption", "Table II", "latency by size", 0.9), item("tab", "table", "Table II", "| latency | 4 ms |", 0.1, cells=True), item("fig", "figure", "Figure 2", "latency 4 ms", 0.8, crop=True), item("txt", "text", None, "Table II says so", 1.0), item("far", "table", None, "nothing", 0.9)]
    frame = spark.createDataFrame(rows, "item_id string, kind string, object_label string, section string, text string, has_cells boolean, has_crop boolean, has_box boolean, score double")

    def ranked(question):
        one = frame.withColumns({"query_id": F.lit(1), "q": F.lit(question), "i": F.struct(*[c for c in frame.columns if c not in ("item_id", "score")])})
        out = V.rank_visuals(one, X.visual_score(F.col("q"), F.col("i"))).filter("visual_rank IS NOT NULL").orderBy("visual_rank")
        return [r.item_id for r in out.collect()]

    assert ranked("What does Table II show?") == ["tab", "cap"]
    assert ranked("Compare the latency at 4 ms") == ["tab", "fig", "cap"]
    assert ranked("tell me about latency") == [] and ranked("What does Figure 9 show?") == [] and ranked(None) == []
    refs = spark.range(1).select(X.visual_references(F.lit("Fig. 3 and TABLE no. iv, 표 5, figure 3")).alias("r")).first().r
    assert refs == ["figure:3", "table:IV", "table:5"]


def test_reserved_visuals(spark):
    rows = [(1, 10, 100, 1, False), (1, 11, 101, 1, False), (1, 12, 101, 1, False), (1, 13, 102, 1, True), (1, 13, 103, 2, True), (2, 20, 5, 1, None), (2, 21, 6, None, True)]
    got = V.reserved_visuals(spark.createDataFrame(rows, "request int, query_id int, item_id int, visual_rank int, explicit boolean"), "request").orderBy("request", "place").collect()
    assert [tuple(r) for r in got] == [(1, 102, 1), (1, 101, 2), (2, 5, 1)]


def test_exact_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ITEM_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    r = np.random.default_rng(5)
    vectors = r.integers(-2, 3, (60, 4)).astype(float)
    vectors[5] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, vector array<double>").repartition(3)
    got = V.dense_top_k(items, items.filter("id % 6 = 0"), 8).collect()
    want = set()
    for q in range(0, 60, 6):
        n = np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors[q])
        scores = np.round(np.divide(vectors @ vectors[q], n, out=np.zeros(60), where=n > 0), 6)
        want |= {(q, i, float(scores[i]), k) for k, i in enumerate(sorted(range(60), key=lambda i: (-scores[i], i))[:8], 1)}
    assert {(x.query_id, x.item_id, x.score, x["rank"]) for x in got} == want


# ------------------------------------------------------------------ quantities


def plain_exact(text):
    sign, digits, power = Decimal(text).as_tuple()
    body = "".join(map(str, digits)).lstrip("0")
    short = body.rstrip("0")
    return "0" if not short else f"{'-' if sign else ''}{short}e{power + len(body) - len(short)}"


def test_exact_numbers(spark):
    texts = ["0", "0.00", "1", "10", "1.50", "150e-2", "12345678901234567890123456789012345678901234567890", "1.0E7", "-2.50", "0.000001", "00012", "3e+4"]
    got = {r.x: r.e for r in spark.createDataFrame([(t,) for t in texts], "x string").withColumn("e", Q.exact(F.col("x"), F.lit(0))).collect()}
    assert got == {t: plain_exact(t) for t in texts}
    assert spark.range(1).select(Q.exact(F.lit("1.5"), F.lit(6)) == Q.exact(F.lit("1500000"), F.lit(0))).first()[0]


METRIC = "struct<value:double,unit:string,currency:string,year:string,market_definition:string,geography:string,actual_or_forecast:string>"
BASE = dict(value=1.2, unit="USD billion", currency="USD", year="2024", market_definition="memory modules", geography="Global", actual_or_forecast="actual")
QUOTE = "The global memory module market was worth US dollars 1,200 million in 2024."


@pytest.mark.parametrize(("change", "quote", "reason"), [
    ({}, QUOTE, "ok"), ({}, QUOTE.replace("module ", ""), "definition"), ({"geography": "Asia"}, QUOTE, "geography"), ({"unit": "EUR billion"}, QUOTE, "currency"), ({"currency": None, "unit": "billion"}, QUOTE, "dimension"),
    ({}, QUOTE.replace("2024", "2023"), "year"), ({}, "Global memory modules grew in 2023; sales were $1.2 billion in 2024", "scope"), ({"market_definition": "memory modules capacity"}, "capacity matters. " + QUOTE, "scope"),
    ({}, QUOTE.replace("market", "capacity"), "capacity"), ({}, QUOTE.replace("was worth", "is projected at"), "forecast"), ({"actual_or_forecast": "forecast"}, QUOTE.replace("was worth", "is projected at"), "ok"), ({"value": 1.21}, QUOTE, "amount"),
    ({}, "Global memory modules: 1.2 billion units in 2024.", "unit"), ({"unit": "billion units", "currency": None}, "Global memory modules: 1.2 billion units in 2024.", "ok"), ({"unit": "percent", "value": 7.0, "currency": None}, "Global memory modules grew 7% in 2024", "ok"),
    ({}, "Worldwide memory modules reached $1.2 billion, while 3 million units shipped; 2024 was a record", "ok"), ({}, None, "definition"), ({"market_definition": None}, QUOTE, "definition"), ({"value": None}, QUOTE, "amount"),
    ({"value": 12345678901234567890.0, "unit": "USD"}, "Global memory modules: $12345678901234567890 in 2024", "amount"), ({"value": 1e20, "unit": "USD"}, "Global memory modules: $100,000,000 trillion in 2024", "ok"),
    ({"value": 2024.54, "unit": "USD million"}, "The global memory modules reached USD 2024.54 million in 2023.", "year"), ({"value": 2024.54, "unit": "USD million"}, "The global memory modules reached USD 2024.54 million in 2024.", "ok"),
])
def test_metric_in_quote(spark, change, quote, reason):
    row = spark.createDataFrame([(tuple((BASE | change).values()), quote)], f"m {METRIC}, q string")
    assert row.select(Q.metric_reason(F.col("m"), F.col("q"))).first()[0] == reason


# ------------------------------------------------------------------ scores in blocks


def plans_no_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_max_sim_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "TOKEN_BLOCK", 5)
    r = np.random.default_rng(6)
    tokens = {i: r.normal(size=(1 + i % 3, 4)) for i in range(23)}
    rows = spark.createDataFrame([(f"d{i}", p, v.tolist()) for i, t in tokens.items() for p, v in enumerate(t)], "id string, pos int, vector array<double>").repartition(3)
    df = V.max_sim(rows, rows.filter("substring(id, 2) % 4 = 0"))
    want = {(f"d{q}", f"d{i}"): float((tokens[q] @ tokens[i].T).max(1).mean()) for q in range(0, 23, 4) for i in range(23)}
    got = {(x.query_id, x.item_id): x.score for x in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and plans_no_pairs(df)


def test_max_sim_copies_few_rows(spark, monkeypatch):
    """what is shuffled grows with the tables, not with the pairs; places with several vectors count once."""
    monkeypatch.setattr(V, "TOKEN_BLOCK", 5)
    monkeypatch.setattr(V, "TOKEN_GROUPS", 4, raising=False)
    r, copied = np.random.default_rng(7), []
    for n in (60, 240):
        tokens = {i: (np.sort(r.integers(0, 3, 1 + i % 4)), r.normal(size=(1 + i % 4, 4))) for i in range(n)}
        rows = spark.createDataFrame([(i, int(p), v.tolist()) for i, (pos, t) in tokens.items() for p, v in zip(pos, t, strict=True)], "id long, pos int, vector array<double>").repartition(2)
        df, before = V.max_sim(rows, rows.filter("id % 4 = 0")), shuffled_rows(spark)
        got = {(x.query_id, x.item_id): x.score for x in df.collect()}
        copied.append(shuffled_rows(spark) - before)
        best = lambda q, i: np.mean([(tokens[q][1][tokens[q][0] == p] @ tokens[i][1].T).max() for p in set(tokens[q][0])])  # noqa: E731, B023
        want = {(q, i): best(q, i) for q in range(0, n, 4) for i in range(n)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert 0 < copied[1] <= 5 * copied[0], copied
    assert V.max_sim(rows, rows.filter("id < 0")).count() == V.max_sim(rows.filter("id < 0"), rows).count() == 0


def test_sparse_top_k_in_blocks(spark, monkeypatch):
    for name, n in (("ITEM_BLOCK", 7), ("QUERY_BLOCK", 2), ("QUERY_GROUP", 4), ("TERM_BLOCK", 3)):
        monkeypatch.setattr(V, name, n)
    r = random.Random(7)
    postings = [(i, r.choice("abcdefghijk"), float(r.randrange(-2, 4))) for i in range(50) for _ in range(r.randrange(4))] + [(3, None, 1.0)]
    items = spark.createDataFrame(postings, "item_id long, term string, weight double").repartition(3)
    asked = items.filter("item_id % 5 = 0").withColumnRenamed("item_id", "query_id")
    got = V.sparse_top_k(items, asked, 6)
    want = V.top_k(V.sparse_scores(items, asked), 6).filter("score IS NOT NULL")
    rows = lambda df: sorted((x.query_id, x.item_id, x.score, x["rank"]) for x in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 30
    # one term that all have: the pairs are met in blocks, not joined
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan


def test_nearest_numbers(spark):
    r = random.Random(8)
    ids = sorted(r.sample(range(-300, 3000), 70)) + [5000, 9000]
    df = V.nearest_numbers(spark.createDataFrame([(i,) for i in ids], "item_id long").repartition(5), F.col("item_id") % 3 == 0, 4)
    want = {(q, i, abs(i - q), k) for q in ids if q % 3 == 0 for k, i in enumerate(sorted(ids, key=lambda i: (abs(i - q), i))[:4], 1)}
    assert {(x.query_id, x.item_id, -x.score, x["rank"]) for x in df.collect()} == want and plans_no_pairs(df)


def test_label_metrics(spark):
    items = spark.createDataFrame([(i, i % 3 if i != 8 else None) for i in range(40)], "item_id long, label int")
    queries = items.filter("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    r = random.Random(9)
    hits = spark.createDataFrame([(q, i, k) for q in range(0, 40, 4) for k, i in enumerate(r.sample(range(40), 12), 1) if q != 4], "query_id long, item_id long, rank int")
    golden = queries.join(items, "label").select("query_id", "item_id")
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "recall", "ndcg").collect())
    assert rows(V.label_metrics(hits, items, queries)) == rows(V.retrieval_metrics(hits, golden))


def test_common_words_are_no_keys(spark, way):
    """Phrases of frequent words meet the texts that have them in a row, names the texts that have both their words."""
    texts = spark.createDataFrame([(i, f" of the house of the {i} men ") for i in range(40)], "id long, text string")
    phrases = spark.createDataFrame([(i, f" of the {i} men ") for i in range(40)], "phrase_id long, phrase string")
    keys = phrases.select("phrase_id", D.phrase_key(F.col("phrase")).alias("k")).select("phrase_id", "k.*")
    assert D._near(texts, keys).count() == 40 == D.contained(texts, phrases).count()
    names = spark.createDataFrame([(i, f"The-{i}") for i in range(40)], "phrase_id long, phrase string")
    assert sorted(map(tuple, D.names_in(texts, names).collect())) == [(i, i) for i in range(40)]
    assert names.select(F.explode(D.name_keys(F.col("phrase"))).alias("k")).filter("k.token = 'the' OR NOT k.sure").count() == 0
