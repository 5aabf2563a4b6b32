"""Operators without SQL, on literal rows and against brute force."""

import math

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import relations as R
from attestra.operators import retrieval as V
from attestra.sinks import generations
from attestra.streaming import events


def test_mmr_prefers_the_unlike(spark):
    rows = [("q", "best", 1.0, [1.0, 0.0, 0.0]), ("q", "twin", 0.95, [1.0, 0.0, 0.0]), ("q", "other", 0.6, [0.0, 1.0, 0.0])]
    got = V.mmr(spark.createDataFrame(rows, "query_id string, item_id string, score double, vector array<double>"), 2).orderBy("rank").collect()
    assert [(r.item_id, r["rank"]) for r in got] == [("best", 1), ("other", 2)]


def test_mmr_against_a_loop(spark):
    d = "/root/testdata/sf0.001"
    from attestra.plans import relational_plans as P

    got = {}
    for r in P.r8(spark, d).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    vec = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
    for q in sorted(got)[:3]:
        ranked = sorted(((round(cos(vec[q], v), 6), i) for i, v in vec.items()), key=lambda t: (-t[0], t[1]))[:32]
        top, chosen, left = ranked[0][0], [], dict((i, s) for s, i in ranked)
        while len(chosen) < 8:
            value = lambda i: round(0.7 * left[i] / top - 0.3 * max((round(cos(vec[i], vec[c]), 6) for c in chosen), default=0.0), 9)
            best = min(left, key=lambda i: (-value(i), -left[i], i))
            chosen.append(best)
            del left[best]
        assert [got[q][k] for k in range(1, 9)] == chosen


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 3)], "query_id int, item_id int, rank int")
    golden = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "query_id int, item_id int")
    r = V.retrieval_metrics(hits, golden).first()
    assert r.recall == round(2 / 3, 6)
    assert abs(r.ndcg - (1 + 0.5) / (1 + 1 / math.log2(3) + 0.5)) < 1e-5


def test_packing_skips_and_continues(spark):
    rows = spark.createDataFrame([("a", 1, 50), ("a", 2, 60), ("a", 3, 40), ("a", 4, 20)], "g string, pos int, size long")
    got = {r.pos: r.kept for r in R.pack(rows, "g", ["pos"], "size", 100).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_text_functions(spark):
    row = spark.createDataFrame([("  A\r\n\r\n\r\n\r\nB\x00c ", "see [x](http://a.b/c) http://d.e", "IDs v1.2x and 1,234 of 5")], "a string, b string, c string")
    r = row.select(T.normalize_text(F.col("a")).alias("a"), T.visible_text(F.col("b")).alias("b"), T.numeric_tokens(F.col("c")).alias("c")).first()
    assert r.a == "A\n\nB c" and r.b == "see x" and r.c == ["1234", "5"]


def test_generations(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = spark.range(3), spark.range(4)
    assert generations.publish(one, path) == ("0", True)
    assert generations.publish(one, path) == ("0", False)
    assert generations.publish(two, path) == ("1", True)
    assert generations.read_active(spark, path).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    folder = str(tmp_path / "in")
    spark.read.parquet(src).repartition(1).sortWithinPartitions("ts").write.parquet(folder)
    q = events.windowed_counts(events.event_stream(spark, folder), lateness="40 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.window_start, r.event_type): r.n for r in events.windowed_counts(spark.read.parquet(folder)).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def flags(spark, texts, rule):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", rule(F.col("x")).alias("y")).orderBy("i")
    return [r.y for r in rows.collect()]


def test_text_rules(spark):
    headings = ["Abstract", "2.1 Future Work", "LIMITATIONS", "3 RESULTS & SCOPE", "4. Any words here", "Plain sentence here", "x" * 101, "References are no name"]
    assert flags(spark, headings, T.is_heading) == [True, True, True, True, True, False, False, False]
    assert flags(spark, ["5 neural layers", "5 USD", "5 usdx", "no number, $", "3 million", "12%"], T.quantitative_claim) == [False, True, False, False, True, True]
    urls = ["HTTPS://A.example.com", "https://A.example.com/b/#c", "https://a.example.com?q=1"]
    assert flags(spark, [u.replace("HTTPS", "https") for u in urls], T.canonical_url) == ["https://a.example.com/", "https://a.example.com/b/", "https://a.example.com/?q=1"]
    guarded = ["https://example.com/x", "http://172.20.1.2/", "http://172.32.1.2/", "http://169.254.1.1/", "http://[::1]/", "http://u:p@example.com/", "http://a.localhost/", "ftp://example.com"]
    assert flags(spark, guarded, T.public_url) == [True, False, True, False, False, False, False, False]
    assert flags(spark, [None, " TBD ", "none", "미확인", "text"], T.is_missing) == [True, True, False, True, False]
