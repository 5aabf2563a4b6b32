"""Record rules and gated retrieval on literals: nulls, ties, empty tables."""

import datetime

import numpy as np

from pyspark.sql import functions as F

from attestra.functions import records as f
from attestra.operators import records as O
from attestra.operators import retrieval as V
from attestra.plans import record_plans


def one(spark, column, *values):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_dates(spark):
    day = datetime.date(2024, 3, 5)
    texts = ["2024-03-05", "2024-03-05T10:00:00", "Tue, 05 Mar 2024 23:59:59 -0800", "March 5, 2024", "Mar 5 2024", "5 March 2024", "2024.3.5", "2024년 3월 5일"]
    assert one(spark, f.normalized_date, *texts) == [day] * len(texts)
    assert one(spark, f.normalized_date, None, "", "soon", "2024-13-40") == [None] * 4


def test_quantities(spark):
    got = one(spark, f.scaled_quantities, "3 million and 3,000,000 or 1.5 thousand", "x9 3억", "", None, "9" * 30)
    assert got == [["15e2", "3e6"], ["3e8"], [], [], ["9" * 30 + "e0"]]
    assert one(spark, f.scaled_quantities, "12345678901234567890 million 7 0.50 0 0.5") == [["0", "5e-1", "7e0", "1234567890123456789e7"]]


def test_missing_and_units(spark):
    assert one(spark, f.blank_missing, None, " N/A ", "미확인", " a ") == ["", "", "", "a"]
    assert one(spark, f.currency, "US Dollars", "€", "yen", None) == ["USD", "EUR", None, None]
    assert one(spark, f.scale, "USD billion", "billions", None) == [10**9, 1, 1]
    assert one(spark, f.dimension, "5 %", "modules", "USD", None) == ["percent", "count", None, None]


def test_criteria(spark):
    got = one(spark, f.relevant_criteria, "no cost to efficiency", "hardware-supported bit-widths", "Customers like JEDEC", "", None)
    assert got == [[], [], ["adoption", "standardization"], [], []]


def test_tables(spark):
    rows = [(1, 0, ["a", "b"], False), (1, 1, ["c", None], False), (2, 0, [" ", None], True), (2, 1, ["x", "y"], True), (3, 0, ["a", "b"], True), (4, 0, [], True), (5, 0, ["a", ""], False), (5, 1, ["b", ""], False)]
    df = spark.createDataFrame(rows, "t int, row_index int, cells array<string>, captioned boolean")
    assert {r.t: r.useful for r in O.useful_tables(df, "t").collect()} == {1: True, 2: False, 3: False, 5: False}
    assert O.useful_tables(df.limit(0), "t").count() == 0


def test_aliases(spark):
    refs = spark.createDataFrame([("a1",), ("sw::a1",), ("sw::z",), ("z",), (None,)], "ref string")
    aliases = spark.createDataFrame([("a1", "e1")], "alias string, target string")
    got = {r.ref: r.resolved for r in O.resolve_aliases(refs, aliases).collect()}
    assert got == {"a1": "e1", "sw::a1": "e1", "sw::z": "z", "z": "z", None: None}


def test_gate(spark):
    # the best visual takes the last slot though another one is inside; query 2 has its best one inside, query 3 none at all
    best = {(1, 2): 2, (1, 5): 1, (1, 6): 3, (2, 1): 1, (2, 4): 2}
    rows = [(q, i, 1.0 / i, best.get((q, i))) for q in (1, 2, 3) for i in range(1, 7)]
    got = V.candidate_gate(spark.createDataFrame(rows, "query_id int, item_id int, score double, visual_rank int"), 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("slot", "item_id"))).alias("x"))
    assert {r.query_id: [tuple(x) for x in r.x] for r in got.collect()} == {1: [(1, 1), (2, 2), (3, 5)], 2: [(1, 1), (2, 2), (3, 3)], 3: [(1, 1), (2, 2), (3, 3)]}


def test_rerank_ignores_fused_order(spark):
    gate = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id int, item_id int")
    tokens = spark.createDataFrame([(0, [[1.0, 0.0]]), (1, [[0.0, 1.0]]), (2, [[0.5, 0.0], [1.0, 0.0]]), (3, [[1.0, 0.0]])], "id int, tokens array<array<double>>")
    got = V.rerank(gate, tokens).orderBy("rank").collect()
    assert [(r.item_id, r.max_sim) for r in got] == [(2, 1.0), (3, 1.0), (1, 0.0)]
    fused = V.multi_query_fusion(V.rerank(gate, tokens).withColumn("request", F.lit(7)), "request").orderBy("rank").collect()
    assert [r.item_id for r in fused] == [2, 3, 1]


def test_reserve(spark):
    selected = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)] + [(2, i, i) for i in (1, 2)] + [(3, 9, 1)], "query_id int, item_id int, rank int")
    reserved = spark.createDataFrame([(1, 3, 5), (1, 7, 9), (2, 1, 1), (2, 2, 2), (2, 5, 3)], "query_id int, item_id int, place int")
    got = V.reserve(selected, reserved).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("x"))
    assert {r.query_id: [x.item_id for x in r.x] for r in got.collect()} == {1: [1, 3, 7], 2: [1, 2], 3: [9]}


def test_full_retrieval(spark):
    """Greedy selection and reservation, written out, over the fused lists."""
    d = "/root/testdata/sf0.001"
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    cosine = lambda a, b: round(float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])), 6)
    fused, held, got = {}, {}, {}
    for r in record_plans.r7(spark, d).orderBy("rank").collect():
        fused.setdefault(r.request, {})[r.item_id] = r.score
    for r in record_plans.r10(spark, d).collect():
        held.setdefault(r.request, set()).add(r.item_id)
    for r in record_plans.r11(spark, d).orderBy("rank").collect():
        got.setdefault(r.request, []).append(r.item_id)
    assert held and got
    for request, scores in fused.items():
        chosen, top = [], max(scores.values())
        while len(chosen) < min(8, len(scores)):
            worth = lambda x: round(0.7 * scores[x] / top - 0.3 * max([cosine(x, c) for c in chosen], default=0.0), 9)  # noqa: B023, E731
            chosen.append(min((x for x in scores if x not in chosen), key=lambda x: (-worth(x), -scores[x], x)))  # noqa: B023
        lacking = [x for x in scores if x in held.get(request, set()) - set(chosen)]
        free = [x for x in chosen if x not in held.get(request, set())]
        out = set(free[len(free) - len(lacking):]) if lacking else set()
        assert got[request] == [x for x in chosen if x not in out] + lacking


def test_iso_forms_and_months_in_any_case(spark):
    from datetime import date

    texts = ["20240229", "2024-W01-1", "2024-W53", "2020W537", "2020-W53-7", "2021-W01", "20240230", "2024-W00-1", "2023-12-31T10:00:00", "JANUARY 5, 2024", "5 feb 2024", "Fri, 05 jan 2024 10:00:00 +0000", "W01", "2024-W01-8", None]

    def plain(t):
        try:
            return date.fromisoformat(t[:10]) if "-" in t or "W" in t or t.isdigit() else None
        except ValueError:
            return None

    want = [plain(t) if t else None for t in texts]
    want[9:12] = [date(2024, 1, 5), date(2024, 2, 5), date(2024, 1, 5)]
    assert one(spark, f.normalized_date, *texts) == want
