"""Hand-off operators on literals: nulls, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from attestra.functions import relevance as R
from attestra.operators import handoff as H
from attestra.operators import relations


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_about_extraction(spark):
    got = one(spark, R.about_extraction, "Malformed evidence-id in the output", "malformed evidence ids in the output", "evidence id malformed", "a PREVIOUS  draft_json", "", None)
    assert got == [True, False, False, True, False, False]


def test_stated_baseline(spark):
    mean = lambda x: R.stated_baseline(F.lit("mean"), x, F.lit("b"))
    assert one(spark, mean, "the 1.5 TB PF memory appliance baseline", "2tb baseline", "v2 TB baseline", "2 TB a b c d baseline", "2 TB baselines", None) == ["1.5 TB baseline", "2tb baseline", "b", "b", "b", "b"]
    assert one(spark, lambda x: R.stated_baseline(F.lit("Speedup ratio"), x, F.lit(None).cast("string")), "2 TB baseline") == [None]
    assert one(spark, lambda x: R.stated_baseline(F.lit(None).cast("string"), x, F.lit("b")), "2 TB baseline") == ["2 TB baseline"]


def test_quote_budget(spark):
    rows = [(1, "u", "a " * 20, 1), (1, "u", "not the first", 2), (2, "u", "b " * 10, 3), (3, "u", "c", 4), (4, None, "d " * 30, 5), (5, None, None, 6), (6, "5", " e f ", 7)]
    refs = spark.createDataFrame(rows, "evidence_id int, url string, quote string, p int")
    got = {r.evidence_id: (r.excerpt, r.truncated) for r in H.quoted_excerpts(refs, "p").collect()}
    words = lambda w, n: " ".join([w] * n)
    assert got == {1: (words("a", 20), False), 2: (words("b", 5), True), 3: (None, True), 4: (words("d", 25), True), 5: (None, False), 6: ("e f", False)}
    assert H.quoted_excerpts(refs.limit(0), "p").count() == 0


def test_quotes(spark):
    claims = spark.createDataFrame([(1, 1, "Acme", "s", "measured", "direct"), (2, 2, None, "s", None, "direct"), (3, 9, "Acme", "s", "projection", "direct"), (4, 3, "Acme", None, "inference", "direct"), (5, None, "a", "s", None, "direct")], "c int, quote_id int, name string, statement string, level string, basis string")
    bank = spark.createDataFrame([(1, "e1", "it is", "by ACME"), (2, "e2", "it may be", None), (3, "e9", "x", None)], "quote_id int, evidence_id string, text string, context string")
    evidence = spark.createDataFrame([("e1", "provided_summary"), ("e2", None)], "evidence_id string, access_status string")
    got = {r.c: (r.evidence_id, r.identity, r.statement, r.basis, r.conditions) for r in H.resolve_quotes(claims, bank, evidence).collect()}
    assert got[1] == ("e1", "ACME", H.SUMMARY + ": s", "direct", [H.PREMISE])
    assert got[2] == ("e2", "", H.PUBLISHER + ": s", "inference", [H.POSSIBILITY])
    assert got[3] == ("unknown_quote:9", "", "s", "direct", [])
    assert got[4] == ("unknown_quote:3", "", None, "inference", [H.POSSIBILITY])
    assert got[5][1:] == ("", "s", "direct", []) and len(got) == 5


def test_recovery(spark):
    item = "struct<statement:string,basis:string,relation:string,citations:array<string>>"
    rows = [(1, "grounded", [("a", "direct", "same", ["x"]), ("b", "unknown", "same", ["x"]), ("c", "direct", None, ["x"]), ("d", "direct", "same", ["x", "y"]), ("e", "direct", "same", None)]), (2, "model", [("a", "direct", "same", ["x"])]), (3, "grounded", None)]
    df = spark.createDataFrame(rows, f"k int, mode string, items array<{item}>")
    assert [(r.k, r.statement, r.citation) for r in H.recovered_claims(df, ["k"]).collect()] == [(1, "a", "x")]


def test_selectors(spark):
    selectors = spark.createDataFrame([(s, i) for i, s in enumerate("cabde")], "s string, p int")
    matches = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 2), ("e", 2)], "s string, paper int")
    got = {r.s: (r.verdict, r.paper) for r in H.checked_selectors(selectors, matches, "s", "paper", "p").collect()}
    assert got == {"a": ("one", 1), "b": ("shared", 1), "c": ("many", None), "d": ("none", None), "e": ("one", 2)}


def test_draft_evidence(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    papers = spark.createDataFrame([(r, "p", sha("p")) for r in range(1, 7)], "run int, paper_id string, source_hash string")
    common = spark.createDataFrame([("c", sha("c"))], "document_id string, source_hash string")
    good, shared = ("paper:p@" + sha("p")[:12] + ":1", "paper", "p", sha("p"), "s", sha("s")), ("common:c@" + sha("c")[:12] + ":1", "common", "c", sha("c"), "s", sha("s"))
    rows = [(1, *good), (1, *shared), (2, *good), (2, *good), (3, *good[:5], None), (4, "paper:q", *good[1:]), (5, *shared[:2], "z", *shared[3:])]
    evidence = spark.createDataFrame(rows, "run int, evidence_id string, kind string, document_id string, document_hash string, snippet string, content_hash string")
    assert {r.run: r.matches for r in H.matching_evidence(evidence, papers, common, "run").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_domain_contract(spark):
    rows = [(1, "favorable", "matched", ["a"], ["a"]), (1, "favorable", None, ["a"], ["a"]), (1, "unfavorable", "matched", ["a"], ["a"]), (1, "conditional", None, None, None), (1, "unknown", None, ["z"], None), (1, "failed", None, [], ["a"]), (2, "unknown", None, None, ["a"]), (2, "not_applicable", None, [], []), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "t int, judgment string, alignment string, evidence_ids array<string>, allowed_ids array<string>")
    judged = H.judged_criteria(df)
    assert [r.error for r in judged.collect()] == [None, "favorable_unmatched", "unfavorable_without_conflict", "evidence_required", "foreign_evidence", "failed_by_model", None, None, None]
    assert {r.t: (r.status, r.valid) for r in H.technology_status(judged, ["t"]).collect()} == {1: ("completed", False), 2: ("unknown", True), 3: ("completed", True)}


def test_audit_scopes(spark):
    opinions = spark.createDataFrame([(1, "o", [("a", 1), ("a", 1), ("a", 9), (None, 1)]), (2, "o", None)], "q int, item_id string, refs array<struct<kind:string,ref:int>>")
    registry = spark.createDataFrame([(1, "a", 1), (1, "e", 2), (1, "e", 2), (2, "a", 9), (3, "a", 1)], "q int, kind string, ref int")
    got = sorted((r.q, r.item_id, r.kind, r.ref) for r in H.audit_scopes(opinions, registry, "q").collect())
    assert got == [(1, "limitations", "a", 1), (1, "limitations", "e", 2), (1, "o", "a", 1), (2, "limitations", "a", 9)]


def test_selectors_of_groups(spark):
    """A group of papers is its least and greatest; the verdicts are those of the single matches."""
    selectors = spark.createDataFrame([(i, 10 - i) for i in range(8)], "selector int, position int")
    pairs = [(0, 5), (0, 6), (1, 7), (1, 7), (2, 7), (3, 8), (4, 9), (4, 1), (6, 2)]
    groups = spark.createDataFrame([(0, 5, 6), (1, 7, 7), (2, 7, 7), (3, 8, 8), (4, 1, 9), (6, 2, 2)], "selector int, paper int, last int")
    rows = lambda df: sorted(map(tuple, df.select("selector", "verdict", "paper").collect()))
    got = rows(H.checked_selectors(selectors, groups, "selector", "paper", "position", "last"))
    assert got == rows(H.checked_selectors(selectors, spark.createDataFrame(pairs, "selector int, paper int"), "selector", "paper", "position"))
    assert got == [(0, "many", None), (1, "shared", 7), (2, "one", 7), (3, "one", 8), (4, "many", None), (5, "none", None), (6, "one", 2), (7, "none", None)]


def test_pairs_within_a_group(spark):
    rows = spark.createDataFrame([(i, "b" if i % 9 == 0 else "a") for i in range(60)] + [(70, None), (None, "a")], "n int, kind string").repartition(3)
    df = relations.pairs_within(rows, "kind", "n", 7)
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if (i % 9 == 0) == (j % 9 == 0))
    assert sorted((x.a.n, x.b.n) for x in df.collect()) == want
    # the large group is in many tasks
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 20


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(relations, "ROWS_A_TASK", 100)
    assert relations.spread(spark.range(1000), "id").rdd.getNumPartitions() == 10 and relations.spread(spark.range(0), "id").count() == 0
    registry = spark.createDataFrame([(i % 50, "assessment", i) for i in range(400)] * 2, "run int, kind string, ref int")
    opinions = spark.createDataFrame([(i, "o", [("assessment", i), ("assessment", i), ("assessment", -1)]) for i in range(20)], "run int, item_id string, refs array<struct<kind:string,ref:int>>")
    got = H.audit_scopes(opinions, registry, "run")
    want = {(i, "o", "assessment", i) for i in range(20)} | {(i % 50, "limitations", "assessment", i) for i in range(400) if i % 50 < 20}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
