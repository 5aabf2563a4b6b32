"""Relevance rules and bounded choices on literals: nulls, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from attestra.functions import relevance as R
from attestra.operators import selection as S


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_family(spark):
    software = lambda x: R.family_matches(F.lit("sw"), x)
    assert one(spark, software, "KV-cache quantisation", "key value caches are compressed", "browser cache compression", "KV 캐시 압축", "", None) == [True, True, False, True, False, False]
    hardware = lambda x: R.family_matches(F.lit("HW"), x)
    assert one(spark, hardware, "CXL memory pooling for LLMs", "CXL memory pooling", "photonics DRAM tiering, AI", None) == [True, False, True, False]
    assert one(spark, lambda x: R.family_matches(F.lit(None).cast("string"), x), "KV cache compression") == [False]


def test_same_paper(spark):
    paper = F.lit("https://arxiv.org/abs/2401.00001v2")
    got = one(spark, lambda x: R.same_paper(paper, x), "https://mirror.org/pdf/2401.00001.pdf", "https://ARXIV.org/abs/2401.00001v2/", "https://arxiv.org/abs/2401.00002", "%zz", None)
    assert got == [True, True, False, False, False]
    assert one(spark, lambda x: R.same_paper(F.lit("https://a.org/x%20y/"), x), "http://a.org/x y", "https://b.org/x y", "https://a.org") == [True, False, False]


def test_candidates(spark):
    named = lambda x: R.family_candidate(F.lit("SW"), F.lit("RD-KV"), F.lit(""), F.lit(None).cast("string"), x, F.lit(None).cast("string"))
    assert one(spark, named, "On rd kv.", "hard kv", None) == [True, False, False]
    market = lambda level: lambda x: R.market_candidate(F.lit("SW"), F.lit("rdkv"), F.lit("https://arxiv.org/abs/1"), x, F.lit(None).cast("string"), F.lit(level))
    assert one(spark, market(1), "memory of a GPU", "Adoption of a GPU", "rdkv television", "RDKV attention", None) == [False, True, False, True, False]


def test_visual_intent(spark):
    got = one(spark, R.visual_intent, "see Fig. IX", "80 GB", "v2 of a", "12a", "the table", "latency chart", "which throughput", "throughput", "표 3", "", None)
    assert got == [True, True, False, True, True, True, True, False, True, False, False]
    assert one(spark, R.visual_intent, "of the", "그림", "그림 결과") == [False, False, False]


def test_facets_and_topics(spark):
    assert one(spark, R.topic_facet, "Future_work on a dataset", "WORKLOAD", "method", "", None) == ["limitations", "scope"] + ["technical_overview"] * 3
    assert one(spark, R.set_aside_topic, "Table 1: every  row", "Table I every row", "table 1", "the evidence_id", "table 10 every row", None) == [True, False, False, True, False, False]


def test_title_and_abstract(spark):
    assert one(spark, R.title_line, "\n short\n  A long title  \nAnother title", "x\n" * 12 + "A long title", "", None) == ["A long title", None, None, None]
    assert one(spark, R.abstract_part, "ABSTRACT — We\nshow.\n 1. Introduction", "Abstract: a", "Abstract\n\nIntroduction", None) == ["We\nshow.", None, None, None]
    assert one(spark, R.abstract_part, "abstract: a  b\r\n\r\n\r\nc\tend\n2\nintroduction") == ["a b\n\nc end\n2"]
    assert len(one(spark, R.abstract_part, "abstract " + "x" * 9000 + "\nIntroduction")[0]) == 8000


def test_sources(spark):
    rows = [(None, "inherited_source_record", True, "succeeded", "e", None, None), (False, "inherited_source_record", None, "succeeded", "e", None, None),
            (None, "collected_excerpt", None, None, None, True, "web"), (None, "collected_excerpt", None, None, None, True, ""), (True, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "v boolean, h string, s boolean, r string, o string, q boolean, c string")
    assert [r.x for r in df.select(R.source_available(*map(F.col, df.columns)).alias("x")).collect()] == [True, False, True, False, True]


def test_ranking(spark):
    rows = [(1, 0, None, "a", None), (1, 1, "https://github.com/x", "a", ""), (1, 2, None, "Tech cost", "cost"), (1, 3, None, "a", None), (1, 4, None, "price", None)]
    df = spark.createDataFrame(rows, "q int, p int, url string, title string, content string")
    ranked = S.rank_candidates(df, "q", "p", F.lit("tech"), ("business_value",))
    assert [r.p for r in ranked.orderBy("rank").collect()] == [2, 1, 4, 0, 3]
    assert S.rank_candidates(df.limit(0), "q", "p", F.lit("tech"), ("adoption",)).count() == 0


def test_premises(spark):
    rows = [(1, 1, "reduces memory", None), (1, 2, "saves cache latency", ""), (1, 3, "reduced memory", "Abstract"), (1, 4, "memory", None), (1, 5, None, "abstract"), (2, 6, "saves", None)]
    df = spark.createDataFrame(rows, "t int, id int, excerpt string, locator string")
    assert [(r.t, r.id, r.score) for r in S.technical_premises(df, "t", "id").orderBy("rank").collect()] == [(1, 3, 5), (1, 2, 2)]


def test_targets(spark):
    valid = [("a", f"r{i}", "n", "why", i) for i in range(10)]
    rows = valid + [("a", "R0", "late", "why", 11), ("b", "has space", "n", "why", 1), ("b", "x", " \t", "why", 2), ("b", "y", "n", None, 3), ("b", None, "n", "why", 4), ("z", "r", "n", "why", 1), ("b", "x\n", "n", "why", 5)]
    df = spark.createDataFrame(rows, "domain_id string, id string, name string, reason string, p int")
    domains = spark.createDataFrame([("a",), ("b",), ("a",)], "domain_id string")
    got = sorted((r.domain_id, r.id, r.fallback) for r in S.select_targets(df, domains, "p").collect())
    assert got == [("a", f"r{i}", False) for i in range(8)] + [("b", r, True) for r in ("developer", "observer", "operator", "supplier")]
    assert S.select_targets(df, domains.limit(0), "p").count() == 0


def test_deferral(spark):
    opinions = spark.createDataFrame([(q, f"opinion_{i}") for q in range(1, 5) for i in (1, 2)], "q int, item_id string")
    checks = [(1, "opinion_1", "supported"), (1, "opinion_2", None), (1, "opinion_2", "unsupported"), (2, "limitations", "unsupported"), (2, "opinion_1", "unsupported"),
              (3, "opinion_1", "unsupported"), (3, "opinion_2", "unsupported"), (4, "opinion_1", "supported")]
    got = S.defer_rejected(opinions, spark.createDataFrame(checks, "q int, item_id string, verdict string"), "q")
    assert sorted((r.q, r.item_id, r.deferred) for r in got.collect()) == [(1, "opinion_1", False), (1, "opinion_2", True)]
