"""Queries do the whole job: rows that a smaller one would leave out or link wrongly."""

from attestra.plans import evidence_plans, relational_plans

DIR = "/root/testdata/sf0.001"


def test_dossier_has_every_reference(spark):
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{DIR}/orders.parquet").collect()}
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    want = {(orders[r.l_orderkey], str(r.l_partkey)) for r in lines if r.l_orderkey in orders}
    got = evidence_plans.QUERIES["d23_whole_dossier"](spark, DIR).collect()
    assert {(r.o_custkey, p) for r in got for p in r.parts.split(",")} == want


def test_quotes_are_compared_whole(spark, tmp_path):
    head = "x" * 59 + "y"
    spark.createDataFrame([(1, head + " tail"), (2, "short"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, f"a {head} tail b"), (11, f"{head} other"), (12, "a short one"), (13, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = relational_plans.QUERIES["j15_quote_containment"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(1, 10), (2, 12)]
