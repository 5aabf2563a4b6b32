"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from attestra.plans import chunk_plans, contract_plans, evidence_plans, handoff_plans, index_plans, locator_plans, match_plans, record_plans, relational_plans, relevance_plans, text_plans, tree_plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SQL = text_plans.ORACLES | chunk_plans.ORACLES | locator_plans.ORACLES | index_plans.ORACLES | match_plans.ORACLES | tree_plans.ORACLES | contract_plans.ORACLES | relational_plans.ORACLES | evidence_plans.ORACLES | record_plans.ORACLES | relevance_plans.ORACLES | handoff_plans.ORACLES
RUN = text_plans.QUERIES | chunk_plans.QUERIES | locator_plans.QUERIES | index_plans.QUERIES | match_plans.QUERIES | tree_plans.QUERIES | contract_plans.QUERIES | relational_plans.QUERIES | evidence_plans.QUERIES | record_plans.QUERIES | relevance_plans.QUERIES | handoff_plans.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(data, columns):
    def plain(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 5)
        return x

    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = [r.asDict() for r in RUN[name](spark, DIR).collect()]
    rel = duck.sql(SQL[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(rel.columns)
    if got:
        assert sorted(got[0]) == columns
    assert rows(got, columns) == rows(want, columns)
