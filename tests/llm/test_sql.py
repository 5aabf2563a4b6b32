"""Queries with SQL give DuckDB's rows on the smallest tables and on a table of hard cases."""

import duckdb
import pytest

from attestra.llm import queries

DIR = "/root/testdata/sf0.001"


def compare(got, rel):
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(rel.columns)
    key = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert key([r.asDict() for r in got]) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "clicks"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    compare(queries.QUERIES[name](spark, DIR).collect(), con.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", ["op2_secret_scan", "op6_quality_rules", "op11_fill_in_middle"])
def test_hard_rows(spark, hard, tmp_path, name):
    hard.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(queries.QUERIES[name](spark, str(tmp_path)).collect(), con.sql(queries.ORACLES[name]))
