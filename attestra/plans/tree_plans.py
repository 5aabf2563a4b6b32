"""Queries of nested JSON records, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import trees

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _clicks(spark, d):
    return spark.read.parquet(f"{d}/clicks.parquet")


@query("t20_json_fingerprint", """SELECT click_id, count(*) AS n, max(sha256('{' || concat_ws(',', CASE WHEN json_type(props, '$.device') = 'NULL' THEN '"device":null' WHEN json_exists(props, '$.device') THEN '"device":{"os":' || json_extract(props, '$.device.os')::VARCHAR || ',"ver":' || json_extract(props, '$.device.ver')::VARCHAR || '}' END,
  CASE WHEN json_exists(props, '$.items') THEN '"items":' || CASE WHEN json_type(props, '$.items') = 'NULL' THEN 'null' ELSE '[' || coalesce(array_to_string(list_transform(json_extract(props, '$.items[*]'), lambda x: '{"qty":' || json_extract(x, '$.qty')::VARCHAR || ',"sku":' || json_extract(x, '$.sku')::VARCHAR || '}'), ','), '') || ']' END END,
  '"k":' || json_extract(props, '$.k')::VARCHAR, CASE WHEN json_exists(props, '$.tags') THEN '"tags":' || CASE WHEN json_type(props, '$.tags') = 'NULL' THEN 'null' ELSE '[' || coalesce(array_to_string(list_transform(json_extract(props, '$.tags[*]'), lambda x: x::VARCHAR), ','), '') || ']' END END) || '}')) AS digest
FROM clicks WHERE json_valid(props) AND click_id IS NOT NULL GROUP BY click_id""")
def t20(spark, d):
    rows = _clicks(spark, d).select("click_id", trees.fingerprint(F.col("props")).alias("f")).filter("click_id IS NOT NULL AND f IS NOT NULL")
    return rows.groupBy("click_id").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("digest"))


@query("g10_nested_records", """SELECT DISTINCT click_id, 'items.' || i AS path, json_extract_string(x, '$.sku') AS sku, json_extract_string(x, '$.qty') AS qty
FROM (SELECT click_id, unnest(json_extract(props, '$.items[*]')) AS x, unnest(range(len(json_extract(props, '$.items[*]')))) AS i FROM clicks WHERE json_valid(props) AND click_id IS NOT NULL)""")
def g10(spark, d):
    """Bought items in the properties of clicks, wherever they stand, with the way to them."""
    rows = trees.records_in(_clicks(spark, d).filter("click_id IS NOT NULL"), "click_id", F.col("props"), {"sku": "BIGINT", "qty": "BIGINT"}, skip=("tags",))
    return rows.select("click_id", F.array_join("path", ".").alias("path"), F.get_json_object("record", "$.sku").alias("sku"), F.get_json_object("record", "$.qty").alias("qty")).distinct()
