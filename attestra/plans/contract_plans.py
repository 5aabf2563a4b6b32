"""Queries of contract documents, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.sources import contracts

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("s12_contract_tables", """WITH c AS (SELECT client_id, coalesce(trim(min(name)), '') AS name, coalesce(trim(min(city)), '') AS city, coalesce(trim(min(segment)), '') AS segment, coalesce(trim(min(source)), '') AS source, client_id % 6 AS k FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
p AS (SELECT client_id, unnest([1, 2, 3])::INT AS row, unnest(['name', 'city', 'a|b']) AS key, unnest([name, city, segment]) AS value FROM c WHERE k IN (0, 1, 4))
SELECT client_id, 'Profile' AS section, row, 'key' AS column, key AS cell, NULL AS error, (row + 4)::INT AS line FROM p UNION ALL SELECT client_id, 'Profile', row, 'value', value, NULL, (row + 4)::INT FROM p
UNION ALL SELECT client_id, 'Origin', 1, 'source', source, NULL, 14 FROM c WHERE k <> 4
UNION ALL SELECT client_id, CASE k WHEN 4 THEN 'Origin' ELSE 'Profile' END, NULL, NULL, NULL, CASE k WHEN 2 THEN 'duplicate_section' WHEN 3 THEN 'columns' WHEN 4 THEN 'missing_section' ELSE 'header' END, CASE k WHEN 2 THEN 15 WHEN 3 THEN 6 WHEN 5 THEN 2 END FROM c WHERE k >= 2""")
def s12(spark, d):
    """A document for each client: a table of properties, a fence that spells a heading, a table of origin; some are broken."""
    rows = spark.read.parquet(f"{d}/clients.parquet").filter("client_id IS NOT NULL").groupBy("client_id").agg(*[F.min(c).alias(c) for c in ("name", "city", "segment", "source")])
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    k = F.col("client_id") % 6
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Client "), "client_id"), F.lit("## Profile ##"), F.when(k == 5, "| key | val |").otherwise("| key | value |"), F.lit("| --- | :-: |"), F.concat(F.lit("| name | "), cell("name"), F.lit(" |")),
        F.concat(F.lit("  | city | "), cell("city"), F.when(k == 3, " | more |").otherwise(" |")), F.concat(F.lit("| a\\|b | "), cell("segment"), F.lit(" |")), F.lit("```text"), F.lit("## Profile"), F.lit("~~~ ```"),
        F.lit("```"), F.when(k == 4, "## Else").otherwise("## Origin"), F.lit("| source |"), F.concat(F.lit("| "), cell("source"), F.lit(" |")), F.when(k == 2, "## Profile"),
    )
    return contracts.contract_tables(rows.select("client_id", text.alias("text")), "client_id", F.col("text"), {"Profile": ["key", "value"], "Origin": ["source"]})
