"""Queries of the chunk operators over elements of documents and rows of tables, each with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra import config
from attestra.operators import blocks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')"
_PAGE = 24  # lines that the queries take for a page


@query("g4_block_coalescing", f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i, text, i // {_PAGE} AS page, CASE WHEN length(text) % 13 = 5 THEN 'figure' ELSE 'text' END AS kind, CASE WHEN length(text) % 11 <> 0 THEN length(text) END AS x1, {_TOKENS.format("text")} AS w FROM l),
f AS (SELECT doc_id, i, page, kind, w AS s, i AS first FROM e WHERE i = 0
  UNION ALL SELECT e.doc_id, e.i, e.page, e.kind, CASE WHEN n.fresh THEN e.w ELSE f.s + e.w END, CASE WHEN n.fresh THEN e.i ELSE f.first END
  FROM f JOIN e ON e.doc_id = f.doc_id AND e.i = f.i + 1, LATERAL (SELECT e.kind <> 'text' OR f.kind <> 'text' OR e.page <> f.page OR f.s + e.w > {config.CHUNK_TOKENS} AS fresh) n),
g AS (SELECT doc_id, first, count(*) AS elements, any_value(e.kind) AS kind, any_value(e.page) AS page, sum(w)::BIGINT AS tokens, string_agg(text, chr(10) || chr(10) ORDER BY i) AS joined, count(x1) AS boxes, max(x1) AS x1 FROM f JOIN e USING (doc_id, i) GROUP BY doc_id, first)
SELECT doc_id, first, kind, page, elements, tokens, sha256(CASE WHEN elements > 1 THEN {_NORMAL.format("joined")} ELSE joined END) AS sha, CASE WHEN boxes = elements THEN x1 END AS right_edge FROM g""")
def g4(spark, d):
    """Lines are elements, two dozen of them a page; lines of some lengths stand in for figures or have no box."""
    lines = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    n = F.length("text")
    box = F.when(n % 11 != 0, F.struct(F.lit(0.0).alias("x0"), F.col("at").cast("double").alias("y0"), n.cast("double").alias("x1"), (F.col("at") + 1).cast("double").alias("y1")))
    none = F.lit(None).cast("string")
    elements = lines.select("doc_id", F.col("at").cast("long").alias("at"), F.when(n % 13 == 5, "figure").otherwise("text").alias("kind"), "text", F.floor(F.col("at") / _PAGE).alias("page"), none.alias("section"), none.alias("printed_page"),
                            F.concat_ws("-", "doc_id", "at").alias("element_id"), none.alias("parent_element_id"), box.alias("bbox"))
    out = blocks.coalesce_blocks(elements, "doc_id", "at", config.CHUNK_TOKENS)
    return out.select("doc_id", "first", "kind", "page", "elements", "tokens", F.sha2("text", 256).alias("sha"), F.col("bbox.x1").cast("long").alias("right_edge"))


_HEADER = "| key | name | segment | balance |\n| --- | --- | --- | --- |"
_ROW = "'| ' || c_custkey || ' | ' || c_name || ' | ' || coalesce(c_mktsegment, '') || ' | ' || round(c_acctbal * 100)::BIGINT || ' |'"
_HEAD_TOKENS = 9 + 5 + 12


@query("g2_table_row_groups", f"""WITH RECURSIVE r AS (SELECT c_nationkey, c_custkey, {_ROW} AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
h AS (SELECT *, {_TOKENS.format("line")} AS w, {_TOKENS.format("'" + _HEADER + "'")} AS h FROM r),
f AS (SELECT c_nationkey, i, w AS s, c_custkey AS first FROM h WHERE i = 1
  UNION ALL SELECT h.c_nationkey, h.i, CASE WHEN f.s + h.w + h.h > {config.CHUNK_TOKENS} THEN h.w ELSE f.s + h.w END, CASE WHEN f.s + h.w + h.h > {config.CHUNK_TOKENS} THEN h.c_custkey ELSE f.first END
  FROM f JOIN h ON h.c_nationkey = f.c_nationkey AND h.i = f.i + 1)
SELECT c_nationkey, first, count(*) AS n_rows, (sum(w) + any_value(h))::BIGINT AS tokens, sha256('{_HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY i)) AS sha FROM f JOIN h USING (c_nationkey, i) GROUP BY c_nationkey, first""")
def g2(spark, d):
    """A nation's customers are one table, however many."""
    rows = spark.read.parquet(f"{d}/customer.parquet")
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    line = F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), "c_name", F.lit(" | "), F.coalesce("c_mktsegment", F.lit("")), F.lit(" | "), cents, F.lit(" |"))
    out = blocks.table_row_groups(rows, "c_nationkey", "c_custkey", line, F.lit(_HEADER), config.CHUNK_TOKENS, config.CHUNK_HARD_LIMIT)
    return out.select("c_nationkey", "first", "n_rows", "tokens", F.sha2("text", 256).alias("sha"))


@query("g1_boundary_chunks")
def g1(spark, d):
    """Windows of whole texts cut at natural boundaries; tests hold them against a search over all cuts."""
    out = blocks.boundary_chunks(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", config.CHUNK_TOKENS, config.CHUNK_OVERLAP)
    return out.select("doc_id", "chunk_no", "start", "end", F.sha2("chunk", 256).alias("sha"))
