"""Queries that read a published index, with SQL for what has to be active in it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestra.sinks import document_index
from attestra.tables import shared_folder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_PROFILE = {"embedding": "none", "chunks": "lines", "version": 1}
_MARK = document_index.profile_fingerprint(_PROFILE)


@query("r12_document_index", f"""WITH v AS (SELECT doc_id, source, text, 1 AS version FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND doc_id % 5 <> 4
  UNION ALL SELECT doc_id, source, text || ' (again)', 2 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND doc_id % 5 >= 3),
n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1),
c AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM n),
r AS (SELECT source, doc_id, sha256('{{"chunk_no":' || i || ',"sha":"' || sha256(line) || '"}}') AS row FROM c),
p AS (SELECT source, doc_id, row[1:3] AS part, sha256(string_agg(row, chr(10) ORDER BY row)) AS digest, count(*) AS n FROM r GROUP BY ALL),
w AS (SELECT source, doc_id, sha256(string_agg(part || digest, chr(10) ORDER BY part || digest)) AS digest, sum(n)::BIGINT AS n_chunks FROM p GROUP BY ALL)
SELECT source AS source_kind, doc_id AS document_id, sha256(concat_ws(chr(31), '{_MARK}', source, doc_id::VARCHAR, digest))[1:24] AS generation, n_chunks FROM w""")
def r12(spark, d):
    """Four fifths of the documents are published, then new and changed ones, then the same again; what is active then."""
    path = f"{shared_folder(spark)}/attestra/index-{uuid.uuid4().hex[:12]}"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("source IS NOT NULL AND text IS NOT NULL")
    batches = [docs.filter("doc_id % 5 <> 4"), docs.filter("doc_id % 5 >= 3").withColumn("text", F.concat("text", F.lit(" (again)")))]
    for batch in (*batches, batches[1]):
        rows = batch.select(F.col("source").alias("source_kind"), F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_no", "line"))
        document_index.upsert(rows.select("source_kind", "document_id", "chunk_no", F.sha2("line", 256).alias("sha")), path, _PROFILE)
    active = document_index.read_active(spark, path)
    if active is None:
        return spark.createDataFrame([], "source_kind string, document_id long, generation string, n_chunks long")
    return active.groupBy("source_kind", "document_id", "generation").agg(F.count(F.lit(1)).alias("n_chunks"))
