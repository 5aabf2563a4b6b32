"""Queries of precise evidence, context around visuals, segments and quotes, each with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import numbers
from attestra.operators import locators, segments
from attestra.tables import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_WORDS = "('zero', '0'), ('one', '1'), ('two', '2'), ('three', '3'), ('four', '4'), ('five', '5'), ('six', '6'), ('seven', '7'), ('eight', '8'), ('nine', '9'), ('ten', '10')"


@query("t12_normalized_numbers", rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9.\-])([-+]?(?:[0-9]{{1,3}}(?:[, ][0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?(?:\s*[×xX%])?)', 1)) AS raw FROM t),
p AS (SELECT doc_id, CASE WHEN contains(raw, ',') AND NOT regexp_matches(raw, '^[-+]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?[×xX% ]*$') THEN string_split(raw, ',') ELSE [raw] END AS parts FROM n),
a AS (SELECT doc_id, replace(lower(regexp_replace(unnest(parts), '[\s,]', '', 'g')), 'x', '×') AS v FROM p
  UNION SELECT doc_id, w.n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')) AS word FROM t) JOIN (VALUES {_WORDS}) w(word, n) USING (word))
SELECT doc_id, list_sort(list_distinct(list(v))) AS numbers FROM a GROUP BY doc_id""")
def t12(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_sort(numbers.normalized_numbers(F.col("text"))).alias("numbers"))
    return rows.filter(F.size("numbers") > 0)


# ------------------------------------------------------------------ lines of sales as evidence

_LINES = """i AS (SELECT item_id, min(name) AS name, min(brand) AS brand, min(kind) AS kind FROM items GROUP BY item_id),
l AS (SELECT sale_id, line_no, min(item_id) AS item_id, min(vendor_id) AS vendor_id, min(quantity) AS quantity, round(min(amount) * 100)::BIGINT AS cents, min(flag) AS flag FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL GROUP BY sale_id, line_no),
e AS (SELECT sale_id, line_no, line_no // 10 AS page, 'e' || (line_no % 4) AS element, flag = 'kept' AS precise, cents, quantity, coalesce(name, '') || ' of brand ' || coalesce(brand, '') || ' and kind ' || coalesce(kind, '') AS goods, flag, vendor_id FROM l LEFT JOIN i USING (item_id))"""


def _lines(spark, d):
    """Evidence: a passage for each line of a sale; those kept have exact places."""
    own = lambda *c: [F.min(x).alias(x) for x in c]
    items = spark.read.parquet(f"{d}/items.parquet").groupBy("item_id").agg(*own("name", "brand", "kind"))
    lines = spark.read.parquet(f"{d}/sale_lines.parquet").filter("sale_id IS NOT NULL AND line_no IS NOT NULL")
    lines = lines.groupBy("sale_id", "line_no").agg(*own("item_id", "vendor_id", "quantity", "amount", "flag")).join(items, "item_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    goods = F.concat(text("name"), F.lit(" of brand "), text("brand"), F.lit(" and kind "), text("kind"))
    return lines.select(
        F.concat_ws(":", "sale_id", "line_no").alias("evidence_id"), F.col("sale_id").cast("string").alias("document_id"), F.floor(F.col("line_no") / 10).cast("int").alias("page"),
        F.concat(F.lit("e"), F.col("line_no") % 4).alias("element_id"), F.lit(None).cast("string").alias("parent_element_id"), F.lit("text").alias("kind"), F.lit("native_text").alias("method"),
        (F.col("flag") == "kept").alias("has_span"), F.lit(False).alias("has_crop"), F.lit(None).cast("array<struct<raw_text:string,row_header:string,column_header:string>>").alias("cells"),
        "sale_id", "line_no", goods.alias("goods"), "flag", "vendor_id", "quantity", F.round(F.col("amount") * 100).cast("long").alias("cents"),
    )


def _said(*parts):
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts])


_SNIPPET = "goods || ' sold ' || coalesce(quantity::VARCHAR, '') || ' for ' || coalesce(cents::VARCHAR, '') || ' cents by vendor ' || coalesce(vendor_id::VARCHAR, '') || ' ' || coalesce(flag, '')"
_LEXICAL = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9_.+/-]{{2,}}'), lambda w: trim(lower(w), '._+/-')), lambda w: w NOT IN ('', 'the', 'and', 'with', 'from', 'that', 'this', 'result', 'results')))"


@query("j9_numeric_locators", f"""WITH {_LINES},
s AS (SELECT sale_id || ':' || line_no AS id, sale_id, page, element, precise, {_SNIPPET} AS t FROM e),
x AS (SELECT id, sale_id, page, element, precise, {_LEXICAL.format("t")} AS words, unnest(list_distinct(regexp_extract_all(t, '(?:^|[^A-Za-z0-9.\\-])([-+]?[0-9]+)', 1))) AS number FROM s),
c AS (SELECT sale_id, min(line_no) AS line_no, 'sold ' || coalesce(min(quantity)::VARCHAR, '') || ' of brand for ' || coalesce(max(cents)::VARCHAR, '') || ' cents by vendor ' || coalesce(min(vendor_id)::VARCHAR, '') || ' kept' AS t FROM e GROUP BY sale_id),
q AS (SELECT sale_id, line_no, {_LEXICAL.format("t")} AS said, unnest(list_distinct(regexp_extract_all(t, '[0-9]+'))) AS number FROM c),
h AS (SELECT q.*, x.page, x.element, x.precise FROM q JOIN x ON x.id = q.sale_id || ':' || q.line_no AND x.number = q.number),
p AS (SELECT q.*, s.page FROM q JOIN s ON s.id = q.sale_id || ':' || q.line_no WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sale_id = q.sale_id AND h.number = q.number AND h.precise)),
o AS (SELECT p.sale_id, p.number, min(x.id) AS evidence_id, 'object' AS how FROM p JOIN h ON h.sale_id = p.sale_id AND h.number = p.number JOIN x ON x.sale_id = p.sale_id AND x.number = p.number AND x.precise AND x.page = h.page AND x.element = h.element AND x.id <> p.sale_id || ':' || p.line_no GROUP BY ALL HAVING count(DISTINCT x.id) = 1),
b AS (SELECT p.sale_id, p.number, x.id, len(list_intersect(p.said, x.words)) AS shared, abs(x.page - p.page) AS gap FROM p JOIN x ON x.sale_id = p.sale_id AND x.number = p.number AND x.precise AND x.id <> p.sale_id || ':' || p.line_no
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.sale_id = p.sale_id AND o.number = p.number)),
r AS (SELECT *, rank() OVER (PARTITION BY sale_id, number ORDER BY shared DESC, gap) AS k FROM b WHERE shared >= 2),
u AS (SELECT sale_id, number, min(id) AS evidence_id, 'document' AS how FROM r WHERE k = 1 GROUP BY ALL HAVING count(*) = 1)
SELECT sale_id::VARCHAR AS claim_id, number, evidence_id, how FROM (SELECT * FROM o UNION ALL SELECT * FROM u)""")
def j9(spark, d):
    """A claim for each sale, which cites the sale's first line: its least quantity, greatest amount and least vendor."""
    lines = written(_lines(spark, d), "lines")
    evidence = lines.withColumn("snippet", _said(F.col("goods"), " sold ", F.col("quantity"), " for ", F.col("cents"), " cents by vendor ", F.col("vendor_id"), " ", F.col("flag")))
    claims = lines.groupBy("sale_id").agg(F.min("line_no").alias("line_no"), F.min("quantity").alias("q"), F.max("cents").alias("c"), F.min("vendor_id").alias("v"))
    text = _said("sold ", F.col("q"), " of brand for ", F.col("c"), " cents by vendor ", F.col("v"), " kept")
    claims = claims.select(F.col("sale_id").cast("string").alias("claim_id"), text.alias("text"), F.array(F.concat_ws(":", "sale_id", "line_no")).alias("refs"))
    return locators.numeric_locators(claims, evidence).select("claim_id", "number", "evidence_id", "how")


_MODE = "CASE flag WHEN 'kept' THEN ' as measured' WHEN 'returned' THEN ' in a simulation' ELSE ' emulated and measured' END"


@query("j11_evaluation_modes", f"""WITH {_LINES},
s AS (SELECT sale_id || ':' || line_no AS id, sale_id, line_no, page, CASE flag WHEN 'kept' THEN 'measured' WHEN 'returned' THEN 'simulated' END AS mode, goods, {_LEXICAL.format(f"goods || {_MODE}")} AS words FROM e),
f AS (SELECT sale_id, arg_min(goods, line_no) AS goods, arg_min(id, line_no) AS id, arg_min(page, line_no) AS page FROM s GROUP BY sale_id),
r AS (SELECT f.sale_id, s.id, s.mode, len(list_intersect({_LEXICAL.format("f.goods")}, s.words)) AS shared, abs(s.page - f.page) AS gap FROM f JOIN s ON s.sale_id = f.sale_id WHERE s.mode IS NOT NULL),
t AS (SELECT * FROM r WHERE shared >= 3 QUALIFY rank() OVER (PARTITION BY sale_id ORDER BY shared DESC) = 1)
SELECT sale_id::VARCHAR AS observation_id, any_value(mode) AS mode, arg_min(id, (gap, id)) AS evidence_id FROM t GROUP BY sale_id HAVING count(DISTINCT mode) = 1""")
def j11(spark, d):
    """An observation for each sale about the goods of its first line; a line's flag says how it was seen."""
    lines = _lines(spark, d)
    mode = F.when(F.col("flag") == "kept", " as measured").when(F.col("flag") == "returned", " in a simulation").otherwise(" emulated and measured")
    observations = lines.groupBy("sale_id").agg(F.min_by(F.struct("goods", "evidence_id"), "line_no").alias("f"))
    observations = observations.select(F.col("sale_id").cast("string").alias("observation_id"), F.col("f.goods").alias("description"), F.array("f.evidence_id").alias("refs"))
    return locators.evaluation_modes(observations, lines.withColumn("snippet", F.concat("goods", mode)))


# ------------------------------------------------------------------ lines of documents as chunks

_PAGE = 24


@query("j7_context_expansion", f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, i // {_PAGE} AS page, doc_id || '-' || i AS id, CASE length(text) % 7 WHEN 1 THEN 'table' WHEN 2 THEN 'figure' WHEN 3 THEN 'caption' ELSE 'text' END AS kind, text || CASE WHEN i % 5 = 0 THEN ' see table ' || (i // 8) ELSE '' END AS text,
  doc_id || '-e' || i AS element, CASE WHEN length(text) % 7 = 1 AND i > 0 THEN doc_id || '-e' || (i - 1) END AS parent, CASE WHEN length(text) % 7 IN (1, 3) THEN 'Table ' || (i // 8) END AS label, CASE WHEN length(text) % 10 <> 4 THEN i * 10.0 END AS y0, CASE WHEN length(text) % 10 <> 4 THEN i * 10.0 + length(text) % 30 END AS y1 FROM l),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i, id) AS k FROM (
  SELECT * FROM c WHERE kind IN ('table', 'figure') UNION ALL SELECT * FROM c WHERE kind = 'caption' AND doc_id NOT IN (SELECT doc_id FROM c WHERE kind IN ('table', 'figure')))),
p AS (SELECT v.doc_id, v.page, v.k, v.id AS anchor_id, c.id AS chunk_id,
    CASE WHEN c.parent = v.element OR c.element = v.parent OR c.parent = v.parent THEN 0 WHEN lower(c.label) = lower(v.label) THEN 1 WHEN contains(lower(c.text), lower(v.label)) THEN 2 ELSE 3 END AS relation,
    CASE WHEN v.y0 IS NULL OR c.y0 IS NULL THEN NULL WHEN c.y1 < v.y0 THEN v.y0 - c.y1 WHEN v.y1 < c.y0 THEN c.y0 - v.y1 ELSE 0 END AS distance
  FROM v JOIN c ON c.doc_id = v.doc_id AND c.page = v.page WHERE c.kind = 'text' AND c.id NOT IN (SELECT id FROM v)),
o AS (SELECT v.doc_id, v.page, v.k, v.id AS anchor_id, coalesce(list({{'id': chunk_id, 'relation': relation, 'distance': distance}} ORDER BY relation, distance NULLS LAST, chunk_id) FILTER (chunk_id IS NOT NULL AND (relation < 3 OR distance IS NOT NULL)), []) AS near FROM v LEFT JOIN p ON p.doc_id = v.doc_id AND p.page = v.page AND p.k = v.k GROUP BY ALL),
f AS (SELECT doc_id, page, k, anchor_id, near[1:2] AS got, list_transform(near[1:2], lambda x: x.id) AS taken FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page, o.k, o.anchor_id, list_filter(o.near, lambda x: NOT list_contains(f.taken, x.id))[1:2], list_concat(f.taken, list_transform(list_filter(o.near, lambda x: NOT list_contains(f.taken, x.id))[1:2], lambda x: x.id)) FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1)
SELECT doc_id AS request, anchor_id, g.id AS chunk_id, g.relation::INT AS relation, g.distance::DOUBLE AS distance FROM (SELECT doc_id, anchor_id, unnest(got) AS g FROM f)""")
def j7(spark, d):
    """Lines are chunks; the tables, figures and captions of a document are selected by its own request."""
    lines = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    n = F.length("line") % 7
    kind = F.when(n == 1, "table").when(n == 2, "figure").when(n == 3, "caption").otherwise("text")
    y0 = F.when(F.length("line") % 10 != 4, F.col("i") * 10.0)
    table = F.floor(F.col("i") / 8)
    chunks = lines.select(
        F.concat_ws("-", "doc_id", "i").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("string").alias("document_version"), F.floor(F.col("i") / _PAGE).alias("page"), kind.alias("kind"),
        F.concat("line", F.when(F.col("i") % 5 == 0, F.concat(F.lit(" see table "), table)).otherwise("")).alias("text"), F.concat("doc_id", F.lit("-e"), "i").alias("element_id"),
        F.when((n == 1) & (F.col("i") > 0), F.concat("doc_id", F.lit("-e"), F.col("i") - 1)).alias("parent_element_id"), F.when(n.isin(1, 3), F.concat(F.lit("Table "), table)).alias("object_label"), y0.alias("y0"), (y0 + F.length("line") % 30).alias("y1"), "i",
    )
    selected = chunks.filter("kind != 'text'").select(F.col("document_id").alias("request"), "chunk_id", F.col("i").cast("long").alias("place"))
    return locators.context_expansion(chunks.drop("i"), selected).select("request", "anchor_id", "chunk_id", "relation", "distance")


@query("g6_segments")
def g6(spark, d):
    """Parts of each document that serve a benchmark passage's first words; its source is the name looked for."""
    passages = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3), 1, 6).alias("terms"))
    count = passages.agg(F.max("item_id") + 1).first()[0] or 1
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("item_id", F.pmod(F.col("doc_id"), F.lit(count))).join(passages, "item_id", "left")
    out = segments.select_segments(docs, "doc_id", F.col("text"), F.col("source"), F.col("terms"), topical=r"[a-z]+tion\b")
    return out.select("doc_id", "start", "end", F.sha2("text", 256).alias("sha"), "locator")


_QUOTABLE, _WEIGHTY = r"(?i)\b(?:the|der|les|una)\b|tion", r"(?i)tion\b"


@query("g7_quote_bank")
def g7(spark, d):
    """Sentences of documents, by words that these have."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    evidence = docs.select(F.col("doc_id").alias("evidence_id"), F.lit(False).alias("provided"), F.lit("full_text").alias("access_status"), F.lit("substantive").alias("content_status"),
                           F.array(F.struct("text", F.lit(None).cast("string").alias("locator"))).alias("segments"))
    out = segments.quote_bank(evidence, quotable=_QUOTABLE, weighty=_WEIGHTY)
    return out.select("evidence_id", "quote_id", F.sha2("text", 256).alias("sha"), F.sha2("context", 256).alias("context_sha"), F.size("subjects").alias("subjects"))
