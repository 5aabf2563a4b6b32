"""Queries of phrase dictionaries, labels of visuals and quoted quantities, each with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.functions import quantities, visuals
from attestra.operators import dictionary

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


_WORD = r"[^\p{L}\p{N}_]"


@query("j17_identities", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
t AS (SELECT doc_id AS tech_id, w[3] || '-' || w[4] AS name, array_to_string(w[10:15], ' ') AS title, len(w[10:15]) AS n FROM w WHERE doc_id % 20 = 0 AND len(w) >= 4 AND regexp_matches(w[3], '^[a-z]+$') AND regexp_matches(w[4], '^[a-z]+$'))
SELECT d.doc_id AS source_id, t.tech_id FROM documents d JOIN w USING (doc_id) JOIN t ON (contains(lower(coalesce(d.text, '')), split_part(t.name, '-', 1)) AND contains(lower(coalesce(d.text, '')), split_part(t.name, '-', 2)) AND regexp_matches(lower(coalesce(d.text, '')), '(^|{_WORD})' || replace(t.name, '-', '[\s\-‐‑‒–—―−]*') || '($|{_WORD})')) OR (t.n >= 4 AND contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || t.title || ' '))""")
def j17(spark, d):
    """Two words of every twentieth document are a name, six further on a title; which documents are about them."""
    docs = _documents(spark, d)
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("tech_id"), w.alias("w")).filter(F.size("w") >= 4).filter(F.get("w", F.lit(2)).rlike("^[a-z]+$") & F.get("w", F.lit(3)).rlike("^[a-z]+$"))
    technologies = rows.select("tech_id", F.concat(F.get("w", F.lit(2)), F.lit("-"), F.get("w", F.lit(3))).alias("name"), F.array_join(F.slice("w", 10, 6), " ").alias("paper"), F.lit(None).cast("string").alias("url"))
    sources = docs.select(F.col("doc_id").alias("source_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("excerpt"))
    return dictionary.identities(sources, technologies)


_FOLD = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"


@query("j16_relinked_citations", rf"""WITH c AS (SELECT doc_id AS citation_id, {_FOLD.format("text[41:100]")} AS quote, {_FOLD.format("text[51:56]")} AS subject, length(trim(text[41:100])) AS n FROM documents WHERE doc_id % 20 = 0),
e AS (SELECT doc_id, {_FOLD.format("text")} AS body, coalesce(source, '') || '/' || doc_id AS url, {_FOLD.format("text[1:12]")} AS title FROM documents),
m AS (SELECT citation_id, doc_id, title, length(url) AS n FROM c JOIN e ON contains(body, quote) WHERE c.n >= 30 AND subject <> '' AND contains(quote, subject))
SELECT citation_id, arg_min(doc_id, (n, doc_id)) AS evidence_id FROM m GROUP BY citation_id HAVING count(DISTINCT title) = 1""")
def j16(spark, d):
    """Sixty characters of every twentieth document are a quote; the source that it can be found again in."""
    docs = _documents(spark, d)
    citations = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("citation_id"), F.substring("text", 41, 60).alias("quote"), F.substring("text", 51, 6).alias("subject"))
    url = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), "doc_id")
    evidence = docs.select(F.col("doc_id").alias("evidence_id"), F.substring("text", 1, 12).alias("title"), url.alias("url"), F.lit("full_text").alias("access_status"), F.col("text").alias("body"))
    return dictionary.relinked(citations, evidence)


# ------------------------------------------------------------------ labels and visuals


@query("t7_object_labels", """WITH p AS (SELECT page_id, (['Table ', 'Fig. ', 'CHART no. ', 'diagram', 'Note '])[page_id % 5 + 1] AS kind, (page_id % 60 + 1)::VARCHAR AS n, page_id % 4 AS form FROM pages WHERE page_id IS NOT NULL)
SELECT page_id, CASE WHEN kind = 'Note ' THEN 'figure-unlabeled-' || sha256('e' || page_id)[1:10] ELSE k.own || CASE form WHEN 0 THEN '-' || lpad(n, greatest(2, length(n))::INT, '0') WHEN 1 THEN '-' || lpad(n, greatest(2, length(n))::INT, '0') || 'b' WHEN 2 THEN '-a-' || lpad(n, greatest(2, length(n))::INT, '0') ELSE '-s-' || lpad(n, greatest(2, length(n))::INT, '0') END END AS key,
  CASE WHEN kind <> 'Note ' THEN upper(k.own[1]) || k.own[2:] || ' ' || CASE form WHEN 0 THEN n WHEN 1 THEN n || 'b' WHEN 2 THEN 'A.' || n ELSE 'S' || n END END AS label
FROM p, LATERAL (SELECT CASE kind WHEN 'Table ' THEN 'table' WHEN 'CHART no. ' THEN 'chart' WHEN 'diagram' THEN 'diagram' ELSE 'figure' END AS own) k""")
def t7(spark, d):
    """Labels in four forms, made from page ids: a Roman number, a number with a letter, an appendix, a letter with a number."""
    n = (F.col("page_id") % 60 + 1).cast("int")
    tens, ones = ("", "X", "XX", "XXX", "XL", "L", "LX"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    roman = F.concat(pick(tens, F.floor(n / 10).cast("int")), pick(ones, n % 10))
    form = pick(("roman", "letter", "appendix", "series"), (F.col("page_id") % 4).cast("int"))
    number = F.when(form == "roman", roman).when(form == "letter", F.concat(n, F.lit("B"))).when(form == "appendix", F.concat(F.lit("a."), n)).otherwise(F.concat(F.lit("s"), n))
    label = F.concat(pick(("Table ", "Fig. ", "CHART no. ", "diagram", "Note "), (F.col("page_id") % 5).cast("int")), number, F.lit(": results"))
    found = visuals.object_locator(label, F.lit("caption"), F.concat(F.lit("e"), "page_id"))
    return spark.read.parquet(f"{d}/pages.parquet").filter("page_id IS NOT NULL").select("page_id", found["key"].alias("key"), found["label"].alias("label"))


@query("r9_visual_ranking")
def r9(spark, d):
    """Turns of a conversation are questions; the tables and figures among the other turns that they call for."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    kind = F.element_at(F.array(*map(F.lit, ("table", "figure", "chart", "caption", "text"))), (F.col("turn") % 5 + 1).cast("int"))
    label = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Table "), F.col("turn") + 1))
    items = turns.select("conv_id", F.col("turn").alias("item"), F.struct(kind.alias("kind"), label.alias("object_label"), F.lit(None).cast("string").alias("section"), "text", (F.col("turn") % 3 == 0).alias("has_cells"), (F.col("turn") % 3 == 1).alias("has_crop"), F.lit(True).alias("has_box")).alias("i"))
    asked = turns.select("conv_id", F.col("turn").alias("question"), F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("What does table "), F.col("turn") + 1, F.lit(" show? "))).otherwise("Compare 2 values: "), F.coalesce("text", F.lit(""))).alias("q"))
    rows = asked.join(items, "conv_id").filter("item <> question").withColumn("v", visuals.visual_score(F.col("q"), F.col("i"))).filter("v IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("conv_id", "question").orderBy(F.desc("v"), "item"))
    return rows.select("conv_id", "question", "item", "v.exact", "v.numbers", "v.words", "v.place", nth.alias("rank"))


# ------------------------------------------------------------------ quantities in quotes

_CASES = ("ok", "definition", "geography", "currency", "dimension", "year", "scope", "capacity", "forecast", "amount", "unit")


@query("v9_metric_quotes", f"""SELECT sale_id, ([{', '.join(f"'{c}'" for c in _CASES)}])[sale_id % 11 + 1] AS reason FROM sales WHERE sale_id IS NOT NULL AND total BETWEEN 0.01 AND 1000000 AND total = round(total, 2)""")
def v9(spark, d):
    """A sale's total is a market's size; quotes of eleven kinds state it, or miss it by one thing."""
    case = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("sale_id") % 11 + 1).cast("int"))
    total = F.col("total").cast("decimal(18,2)").cast("string")
    is_, says = lambda *c: case.isin(*c), lambda head, tail: F.concat(F.lit(head), total, F.lit(tail))
    quote = (
        F.when(is_("definition"), says("The global production of memory reached USD ", " million in 2024."))
        .when(is_("year"), says("The global production of memory modules reached USD ", " million in 2023."))
        .when(is_("scope"), says("Memory modules grew in 2023; the global production was USD ", " million in 2024."))
        .when(is_("capacity"), says("The global production capacity of memory modules reached USD ", " million in 2024."))
        .when(is_("forecast"), says("The global production of memory modules is expected to reach USD ", " million in 2024."))
        .when(is_("unit"), says("The global production of memory modules reached ", " million euros in 2024, 7 more."))
        .otherwise(says("The  global production volume of memory modules reached USD ", " million in 2024, while 12 modules were sold."))
    )
    metric = F.struct(
        F.when(is_("amount"), F.col("total") + 1).otherwise(F.col("total")).alias("value"), F.when(is_("currency"), "EUR million").when(is_("dimension"), "million").otherwise("USD million").alias("unit"),
        F.when(~is_("dimension"), "USD").alias("currency"), F.lit("2024").alias("year"), F.lit("memory module production").alias("market_definition"), F.when(is_("geography"), "Asia").otherwise("Global").alias("geography"), F.lit("actual").alias("actual_or_forecast"),
    )
    sales = spark.read.parquet(f"{d}/sales.parquet").filter("sale_id IS NOT NULL AND total BETWEEN 0.01 AND 1000000 AND total = round(total, 2)")
    return sales.select("sale_id", quantities.metric_reason(metric, quote).alias("reason"))
