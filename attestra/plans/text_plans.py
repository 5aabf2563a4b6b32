"""Queries of the text functions, sources and chunk operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import chunks
from attestra.sources import html

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(0), ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')"""


@query("t1_normalize_text", f"SELECT doc_id, sha256({_NORMAL}) AS sha, length({_NORMAL}) AS n FROM documents")
def t1(spark, d):
    x = T.normalize_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.sha2(x, 256).alias("sha"), F.length(x).cast("long").alias("n"))


@query("t2_fold_text", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')))) AS sha FROM documents")
def t2(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.fold_text(F.col("text")), 256).alias("sha"))


@query("t3_token_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM documents")
def t3(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


_NAMES = "|".join(T.SECTIONS)


@query("t4_headings", f"""WITH l AS ({_LINES}) SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) <= 100 AND (
  regexp_matches(lower(line), '^([0-9]+(\\.[0-9]+)*\\s+)?({_NAMES})\\s*$')
  OR regexp_matches(line, '^([0-9]+(\\.[0-9]+)*\\s+)?[A-Z][A-Z\\s&:/-]{{3,}}$') OR regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\.?\\s+[A-Za-z].+$'))) AS headings FROM l GROUP BY doc_id""")
def t4(spark, d):
    lines = F.split("text", "\n", -1)
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, T.is_heading)).cast("long").alias("headings"))


@query("t11_numeric_tokens", r"""WITH n AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.,-])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)', 1), lambda x: replace(x, ',', '')))) AS ns FROM documents)
SELECT doc_id, len(ns) AS n, array_to_string(ns, ' ') AS numbers FROM n""")
def t11(spark, d):
    x = T.numeric_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n"), F.array_join(x, " ").alias("numbers"))


@query("t16_lexical_terms", r"""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')), lambda x: x NOT IN ('the','and','for','with','from','that','this')) AS ws FROM documents),
u AS (SELECT doc_id, list_sort(list_distinct(list_concat(ws, list_transform(list_filter(ws, lambda x: length(x) > 4 AND x LIKE '%s'), lambda x: x[:-2])))) AS ts FROM w)
SELECT doc_id, len(ts) AS n, sha256(array_to_string(ts, ' ')) AS sha FROM u""")
def t16(spark, d):
    x = T.lexical_terms(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n"), F.sha2(F.array_join(x, " "), 256).alias("sha"))


@query("t18_quantitative", rf"SELECT doc_id, regexp_matches(text, '[0-9]') AND regexp_matches(text, '{T.MONEY_OR_SCALE}') AS quantitative FROM documents")
def t18(spark, d):
    return _docs(spark, d).select("doc_id", T.quantitative_claim(F.col("text")).alias("quantitative"))


@query("t19_stable_ids", "SELECT doc_id, sha256(text)[1:16] AS content_id, sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, source))[1:24] AS stable_id FROM documents")
def t19(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text"), 16).alias("content_id"), T.stable_id(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("stable_id"))


_REST = "regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?]+', '')"
_CANON = rf"lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+)', 1)) || CASE WHEN starts_with({_REST}, '/') THEN {_REST} ELSE '/' || {_REST} END"


@query("t21_canonical_url", f"""SELECT page_id, {_CANON} AS canonical, lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages""")
def t21(spark, d):
    return _pages(spark, d).select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.url_host(F.col("url")).alias("host"))


@query("s21_public_url", rf"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://[^/?#]*@') AND contains(host, '.') AND NOT regexp_matches(host, '{T.LOCAL_NAMES}') AND NOT regexp_matches(host, '{T.LOCAL_BLOCKS}') AND NOT starts_with(host, '[') AS ok FROM h""")
def s21(spark, d):
    return _pages(spark, d).select("page_id", T.public_url(F.col("url")).alias("ok"))


@query("t23_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, len(ss) AS n, coalesce(max(length(x)), 0) AS longest FROM s LEFT JOIN LATERAL (SELECT unnest(ss) AS x) ON true GROUP BY doc_id, len(ss)""")
def t23(spark, d):
    x = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(x, F.length)), F.lit(0)).cast("long").alias("longest"))


@query("t24_visible_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', '', 'g'))) AS sha FROM documents")
def t24(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.visible_text(F.col("text")), 256).alias("sha"))


@query("t26_relevance", """SELECT doc_id, source, 12 * (contains(lower(text), source))::INT + least(2 * len(regexp_extract_all(lower(text), 'data|model|memory')), 8) + 3 * (contains(lower(text), 'license')::INT + contains(lower(text), 'password')::INT + contains(lower(text), 'token')::INT) AS score FROM documents""")
def t26(spark, d):
    low = F.lower("text")
    hit = lambda w: low.contains(w).cast("int")
    score = 12 * F.contains(low, F.col("source")).cast("int") + F.least(2 * F.size(F.regexp_extract_all(low, F.lit("data|model|memory"), F.lit(0))), F.lit(8)) + 3 * (hit("license") + hit("password") + hit("token"))
    return _docs(spark, d).select("doc_id", "source", score.cast("long").alias("score"))


@query("t33_markdown_escape", r"""SELECT doc_id, sha256(replace(regexp_replace(text, '([\\|*_`])', '\\\1', 'g'), chr(10), ' ')) AS sha FROM documents""")
def t33(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.markdown_escape(F.col("text")), 256).alias("sha"))


@query("t39_number_range", """SELECT p_partkey, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN lo IS NULL THEN '≤' || hi::VARCHAR || ' mm' WHEN hi IS NULL THEN '≥' || lo::VARCHAR || ' mm' ELSE lo::VARCHAR || '–' || hi::VARCHAR || ' mm' END AS span
FROM (SELECT p_partkey, nullif(p_size % 7, 0) AS lo, nullif(p_size, 10) AS hi FROM part)""")
def t39(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("lo"), F.nullif(F.col("p_size"), F.lit(10)).alias("hi"))
    return rows.select("p_partkey", T.number_range(F.col("lo"), F.col("hi"), "mm").alias("span"))


@query("t41_first_url", r"""SELECT doc_id, regexp_replace(regexp_extract(text, 'https?://[^\s<>"]+'), '[.,;:)\]]+$', '') AS url FROM documents""")
def t41(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_replace(F.regexp_extract("text", r'https?://[^\s<>"]+', 0), r"[.,;:)\]]+$", "").alias("url"))


@query("f11_missing", "SELECT doc_id, text IS NULL OR lower(trim(text)) IN ('','unknown','tbd','unspecified','미확인') AS missing FROM documents")
def f11(spark, d):
    return _docs(spark, d).select("doc_id", T.is_missing(F.col("text")).alias("missing"))


@query("k4_redaction", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[A-Z0-9]{12,}', '[REDACTED]', 'g'), '(?i)(password|secret|token|api_?key)(["'']? *[:=] *["'']?)[A-Za-z0-9+/_.=-]{8,}', '\1\2[REDACTED]', 'g'), '[0-9a-f]{32,}', '[REDACTED]', 'g')) AS sha FROM documents""")
def k4(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("sha"))


@query("k3_artifact_ids", """SELECT doc_id, 'doc-' || sha256('{"doc_id":' || doc_id::VARCHAR || ',"lang":"' || lang || '","n_chars":' || n_chars::VARCHAR || '}')[1:16] AS artifact_id FROM documents""")
def k3(spark, d):
    body = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    return _docs(spark, d).select("doc_id", F.concat(F.lit("doc-"), T.content_hash(body, 16)).alias("artifact_id"))


def _tags() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in html.CHROME.split("|"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("s7_html_text", f"SELECT page_id, sha256({_tags()}) AS sha, length({_tags()}) AS n FROM pages")
def s7(spark, d):
    x = html.visible(F.col("html"))
    return _pages(spark, d).select("page_id", F.sha2(x, 256).alias("sha"), F.length(x).cast("long").alias("n"))


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


@query("s8_html_title", "SELECT page_id, coalesce(" + ", ".join(_clean(f"regexp_extract(html, '{p}', 1)") for p in (r"(?is)<h1\b[^>]*>(.*?)</h1>", '(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', r"(?is)<title\b[^>]*>(.*?)</title>")) + ") AS title FROM pages")
def s8(spark, d):
    return _pages(spark, d).select("page_id", html.title(F.col("html")).alias("title"))


@query("s11_publication_date", r"SELECT page_id, nullif(regexp_extract(html[1:16000], '(?i)(?:published|posted|submitted)[^0-9<]{0,20}([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS published FROM pages")
def s11(spark, d):
    found = F.regexp_extract(F.substring("html", 1, 16000), r"(?i)(?:published|posted|submitted)[^0-9<]{0,20}([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return _pages(spark, d).select("page_id", F.nullif(found, F.lit("")).alias("published"))


@query("s22_document_gate", "SELECT source, count(*) AS documents, count(*) FILTER (length(text) >= 1000) AS accepted FROM documents GROUP BY source")
def s22(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.length("text") >= 1000).alias("accepted"))


@query("s4_text_elements", f"""WITH l AS ({_LINES}) SELECT doc_id, count(*) FILTER (trim(line) <> '') AS elements, sha256(string_agg(trim(line), chr(10) ORDER BY line_no) FILTER (trim(line) <> '')) AS sha FROM l GROUP BY doc_id""")
def s4(spark, d):
    rows = _docs(spark, d).select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "").alias("e"))
    sha = F.when(F.size("e") > 0, F.sha2(F.array_join("e", "\n"), 256))
    return rows.select("doc_id", F.size("e").cast("long").alias("elements"), sha.alias("sha"))


_W = "SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents"


@query("g1_token_chunks", f"""WITH w AS ({_W}), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(len(w) - 121, 0) + 1, 680) END) AS s FROM w)
SELECT doc_id, (s // 680)::INT AS chunk_no, sha256(array_to_string(w[s + 1:s + 800], ' ')) AS sha FROM s""")
def g1(spark, d):
    rows = chunks.token_windows(_docs(spark, d).select("doc_id", "text"), F.col("text"), 800, 120)
    return rows.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("sha"))


@query("g8_packets", """SELECT doc_id, s::INT AS start, 'MAT-' || sha256(text[s + 1:s + 1400])[1:16] AS material_id FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1100)) AS s FROM documents)""")
def g8(spark, d):
    rows = chunks.char_windows(_docs(spark, d).select("doc_id", "text"), F.col("text"), 1400, 1100)
    return rows.select("doc_id", "start", F.concat(F.lit("MAT-"), T.content_hash(F.col("part"), 16)).alias("material_id"))


@query("g3_chunk_dedup", f"""WITH w AS ({_W}), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(len(w) - 121, 0) + 1, 680) END) AS s FROM w),
h AS (SELECT doc_id, s // 680 AS chunk_no, sha256(array_to_string(w[s + 1:s + 800], ' ')) AS sha FROM s)
SELECT sha[1:24] AS chunk_id, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY sha""")
def g3(spark, d):
    rows = chunks.token_windows(_docs(spark, d).select("doc_id", "text"), F.col("text"), 800, 120)
    return rows.select("doc_id", F.sha2("chunk", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select(F.substring("sha", 1, 24).alias("chunk_id"), "doc_id", "copies")
