"""Queries of relevance rules and bounded choices, each with SQL that gives the same rows.

The tables have no search hits; an event's number picks a title, an address and a technology from short lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import relevance as R
from attestra.operators import selection as S

QUERIES, ORACLES = {}, {}

TITLES = (
    "KV cache quantization for LLM serving", "RDKV set-top release notes", "Browser cache compression", "Photonic CXL memory pooling and inference",
    "DRAM expansion over CXL", "Which GPU has 80 GB?", "Adoption and pricing of accelerators", "라이선스 제품 메모리 절감", "Key-value caches, evicted early",
    "Compare the latency of Table II", "every row of Table 1 per row range", "limitations: not validated, reduced capacity", "Dataset and workload scope", "evidence_id format",
    "A standard library", "",
)
URLS = ("https://arxiv.org/abs/2401.00001v2", "https://github.com/a/b", "https://example.com/kv%20cache", "http://www.marvell.com:80/x?y=1", None)
CRITERIA = ("adoption", "business_value")


def query(name: str, sql: str | None = None):
    def add(g):
        QUERIES[name] = g
        if sql:
            ORACLES[name] = sql
        return g

    return add


def _table(name):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


_events, _turns, _documents, _lines, _orders, _customers, _nations = map(_table, ("events", "conversations", "documents", "lineitem", "orders", "customer", "nation"))


def _quoted(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _hits(spark, d):
    k = F.col("event_id")
    part = lambda n: F.floor(k / n)
    return _events(spark, d).select(
        "event_id", "user_id", _pick(k, TITLES).alias("title"), _pick(part(16), TITLES).alias("content"), _pick(part(7), URLS).alias("url"),
        F.when(k % 3 == 0, "HW").otherwise("SW").alias("kind"), F.when(k % 5 == 0, "RDKV").otherwise("Photonic CXL").alias("name"), (k % 2).alias("level"),
    )


_HITS = f"""h AS (SELECT event_id, user_id, ({_quoted(TITLES)})[event_id % 16 + 1] AS title, ({_quoted(TITLES)})[event_id // 16 % 16 + 1] AS content, ({_quoted(URLS)})[event_id // 7 % 5 + 1] AS url,
CASE WHEN event_id % 3 = 0 THEN 'HW' ELSE 'SW' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'RDKV' ELSE 'Photonic CXL' END AS name, event_id % 2 AS level FROM events),
b AS (SELECT *, title || ' ' || content AS body, lower(title || ' ' || content) AS low, coalesce(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '') AS host FROM h)"""


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern}')"


@query("f5_search_relevance", f"""WITH {_HITS} SELECT event_id, CASE WHEN host = 'arxiv.org' AND NOT contains(low, lower(name)) THEN {_has('body', R.MARKET_PAPER)}
WHEN kind = 'SW' AND {_has('body', R.ACRONYM)} THEN {_has('body', R.ACRONYM_TOPIC)} ELSE level >= 1 AND {_has('body', R.BROAD)} OR {_has('body', R.DIRECT)} END AS relevant FROM b""")
def f5(spark, d):
    c = F.col
    return _hits(spark, d).select("event_id", R.market_candidate(c("kind"), c("name"), c("url"), c("title"), c("content"), c("level")).alias("relevant"))


_FAMILY = f"""CASE kind WHEN 'SW' THEN {_has('t', R.KV_CACHE)} AND {_has('t', R.SW_METHOD)} ELSE {_has('t', R.INTERCONNECT)} AND {_has('t', R.MEMORY)}
AND {_has('t', R.MEMORY_OPERATION)} AND ({_has('t', R.KV_CACHE)} OR {_has('t', R.AI_CONTEXT)}) END"""


@query("f6_family_match", f"""WITH {_HITS}, t AS (SELECT *, replace(title || ' ' || coalesce(url, '') || ' ' || content, '%20', ' ') AS t FROM b)
SELECT event_id, {_FAMILY} AS family, coalesce(url, '') NOT LIKE '%2401.00001%' AND (contains(' ' || trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' ' || lower(name) || ' ') OR {_FAMILY}) AS candidate FROM t""")
def f6(spark, d):
    c = F.col
    text = F.lower(F.concat_ws(" ", "title", F.replace(F.coalesce("url", F.lit("")), F.lit("%20"), F.lit(" ")), "content"))
    paper = F.lit("https://arxiv.org/pdf/2401.00001")
    return _hits(spark, d).select("event_id", R.family_matches(c("kind"), text).alias("family"), R.family_candidate(c("kind"), c("name"), paper, c("url"), c("title"), c("content")).alias("candidate"))


@query("f12_source_available", """SELECT l_orderkey, l_linenumber, l_returnflag = 'A' OR (l_linenumber % 3 = 0 AND l_suppkey % 3 = o_custkey % 3 AND o_orderstatus = 'F')
OR (l_linenumber % 3 = 1 AND l_discount > 0.05 AND l_linestatus = 'O') AS available FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f12(spark, d):
    """Lines stand in for evidence, orders for its documents."""
    c = F.col
    rows = _lines(spark, d).join(_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey"))
    how = F.element_at(F.array(*map(F.lit, ("inherited_source_record", "collected_excerpt", "other"))), (c("l_linenumber") % 3 + 1).cast("int"))
    status, collector = F.when(c("o_orderstatus") == "F", "succeeded"), F.when(c("l_linestatus") == "O", "web")
    available = R.source_available(c("l_returnflag") == "A", how, c("l_suppkey") % 3 == c("o_custkey") % 3, status, c("l_partkey"), c("l_discount") > 0.05, collector)
    return rows.select("l_orderkey", "l_linenumber", available.alias("available"))


_NUMBER = r"(?:^|[^\p{L}\p{N}_.+-])[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:\s*(?:%|×|x|ki?b|mi?b|gi?b|ti?b|ms|ns|us|k|m|g|t|s))?(?:$|[^a-z])"
_BOUND = r"(?:^|$|[^\p{L}\p{N}_])"
_INTENT = f"""{_has('x', R.VISUAL_REFERENCE.replace(chr(92) + 'b', _BOUND))} OR {_has('x', _NUMBER)}
OR ({_has('x', R.VISUAL_CUE.replace(chr(92) + 'b', _BOUND))} AND len(list_filter(regexp_extract_all(x, '{R.LEXICAL_TOKEN}'), lambda w: lower(w) NOT IN ({_quoted(R.STOP_WORDS)[1:-1]}))) > 0)
OR ({_has('x', R.NUMERIC_QUESTION.replace(chr(92) + 'b', _BOUND))} AND {_has('x', R.NUMERIC_METRIC.replace(chr(92) + 'b', _BOUND))})"""


@query("f18_visual_intent", f"""WITH {_HITS}, q AS (SELECT 'event' AS kind, event_id AS id, 0::BIGINT AS turn, title AS x FROM h UNION ALL SELECT 'turn', conv_id, turn, coalesce(text, '') FROM conversations)
SELECT kind, id, turn, {_INTENT} AS intent FROM q""")
def f18(spark, d):
    asked = _hits(spark, d).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit(0).cast("long").alias("turn"), R.visual_intent(F.col("title")).alias("intent"))
    return asked.unionByName(_turns(spark, d).select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", R.visual_intent(F.col("text")).alias("intent")))


def _any(x: str, terms) -> str:
    return f"len(list_filter({_quoted(terms)}, lambda t: contains({x}, t))) > 0"


@query("f20_unscoped_topics", f"""WITH {_HITS}, n AS (SELECT event_id, low, trim(regexp_replace(replace(low, '-', ' '), '\\s+', ' ', 'g')) AS x FROM b)
SELECT event_id FROM n WHERE NOT ((regexp_matches(low, '\\btable\\s+1\\b') AND {_any('x', R.EXHAUSTIVE)}) OR {_any("replace(low, '_', ' ')", R.ID_FORMAT)})""")
def f20(spark, d):
    return _hits(spark, d).filter(~R.set_aside_topic(R.joined(F.col("title"), F.col("content")))).select("event_id")


@query("t30_topic_facet", f"""WITH {_HITS}, x AS (SELECT 'event' AS kind, event_id AS id, low AS x FROM b UNION ALL SELECT 'document', doc_id, lower(coalesce(text, '')) FROM documents),
y AS (SELECT kind, id, replace(x, '_', ' ') AS x FROM x)
SELECT kind, id, CASE WHEN {_any('x', R.FACETS['limitations'])} THEN 'limitations' WHEN {_any('x', R.FACETS['scope'])} THEN 'scope' ELSE 'technical_overview' END AS facet FROM y""")
def t30(spark, d):
    events = _hits(spark, d).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), R.topic_facet(R.joined(F.col("title"), F.col("content"))).alias("facet"))
    return events.unionByName(_documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), R.topic_facet(F.col("text")).alias("facet")))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("t6_title_abstract", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(text, '') || chr(10) || 'Abstract: ' || coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || '1. Introduction' AS y FROM documents)
SELECT doc_id, list_filter(list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r]'), lambda s: {_TRIM.format('s')}), lambda s: s <> '')[1:12], lambda s: length(s) BETWEEN 8 AND 300)[1] AS title,
nullif(left({_TRIM.format(r"regexp_extract(y, '(?is)\babstract\b\s*[:—-]?\s*(.+?)\n\s*(?:1\.?\s+)?introduction\b', 1)")}, 8000), '') AS abstract FROM d""")
def t6(spark, d):
    """Titles of the documents; their source and language stand in for an abstract's body behind the text."""
    text = F.coalesce("text", F.lit(""))
    whole = F.concat(text, F.lit("\nAbstract: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("lang", F.lit("")), F.lit("\n1. Introduction"))
    return _documents(spark, d).select("doc_id", R.title_line(text).alias("title"), R.abstract_part(whole).alias("abstract"))


_TERMS = [t for c in CRITERIA for t in R.CRITERION_TERMS[c]]
_TOPICAL = r"kv[\s_-]*cache|\bcxl\b|photonic|llm|메모리"


@query("r16_candidate_ranking", f"""WITH {_HITS}, s AS (SELECT *, contains(low, lower(name)) AS direct, host IN ({_quoted(R.FIRST_PARTY)[1:-1]}) AS first_party, {_any('low', _TERMS)} AS purpose,
(CASE WHEN contains(low, lower(name)) THEN 12 ELSE 0 END + least(2 * len(regexp_extract_all(low, '{_TOPICAL}')), 8) + 3 * len(list_filter({_quoted(_TERMS)}, lambda t: contains(low, t))))::INT AS score FROM b)
SELECT user_id, event_id, direct, first_party, purpose, score, row_number() OVER (PARTITION BY user_id ORDER BY direct DESC, first_party DESC, purpose DESC, score DESC, event_id)::INT AS rank FROM s""")
def r16(spark, d):
    """A user's events stand in for the hits of a request."""
    ranked = S.rank_candidates(_hits(spark, d), "user_id", "event_id", F.col("name"), CRITERIA)
    return ranked.select("user_id", "event_id", "direct", "first_party", "purpose", "score", "rank")


@query("d8_technical_premises", f"""WITH {_HITS}, s AS (SELECT user_id, event_id, (len(regexp_extract_all(body, '(?i){R.EFFECT}')) + CASE WHEN event_id % 4 = 0 THEN 4 ELSE 0 END)::INT AS score
FROM b WHERE {_has('body', R.EFFECT)} AND {_has('body', 'memory|cache|메모리|캐시')})
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id)::INT AS rank FROM s QUALIFY rank <= 2""")
def d8(spark, d):
    """Users stand in for technologies; every fourth event comes from a conclusion."""
    rows = _hits(spark, d).select("user_id", "event_id", R.joined(F.col("title"), F.col("content")).alias("excerpt"), F.when(F.col("event_id") % 4 == 0, "Conclusion, p. 1").alias("locator"))
    return S.technical_premises(rows, "user_id", "event_id").select("user_id", "event_id", "score", "rank")


@query("a24_target_selection", """WITH c AS (SELECT c_nationkey AS domain_id, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no id' WHEN c_custkey % 2 = 0 THEN 'Role-' ELSE 'role-' END || (c_custkey % 13) AS id, c_name AS name FROM customer
WHERE c_nationkey % 6 <> 1 AND c_custkey % 11 <> 0 AND c_acctbal > 0),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY domain_id, lower(id) ORDER BY c_custkey) = 1),
k AS (SELECT domain_id, id, name, false AS fallback FROM f QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY c_custkey) <= 8)
SELECT * FROM k UNION ALL SELECT n_nationkey, r.id, r.name, true FROM nation, (VALUES """ + ", ".join(f"('{i}', '{n}')" for i, n in S.FALLBACK_ROLES.items()) + """) r(id, name) WHERE n_nationkey NOT IN (SELECT domain_id FROM c)""")
def a24(spark, d):
    """Customers of five nations in six are candidates of their nation; every eleventh has no valid id, some no reason."""
    key = F.col("c_custkey")
    role = F.when(key % 11 == 0, "no id").when(key % 2 == 0, "Role-").otherwise("role-")
    candidates = _customers(spark, d).filter("c_nationkey % 6 <> 1").select(
        F.col("c_nationkey").alias("domain_id"), F.concat(role, (key % 13).cast("string")).alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, "has a budget").alias("reason"), "c_custkey",
    )
    return S.select_targets(candidates, _nations(spark, d).select(F.col("n_nationkey").alias("domain_id")), "c_custkey")


@query("a28_operating_organizations", f"SELECT 'operator' AS id, n_nationkey AS domain_id, n_name || '{S.ORGANIZATION}' AS name FROM nation")
def a28(spark, d):
    return S.operating_organizations(_nations(spark, d).select(F.col("n_nationkey").alias("domain_id"), F.col("n_name").alias("name")))


@query("d26_opinion_deferral", """WITH i AS (SELECT l_orderkey, 'opinion_' || l_linenumber AS item_id, bool_or(l_returnflag = 'R') AS deferred FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey FROM i WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL HAVING bool_or(deferred) AND NOT bool_and(deferred))
SELECT * FROM i WHERE l_orderkey IN (SELECT l_orderkey FROM o)""")
def d26(spark, d):
    """Lines stand in for opinions, returned ones for rejected; urgent orders have their limitations rejected."""
    lines = _lines(spark, d).select("l_orderkey", F.concat(F.lit("opinion_"), "l_linenumber").alias("item_id"), F.when(F.col("l_returnflag") == "R", "unsupported").otherwise("supported").alias("verdict"))
    urgent = _orders(spark, d).filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("limitations").alias("item_id"), F.lit("unsupported").alias("verdict"))
    return S.defer_rejected(lines.select("l_orderkey", "item_id").distinct(), lines.unionByName(urgent), "l_orderkey")
