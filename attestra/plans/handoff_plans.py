"""Queries of what is handed on, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import relevance as R
from attestra.operators import handoff as H
from attestra.plans.relevance_plans import _any, _has, _pick, _quoted, _table

QUERIES, ORACLES = {}, {}

NOTES = (
    "Evidence_ID was invalid in the response", "evidence identity, invalid output", "the required critical-topic is open", "근거 ID 형식 오류: 추출", "valid evidence id", "previous draft JSON",
    "2 TB baseline", "a 32 GB PF memory appliance baseline run", "x2 TB baseline", "1.5tb Baseline", "baseline of 2 TB",
    "It may reduce cost for acme", "ACME plans to ship", "many maybe", "",
)
METRICS = ("mean TTFT", "speedup", "latency gap", None)


def query(name: str, sql: str | None = None):
    def add(g):
        QUERIES[name] = g
        if sql:
            ORACLES[name] = sql
        return g

    return add


_events, _lines, _orders, _parts, _suppliers = map(_table, ("events", "lineitem", "orders", "part", "supplier"))
_NOTE = f"({_quoted(NOTES)})[event_id % 15 + 1]"
_METRIC = f"({_quoted(METRICS)})[event_id // 15 % 4 + 1]"


def _notes(spark, d):
    k = F.col("event_id")
    return _events(spark, d).select("event_id", "user_id", _pick(k, NOTES).alias("note"), _pick(F.floor(k / 15), METRICS).alias("metric"))


@query("f15_provider_meta", f"""WITH n AS (SELECT event_id, translate(trim(regexp_replace(lower({_NOTE}), '\\s+', ' ', 'g')), '_-', '  ') AS x FROM events)
SELECT event_id, {_any('x', R.META_ALWAYS)} OR (regexp_matches(x, '\\bevidence\\s*id($|[^a-z0-9])|근거\\s*id') AND {_any('x', R.META_INVALID)} AND {_any('x', R.META_PROCESS)}) AS meta FROM n""")
def f15(spark, d):
    return _notes(spark, d).select("event_id", R.about_extraction(F.col("note")).alias("meta"))


@query("t29_stated_baseline", f"""WITH n AS (SELECT event_id, {_NOTE} AS note, {_METRIC} AS metric FROM events),
c AS (SELECT *, regexp_extract(note, '(?i)(?:^|[^a-z0-9]){R.CAPACITY_BASELINE.split(')', 1)[1]}', 1) AS capacity FROM n)
SELECT event_id, CASE WHEN capacity <> '' AND NOT ({_any("lower(coalesce(metric, ''))", R.COMPARATIVE)}) THEN capacity || ' baseline' ELSE '32 TB appliance' END AS baseline FROM c""")
def t29(spark, d):
    return _notes(spark, d).select("event_id", R.stated_baseline(F.col("metric"), F.col("note"), F.lit("32 TB appliance")).alias("baseline"))


@query("k8_quote_budget", f"""WITH r AS (SELECT event_id - event_id % 2 AS evidence_id, event_id AS pos, CASE WHEN user_id % 10 > 0 THEN 'https://u/' || user_id END AS url, {_NOTE} AS quote FROM events),
f AS (SELECT evidence_id, min(pos) AS pos, first(url ORDER BY pos) AS url, list_filter(regexp_split_to_array(first(quote ORDER BY pos), '\\s+'), lambda w: w <> '') AS w FROM r GROUP BY evidence_id),
b AS (SELECT *, greatest(0, 25 - coalesce(sum(len(w)) OVER (PARTITION BY url IS NULL, coalesce(url, evidence_id::VARCHAR) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS room FROM f)
SELECT evidence_id, nullif(array_to_string(CASE WHEN room > 0 THEN w[1:room] ELSE [] END, ' '), '') AS excerpt, len(w) > room AS truncated FROM b""")
def k8(spark, d):
    """Two events are references to one piece of evidence; a user stands in for an address, every tenth has none."""
    refs = _notes(spark, d).select(
        (F.col("event_id") - F.col("event_id") % 2).alias("evidence_id"), F.col("event_id").alias("at"),
        F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("https://u/"), "user_id")).alias("url"), F.col("note").alias("quote"),
    )
    return H.quoted_excerpts(refs, "at")


@query("d7_quote_resolution", f"""WITH b AS (SELECT event_id AS quote_id, event_id // 3 AS p, {_NOTE} AS quote FROM events WHERE event_id % 4 < 3),
c AS (SELECT event_id, event_id + event_id % 2 AS quote_id, CASE event_id % 5 WHEN 0 THEN 'projection' WHEN 1 THEN 'measured' END AS level FROM events),
j AS (SELECT c.*, quote, p_partkey, p_size % 2 = 0 AS summary, quote IS NOT NULL AND (coalesce(level = 'projection', false) OR {_has('quote', R.HEDGED)}) AS open_ FROM c LEFT JOIN b USING (quote_id) LEFT JOIN part ON p_partkey = p)
SELECT event_id, coalesce(p_partkey::VARCHAR, 'unknown_quote:' || quote_id) AS evidence_id, CASE WHEN p_partkey IS NOT NULL AND contains(lower(quote), 'acme') THEN substr(quote, instr(lower(quote), 'acme'), 4) ELSE '' END AS identity,
CASE WHEN p_partkey IS NULL THEN 's' WHEN summary THEN '{H.SUMMARY}: s' ELSE '{H.PUBLISHER}: s' END AS statement, CASE WHEN open_ THEN 'inference' ELSE 'direct' END AS basis, ((p_partkey IS NOT NULL AND summary)::INT + open_::INT)::INT AS n_conditions FROM j""")
def d7(spark, d):
    """Three events in four are quotes, of the part of a third of their number; other parts and quotes are unknown."""
    notes = _notes(spark, d)
    k = F.col("event_id")
    bank = notes.filter("event_id % 4 < 3").select(k.alias("quote_id"), F.floor(k / 3).alias("evidence_id"), F.col("note").alias("text"), F.lit(None).cast("string").alias("context"))
    evidence = _parts(spark, d).select(F.col("p_partkey").alias("evidence_id"), F.when(F.col("p_size") % 2 == 0, "provided_summary").alias("access_status"))
    claims = notes.select("event_id", (k + k % 2).alias("quote_id"), F.lit("Acme").alias("name"), F.lit("s").alias("statement"), F.when(k % 5 == 0, "projection").when(k % 5 == 1, "measured").alias("level"), F.lit("direct").alias("basis"))
    return H.resolve_quotes(claims, bank, evidence).select("event_id", "evidence_id", "identity", "statement", "basis", F.size("conditions").alias("n_conditions"))


@query("d11_claim_recovery", """SELECT o_orderkey, 'judgment' AS statement, o_orderpriority AS basis, o_orderstatus AS relation, o_custkey::VARCHAR AS citation FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus <> 'P' AND o_custkey % 3 = 1
UNION ALL SELECT o_orderkey, 'finding', 'direct', 'same', o_custkey::VARCHAR FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 2 = 1""")
def d11(spark, d):
    """Orders stand in for assessments with one finding each; the customer's number says how many sources are cited."""
    cited = lambda n: F.array_repeat(F.col("o_custkey").cast("string"), (F.col("o_custkey") % n).cast("int")).alias("citations")
    relation = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus"))
    judgment = F.struct(F.lit("judgment").alias("statement"), F.col("o_orderpriority").alias("basis"), relation.alias("relation"), cited(3))
    finding = F.struct(F.lit("finding").alias("statement"), F.lit("direct").alias("basis"), F.lit("same").alias("relation"), cited(2))
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, "grounded").alias("mode"), F.array(judgment, finding).alias("items"))
    return H.recovered_claims(rows, ["o_orderkey"])


@query("j19_selector_match", """WITH m AS (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_nationkey = p_size WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % 1000 WHERE p_partkey % 3 > 0),
n AS (SELECT p_partkey, count(*) AS n, min(s_suppkey) AS s FROM m GROUP BY ALL),
k AS (SELECT p_partkey, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN s END AS s_suppkey FROM part LEFT JOIN n USING (p_partkey))
SELECT p_partkey, s_suppkey, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'many' WHEN row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) = 1 THEN 'one' ELSE 'shared' END AS verdict FROM k""")
def j19(spark, d):
    """Parts select suppliers: every third by the nation, the others by the number."""
    parts, suppliers = _parts(spark, d), _suppliers(spark, d)
    ends = lambda *key: suppliers.groupBy(*key).agg(F.min("s_suppkey").alias("s_suppkey"), F.max("s_suppkey").alias("last"))
    by_nation = parts.filter("p_partkey % 3 = 0").join(ends("s_nationkey"), F.col("s_nationkey") == F.col("p_size"))
    by_key = parts.filter("p_partkey % 3 > 0").join(ends(F.col("s_suppkey").alias("key")), F.col("key") == F.col("p_partkey") % 1000)
    matches = by_nation.select("p_partkey", "s_suppkey", "last").unionByName(by_key.select("p_partkey", "s_suppkey", "last"))
    selectors = parts.select("p_partkey", F.col("p_partkey").alias("position"))
    return H.checked_selectors(selectors, matches, "p_partkey", "s_suppkey", "position", "last").select("p_partkey", "s_suppkey", "verdict")


@query("j23_draft_evidence_match", """WITH e AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'paper:' || o_custkey || '@' || left(sha256(o_custkey::VARCHAR), 12) ELSE 'common:' || l_suppkey || '@' || left(sha256(s_name), 12) END || ':' || l_partkey AS id,
l_quantity < 50 AND (l_linenumber % 2 = 0 OR (s_suppkey IS NOT NULL AND l_discount < 0.1)) AS good FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT o_orderkey AS l_orderkey, coalesce(m, false) AS matches FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(good) AND count(*) = count(DISTINCT id) AS m FROM e GROUP BY ALL) x ON x.l_orderkey = o_orderkey""")
def j23(spark, d):
    """Orders stand in for runs over a customer's paper, suppliers for common sources; some lines have a wrong hash or prefix."""
    c = F.col
    papers = _orders(spark, d).select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").cast("string").alias("paper_id"), F.sha2(c("o_custkey").cast("string"), 256).alias("source_hash"))
    common = _suppliers(spark, d).select(c("s_suppkey").cast("string").alias("document_id"), F.sha2("s_name", 256).alias("source_hash"))
    named = common.select(c("document_id").alias("sup"), c("source_hash").alias("sup_hash"))
    lines = _lines(spark, d).join(papers, "l_orderkey").withColumn("sup", c("l_suppkey").cast("string")).join(named, "sup", "left")
    paper = c("l_linenumber") % 2 == 0
    kind, document, digest = F.when(paper, "paper").otherwise("common"), F.when(paper, c("paper_id")).otherwise(c("sup")), F.when(paper, c("source_hash")).otherwise(c("sup_hash"))
    shown = F.when(paper | (c("l_discount") < 0.1), digest).otherwise(F.reverse(digest))
    evidence = lines.select(
        "l_orderkey", kind.alias("kind"), document.alias("document_id"), shown.alias("document_hash"), c("l_returnflag").alias("snippet"),
        F.concat(kind, F.lit(":"), document, F.lit("@"), F.substring(digest, 1, 12), F.lit(":"), "l_partkey").alias("evidence_id"),
        F.when(c("l_quantity") < 50, F.sha2("l_returnflag", 256)).alias("content_hash"),
    )
    return H.matching_evidence(evidence, papers, common, "l_orderkey")


_JUDGMENTS = ("favorable", "conditional", "unfavorable", "unknown", "not_applicable", "failed")


@query("v17_domain_contract", f"""WITH c AS (SELECT l_orderkey, ({_quoted(_JUDGMENTS)})[l_suppkey % 6 + 1] AS j, l_linestatus = 'O' AS matched, l_partkey % 4 AS n, l_discount > 0.08 AS foreign_ FROM lineitem),
e AS (SELECT *, CASE WHEN foreign_ AND n > 0 THEN 'foreign_evidence' WHEN j IN ('favorable', 'conditional', 'unfavorable') AND n = 0 THEN 'evidence_required' WHEN j = 'favorable' AND NOT matched THEN 'favorable_unmatched'
WHEN j = 'unfavorable' AND matched THEN 'unfavorable_without_conflict' WHEN j = 'failed' THEN 'failed_by_model' END AS error FROM c)
SELECT l_orderkey, CASE WHEN bool_and(j IN ('unknown', 'not_applicable')) THEN 'unknown' ELSE 'completed' END AS status, bool_and(error IS NULL) AS valid FROM e GROUP BY ALL""")
def v17(spark, d):
    """Orders stand in for technologies, lines for their criteria; a high discount makes the evidence another's."""
    c = F.col
    own = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = _lines(spark, d).select(
        "l_orderkey", _pick(c("l_suppkey"), _JUDGMENTS).alias("judgment"), F.when(c("l_linestatus") == "O", "matched").otherwise("conflict").alias("alignment"),
        F.slice(own, F.lit(1), (c("l_partkey") % 4).cast("int")).alias("evidence_ids"), F.when(c("l_discount") > 0.08, F.array(F.lit("z"))).otherwise(own).alias("allowed_ids"),
    )
    return H.technology_status(H.judged_criteria(rows), ["l_orderkey"])


@query("d25_audit_scopes", """WITH k AS (SELECT DISTINCT l_orderkey, 'assessment' AS kind, l_linenumber::BIGINT AS ref FROM lineitem UNION SELECT l_orderkey, 'evidence', l_partkey FROM lineitem),
n AS (SELECT DISTINCT l_orderkey, 'opinion_' || l_linenumber AS item_id, unnest(['assessment', 'assessment', 'evidence']) AS kind, unnest([l_linenumber, l_linenumber + 1, l_partkey]) AS ref FROM lineitem WHERE l_quantity > 10)
SELECT * FROM n SEMI JOIN k USING (l_orderkey, kind, ref) UNION ALL SELECT l_orderkey, 'limitations', kind, ref FROM k WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)""")
def d25(spark, d):
    """Orders stand in for requests; a line of over ten pieces is an opinion on its own and the next line's assessment, and its part."""
    lines = _lines(spark, d)
    line, part = F.col("l_linenumber").cast("long"), F.col("l_partkey")
    ref = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("ref"))
    opinions = lines.filter("l_quantity > 10").select("l_orderkey", F.concat(F.lit("opinion_"), "l_linenumber").alias("item_id"), F.array(ref("assessment", line), ref("assessment", line + 1), ref("evidence", part)).alias("refs"))
    registry = lines.select("l_orderkey", F.inline(F.array(ref("assessment", line), ref("evidence", part))))
    return H.audit_scopes(opinions, registry, "l_orderkey")
