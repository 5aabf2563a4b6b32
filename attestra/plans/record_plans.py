"""Queries of record rules and of gated retrieval, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra import config
from attestra.functions import records as f
from attestra.operators import records as O
from attestra.operators import retrieval as V
from attestra.tables import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(g):
        QUERIES[name] = g
        if sql:
            ORACLES[name] = sql
        return g

    return add


def _table(name):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


_orders, _lines, _customers, _parts, _nations, _suppliers = map(_table, ("orders", "lineitem", "customer", "part", "nation", "supplier"))
_events, _turns, _labels, _documents, _vectors = map(_table, ("events", "conversations", "labels", "documents", "embeddings"))


def _pick(key, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


@query("s3_source_dedup", """WITH h AS (SELECT doc_id, lang = 'en' AS paper, sha256(coalesce(text, '')) AS hash FROM documents)
SELECT hash, min(doc_id) AS doc_id, 'paper' AS kind FROM h WHERE paper GROUP BY hash
UNION ALL SELECT hash, min(doc_id), 'common' FROM h WHERE NOT paper AND hash NOT IN (SELECT hash FROM h WHERE paper) GROUP BY hash""")
def s3(spark, d):
    """English documents stand in for papers, the others for common sources."""
    docs = _documents(spark, d)
    papers, common = (O.first_sources(docs.filter(c), "doc_id", "text") for c in ("lang = 'en'", "lang <> 'en'"))
    return papers.withColumn("kind", F.lit("paper")).unionByName(O.common_sources(papers, common).withColumn("kind", F.lit("common")))


_RAW_DATE = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y')
WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 4 THEN strftime(o_orderdate, '%Y년 %m월 %d일') WHEN 5 THEN strftime(o_orderdate, '%a, %d %b %Y 10:20:30 +0000') ELSE 'undated' END"""


@query("s10_dates", f"SELECT o_orderkey, {_RAW_DATE} AS raw, CASE WHEN o_orderkey % 7 <> 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def s10(spark, d):
    shapes = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMM yyyy", "yyyy.MM.dd", "yyyy년 MM월 dd일", "EEE, dd MMM yyyy '10:20:30 +0000'"]
    raw = F.lit("undated")
    for i, shape in enumerate(shapes):
        raw = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", shape)).otherwise(raw)
    return _orders(spark, d).select("o_orderkey", raw.alias("raw")).withColumn("day", f.normalized_date(F.col("raw")).cast("string"))


@query("s23_reading_order", """SELECT l_orderkey, element_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, y0 NULLS LAST, x0 NULLS LAST, kind, element_id)::INT AS position
FROM (SELECT l_orderkey, l_linenumber AS element_id, l_suppkey % 3 AS page, CASE WHEN l_discount > 0.02 THEN l_tax END AS y0, CASE WHEN l_discount > 0.02 THEN l_quantity END AS x0,
CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 9 END AS kind FROM lineitem)""")
def s23(spark, d):
    place = lambda c: F.when(F.col("l_discount") > 0.02, F.col(c))
    kind = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "table").otherwise("other")
    rows = _lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("element_id"), (F.col("l_suppkey") % 3).alias("page"), place("l_tax").alias("y0"), place("l_quantity").alias("x0"), kind.alias("kind"))
    return O.reading_order(rows, "l_orderkey").select("l_orderkey", "element_id", "position")


@query("f8_quote_criteria", "WITH p AS (SELECT unnest(['" + "','".join(f.QUOTE_PATTERNS) + "']) AS criterion, unnest(['" + "','".join(f.QUOTE_PATTERNS.values()) + """']) AS pattern),
t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), 'no cost to efficiency', '', 'g') AS x FROM documents)
SELECT doc_id, criterion FROM t, p WHERE regexp_matches(CASE criterion WHEN 'ecosystem_support' THEN regexp_replace(x, 'hardware[- ]supported(?: bit[- ]widths)?', '', 'g') ELSE x END, pattern)""")
def f8(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(f.relevant_criteria(F.col("text"))).alias("criterion"))


@query("f10_useful_tables", """WITH c AS (SELECT l_orderkey, l_linenumber, (l_returnflag <> 'N')::INT + (l_linestatus <> 'O')::INT + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT AS n FROM lineitem),
t AS (SELECT l_orderkey, count(*) AS n_rows, 4::BIGINT AS width, sum(n)::BIGINT AS n_filled, arg_min(n, l_linenumber * 10 + n) AS head FROM c GROUP BY l_orderkey)
SELECT l_orderkey, n_rows, width, n_filled, n_rows >= 2 AND head > 0 AND n_filled / (n_rows * 4) >= CASE WHEN l_orderkey % 2 = 0 THEN 0.35::DOUBLE ELSE 0.60::DOUBLE END AS useful FROM t""")
def f10(spark, d):
    """An order is a table of four columns whose cells may be blank; even orders have a caption."""
    text = lambda keep, c: F.when(keep, F.col(c).cast("string")).otherwise(F.lit(" "))
    cells = F.array(text(F.col("l_returnflag") != "N", "l_returnflag"), text(F.col("l_linestatus") != "O", "l_linestatus"), text(F.col("l_discount") > 0.05, "l_discount"), text(F.col("l_tax") > 0.04, "l_tax"))
    rows = _lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("row_index"), (F.col("l_orderkey") % 2 == 0).alias("captioned"), cells.alias("cells"))
    return O.useful_tables(rows, "l_orderkey")


_CRITERIA = list(f.QUOTE_PATTERNS)
_CELLS = f"""SELECT o_orderkey, (['exact', 'method_family', 'adjacent_market'])[o_orderkey % 3 + 1] AS relation, (['{"', '".join(_CRITERIA)}'])[o_custkey % 6 + 1] AS criterion FROM orders"""


def _cells(spark, d):
    return _orders(spark, d).select("o_orderkey", _pick(F.col("o_orderkey"), "exact", "method_family", "adjacent_market").alias("relation"), _pick(F.col("o_custkey"), *_CRITERIA).alias("criterion"))


@query("f13_assessment_eligible", f"SELECT o_orderkey, relation, criterion, relation = 'exact' OR criterion NOT IN ('commercialization', 'adoption') AS eligible FROM ({_CELLS})")
def f13(spark, d):
    return _cells(spark, d).withColumn("eligible", f.assessment_eligible(F.col("relation"), F.col("criterion")))


@query("d34_conditional_scope", f"""SELECT o_orderkey, CASE relation WHEN 'method_family' THEN '관련 기술군' ELSE '인접 시장' END || ' 근거에 따른 조건부 평가' AS scope,
CASE criterion {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in f.CONDITIONAL.items())} END AS caveat FROM ({_CELLS}) WHERE relation <> 'exact'""")
def d34(spark, d):
    rows = _cells(spark, d).filter("relation <> 'exact'")
    return rows.select("o_orderkey", f.conditional_scope(F.col("relation"), F.col("criterion")).alias("s")).select("o_orderkey", "s.scope", "s.caveat")


@query("f19_pending_sources", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)")
def f19(spark, d):
    """A label's quality is the decision; a document without one is pending."""
    decision = F.when(F.col("quality") == 1, "use").when(F.col("quality") == 0, "exclude")
    decided = _labels(spark, d).select("doc_id", decision.alias("decision")).filter(F.col("decision").isin("use", "limited", "exclude"))
    return _documents(spark, d).select("doc_id").join(decided, "doc_id", "left_anti")


@query("t9_cell_suffix", "SELECT l_orderkey, l_linenumber, printf('cell-r%02d-c%02d', l_linenumber, l_suppkey % 120) AS suffix FROM lineitem")
def t9(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", f.cell_suffix(F.col("l_linenumber"), F.col("l_suppkey") % 120).alias("suffix"))


@query("t10_aggregate_suffix", """WITH g AS (SELECT l_orderkey, l_suppkey % 2 AS part, min(l_linenumber - 1) FILTER (l_linenumber > 1) AS a, max(l_linenumber - 1) FILTER (l_linenumber > 1) AS b, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, count(*) AS n_all FROM lineitem GROUP BY ALL)
SELECT l_orderkey, part, CASE WHEN n = n_all THEN 'whole' WHEN a IS NOT NULL THEN printf('rows-r%02d-r%02d', a, b) ELSE 'rows-' || sha256(l_orderkey || ':' || part)[1:12] END AS suffix FROM g JOIN t USING (l_orderkey)""")
def t10(spark, d):
    """Lines of an order are a table's rows, dealt into two groups by supplier."""
    lines = _lines(spark, d).select("l_orderkey", (F.col("l_suppkey") % 2).alias("part"), (F.col("l_linenumber") - 1).alias("row"))
    rows = lambda p: F.filter("all", lambda r: r["part"] == p)
    tables = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("part", "row")).alias("all"))
    parts = tables.select("l_orderkey", "all", F.explode(F.array_distinct(F.transform("all", lambda r: r["part"]))).alias("part"))
    mine = rows(F.col("part"))
    name = f.aggregate_suffix(F.size(mine) == F.size("all"), F.transform(mine, lambda r: r["row"]), F.sha2(F.concat_ws(":", "l_orderkey", "part"), 256))
    return parts.select("l_orderkey", "part", name.alias("suffix"))


@query("t14_scaled_quantities", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])([0-9][0-9,]*(?:\.[0-9]+)?(?:\s*(?:thousand|million|billion|trillion|백만|천|만|억|조))?)', 1)) AS t FROM documents),
n AS (SELECT doc_id, replace(regexp_extract(t, '^[0-9,.]*[0-9]'), ',', '') AS x, CASE lower(regexp_extract(t, '[^0-9,.\s]+$')) WHEN 'thousand' THEN 3 WHEN 'million' THEN 6 WHEN 'billion' THEN 9 WHEN 'trillion' THEN 12
WHEN '천' THEN 3 WHEN '만' THEN 4 WHEN '백만' THEN 6 WHEN '억' THEN 8 WHEN '조' THEN 12 ELSE 0 END AS p FROM m),
k AS (SELECT doc_id, p - length(split_part(x, '.', 2)) AS e, ltrim(split_part(x, '.', 1) || split_part(x, '.', 2), '0') AS d FROM n),
v AS (SELECT DISTINCT doc_id, rtrim(d, '0') AS m, CASE WHEN d = '' THEN NULL ELSE e + length(d) END AS place FROM k)
SELECT doc_id, string_agg(CASE WHEN m = '' THEN '0' ELSE m || 'e' || (place - length(m)) END, ' ' ORDER BY place NULLS FIRST, m) AS quantities FROM v GROUP BY doc_id""")
def t14(spark, d):
    rows = _documents(spark, d).select("doc_id", f.scaled_quantities(F.col("text")).alias("q")).filter(F.size("q") > 0)
    return rows.select("doc_id", F.concat_ws(" ", "q").alias("quantities"))


@query("t15_units", """SELECT event_id, u.unit, u.code, u.factor::BIGINT AS factor, u.kind FROM events JOIN (VALUES (0, 'USD', 'USD', 1, NULL), (1, 'million units', NULL, 1000000, 'count'), (2, '%', NULL, 1, 'percent'), (3, ' Euros ', 'EUR', 1, NULL),
(4, 'US dollars', 'USD', 1, NULL), (5, '₩', 'KRW', 1, NULL), (6, 'Percent of modules', NULL, 1, 'count'), (7, 'billion', NULL, 1000000000, NULL), (8, 'millions', NULL, 1, NULL)) u(i, unit, code, factor, kind) ON event_id % 9 = u.i""")
def t15(spark, d):
    unit = _pick(F.col("event_id"), "USD", "million units", "%", " Euros ", "US dollars", "₩", "Percent of modules", "billion", "millions")
    u = F.col("unit")
    return _events(spark, d).select("event_id", unit.alias("unit")).select("event_id", "unit", f.currency(u).alias("code"), f.scale(u).alias("factor"), f.dimension(u).alias("kind"))


@query("t40_blank_missing", "SELECT event_id, ([event_type, '', '', '', '', '', event_type || ' n/a'])[event_id % 7 + 1] AS shown FROM events")
def t40(spark, d):
    i = (F.col("event_id") % 7 + 1).cast("int")
    given = F.element_at(F.array(F.concat(F.lit(" "), "event_type"), F.lit("미표기"), F.lit(" Unknown "), F.lit("N/A"), F.lit(None).cast("string"), F.lit("없음"), F.concat("event_type", F.lit(" n/a"))), i)
    return _events(spark, d).select("event_id", f.blank_missing(given).alias("shown"))


@query("j22_alias_resolution", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'sw::p' || l_partkey WHEN 1 THEN 'p' || l_partkey WHEN 2 THEN 'hw::x' || l_partkey ELSE 'x' || l_partkey END AS ref FROM lineitem)
SELECT l_orderkey, l_linenumber, ref, CASE WHEN l_partkey % 4 < 2 AND p_size > 10 THEN 'x' || l_partkey ELSE regexp_replace(ref, '^[a-z]+::', '') END AS resolved FROM r JOIN part ON p_partkey = l_partkey
WHERE p_size > 10 OR l_partkey % 4 >= 2""")
def j22(spark, d):
    """Parts of a size over 10 have an alias p<key> of their id x<key>; a reference stays if it names a part's id."""
    key = F.col("l_partkey")
    ref = F.when(key % 4 == 0, F.concat(F.lit("sw::p"), key)).when(key % 4 == 1, F.concat(F.lit("p"), key)).when(key % 4 == 2, F.concat(F.lit("hw::x"), key)).otherwise(F.concat(F.lit("x"), key))
    parts = _parts(spark, d).select("p_size", F.concat(F.lit("p"), "p_partkey").alias("alias"), F.concat(F.lit("x"), "p_partkey").alias("target"))
    out = O.resolve_aliases(_lines(spark, d).select("l_orderkey", "l_linenumber", ref.alias("ref")), parts.filter("p_size > 10").select("alias", "target"))
    return out.join(parts.select(F.col("target").alias("resolved")), "resolved", "left_semi").select("l_orderkey", "l_linenumber", "ref", "resolved")


@query("j2_unresolved_quotes", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40)")
def j2_quotes(spark, d):
    refs = _lines(spark, d).filter("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return _parts(spark, d).select("p_partkey", "p_brand").join(refs, "p_partkey", "left_anti")


@query("a23_set_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def a23(spark, d):
    ids = lambda s: _orders(spark, d).filter(F.col("o_orderstatus") == s).select("o_custkey")
    return ids("F").intersect(ids("P"))


@query("a18_candidate_queue", """WITH r AS (SELECT c_nationkey, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY rank <= 3)
SELECT c_nationkey, o_custkey, o_orderkey, rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY rank, o_custkey)::INT AS position FROM r""")
def a18(spark, d):
    ranked = V.top_k(_orders(spark, d).select("o_custkey", "o_orderkey", "o_totalprice"), 3, "o_custkey", "o_orderkey", "o_totalprice")
    homes = _customers(spark, d).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return O.candidate_queue(ranked.join(homes, "o_custkey").drop("o_totalprice"), "c_nationkey", "o_custkey").select("c_nationkey", "o_custkey", "o_orderkey", "rank", "position")


_TEMPLATES = ", ".join(f"('{topic}', {10 + i}, '{line[2:]}')" for topic, lines in O.TEMPLATES.items() for i, line in enumerate(lines))


@query("d21_augmented_queries", f"""WITH t(topic, place, line) AS (VALUES {_TEMPLATES}),
q AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 4),
u AS (SELECT conv_id, topic, n, text FROM q, t UNION ALL SELECT DISTINCT conv_id, topic, place, '"conversation ' || conv_id || '"' || line FROM q, t),
f AS (SELECT conv_id, topic, text, min(n) AS n FROM u GROUP BY ALL)
SELECT conv_id, topic, string_agg(text, chr(31) ORDER BY n) AS queries FROM f GROUP BY ALL""")
def d21(spark, d):
    rows = O.augmented_queries(_turns(spark, d), "conv_id", "turn", "text", F.concat(F.lit("conversation "), "conv_id"))
    return rows.withColumn("queries", F.array_join("queries", "\x1f"))


@query("w1_ranked_window", "SELECT event_type, user_id, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id)::INT AS rank FROM events QUALIFY rank <= 2")
def w1(spark, d):
    rows = _events(spark, d).select("event_type", "user_id", "event_id", "value", F.struct("event_type", "user_id").alias("g"))
    return V.top_k(rows, 2, "g", "event_id", "value").drop("g")


@query("r1_cosine", "SELECT a.vec_id AS id, round(coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 0), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def r1(spark, d):
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    after = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return v.join(after, "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


# Retrieval over vectors: coordinates over 1/8 stand in for learned sparse weights, four slices of 16 for token vectors,
# ids that leave 3 when divided by 7 for visuals, and ids with the same hundred for the queries of one request.
_RANKED = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 20 = 0),
ds AS (SELECT query_id, vec_id AS item_id, round(coalesce(list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS score FROM e, q),
p AS (SELECT vec_id AS item_id, i AS term, v[i] AS w FROM e, range(1, 65) r(i) WHERE v[i] > 0.125),
ss AS (SELECT b.item_id AS query_id, a.item_id, round(sum(a.w * b.w), 6) AS score FROM p a JOIN p b USING (term) WHERE b.item_id % 20 = 0 GROUP BY ALL),
l AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ds QUALIFY rank <= 24
UNION ALL SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ss QUALIFY rank <= 24),
fs AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fs),
fw AS (SELECT *, CASE WHEN item_id % 7 = 3 THEN row_number() OVER (PARTITION BY query_id, item_id % 7 = 3 ORDER BY item_id // 7 % 5 DESC, score DESC, item_id) END AS vr FROM fr),
fv AS (SELECT *, min(rank) FILTER (vr = 1) OVER (PARTITION BY query_id) AS fst FROM fw),
gate AS (SELECT query_id, item_id, least(rank, 32)::INT AS slot FROM fv WHERE rank < 32 OR (rank = 32 AND coalesce(fst <= 32, true)) OR (rank > 32 AND rank = fst))"""
_RERANKED = _RANKED + """, tok AS (SELECT vec_id, k, v[k * 16 + 1:k * 16 + 16] AS t FROM e, range(4) r(k)),
ms AS (SELECT query_id, item_id, round(avg(best), 6) AS max_sim FROM (SELECT query_id, item_id, a.k, max(list_dot_product(a.t, b.t)) AS best FROM gate JOIN tok a ON a.vec_id = query_id JOIN tok b ON b.vec_id = item_id GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT query_id, item_id, max_sim, row_number() OVER (PARTITION BY query_id ORDER BY max_sim DESC, item_id)::INT AS rank FROM ms)"""


def _visual():
    return F.expr("CASE WHEN item_id % 7 = 3 THEN item_id div 7 % 5 END")


def _gate(spark, d):
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dense = V.dense_top_k(v, v.filter("id % 20 = 0"), config.DENSE_K)
    terms = v.select(F.col("id").alias("item_id"), F.posexplode("vector").alias("term", "weight")).filter("weight > 0.125").withColumn("weight", F.col("weight").cast("double"))
    asked = terms.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    sparse = V.sparse_top_k(terms, asked, config.SPARSE_K)
    fused = V.reciprocal_rank_fusion([dense, sparse])
    visuals = V.rank_visuals(fused, _visual())
    return V.candidate_gate(visuals, config.FUSION_CANDIDATES)


def _reranked(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), tokens.alias("tokens"))
    return V.rerank(_gate(spark, d), v)


@query("r4_candidate_gate", f"WITH {_RANKED} SELECT query_id, item_id, slot FROM gate")
def r4(spark, d):
    return _gate(spark, d).select("query_id", "item_id", "slot")


@query("r6_rerank_in_gate", f"WITH {_RERANKED} SELECT query_id, item_id, max_sim, rank, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM rr")
def r6(spark, d):
    return _reranked(spark, d)


@query("r7_multi_query_fusion", f"""WITH {_RERANKED}, s AS (SELECT query_id // 100 AS request, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM rr GROUP BY ALL)
SELECT request, item_id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, item_id)::INT AS rank FROM s""")
def r7(spark, d):
    return _fused(_reranked(spark, d))


def _fused(ranked):
    return V.multi_query_fusion(ranked.withColumn("request", F.floor(F.col("query_id") / 100)), "request")


def _reserved(ranked):
    """Queries whose id leaves 0 when divided by 40 stand for those that name a table or figure."""
    visuals = V.rank_visuals(ranked, _visual()).withColumns({"request": F.floor(F.col("query_id") / 100), "explicit": F.col("query_id") % 40 == 0})
    return V.reserved_visuals(visuals, "request")


_REQUESTS = """, s AS (SELECT query_id // 100 AS request, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM rr GROUP BY ALL),
ar AS (SELECT request, item_id, row_number() OVER (PARTITION BY request ORDER BY score DESC, item_id)::INT AS rank FROM s),
bv AS (SELECT query_id, item_id FROM rr WHERE item_id % 7 = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY item_id // 7 % 5 DESC, rank) = 1),
rw AS (SELECT query_id // 100 AS request, item_id, min(query_id) FILTER (query_id % 40 = 0) AS told, count(*) AS n FROM bv GROUP BY ALL),
rv AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY request ORDER BY told NULLS LAST, n DESC, item_id) <= 2)"""


@query("r10_visual_reservation", f"WITH {_RERANKED}{_REQUESTS} SELECT request, item_id FROM rv")
def r10(spark, d):
    """The best visual of each query; of these, those of queries that name one, then those that most queries have."""
    return _reserved(_reranked(spark, d)).select("request", "item_id")


@query("r11_full_retrieval")
def r11(spark, d):
    """Gate, rerank, fusion over a request's queries, then eight diverse items that include the reserved visuals.

    The reranked lists are written once; what follows reads them.  Each item comes with its trace: the fused place, and the
    best dense-and-sparse slot and MaxSim of the request's queries."""
    gate = written(_gate(spark, d), "gate")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    ranked = written(V.rerank(gate, _vectors(spark, d).select(F.col("vec_id").alias("id"), tokens.alias("tokens"))), "reranked")
    fused = written(_fused(ranked).withColumnRenamed("request", "query_id"), "fused")
    vectors = _vectors(spark, d).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    selected = written(V.mmr(fused.join(vectors, "item_id").select("query_id", "item_id", "score", "vector"), config.PAPER_HITS), "diverse")
    reserved = _reserved(ranked).withColumnRenamed("request", "query_id")
    places = fused.select("query_id", "item_id", F.col("rank").alias("fused_place"))
    hits = V.reserve(selected, reserved.join(places, ["query_id", "item_id"]).select("query_id", "item_id", F.col("fused_place").alias("place")))
    trace = ranked.join(gate.select("query_id", "item_id", "slot"), ["query_id", "item_id"]).groupBy(F.floor(F.col("query_id") / 100).alias("query_id"), "item_id").agg(F.min("slot").alias("best_slot"), F.max("max_sim").alias("best_max_sim"))
    held = reserved.select("query_id", "item_id", F.lit(True).alias("held"))
    out = hits.join(places, ["query_id", "item_id"]).join(trace, ["query_id", "item_id"]).join(held, ["query_id", "item_id"], "left")
    return out.select(F.col("query_id").alias("request"), "item_id", "rank", "fused_place", "best_slot", "best_max_sim", F.coalesce("held", F.lit(False)).alias("reserved"))


@query("t32_evidence_method", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id // 5 % 4 IN (0, 3) THEN 'gpu_experiment' ELSE 'measurement' END WHEN 1 THEN 'emulation' WHEN 2 THEN 'simulation' WHEN 3 THEN 'analysis' ELSE 'unknown' END AS method FROM events""")
def t32(spark, d):
    mode = _pick(F.col("event_id"), "measured", "emulated", "simulated", "analytical", "planned")
    return _events(spark, d).select("event_id", f.evidence_method(mode, _pick(F.floor(F.col("event_id") / 5), "NVIDIA A100", "CPU server", None, "rtx 4090")).alias("method"))


@query("t37_lexical_words", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_.+/-]{2,}'), lambda w: trim(lower(w), '._+/-')),
lambda w: w NOT IN ('', 'the', 'and', 'with', 'from', 'that', 'this', 'result', 'results')))), ' ') AS words FROM documents""")
def t37(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(f.lexical_words(F.col("text")), " ").alias("words"))


@query("d31_requirement_grid", """WITH g AS (SELECT n_nationkey, 'c' || i AS criterion FROM nation, range(10) r(i)),
s AS (SELECT s_nationkey AS n_nationkey, 'c' || (s_suppkey % 10) AS criterion, arg_max(s_name, s_suppkey) AS target, arg_max((['must', 'urgent', 'could'])[s_suppkey % 3 + 1], s_suppkey) AS priority FROM supplier GROUP BY ALL)
SELECT n_nationkey, criterion, coalesce(target, 'unspecified') AS target, CASE WHEN priority IN ('must', 'could') THEN priority ELSE 'should' END AS priority FROM g LEFT JOIN s USING (n_nationkey, criterion)""")
def d31(spark, d):
    supplied = _suppliers(spark, d).select(
        F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("c"), F.col("s_suppkey") % 10).alias("criterion"), F.col("s_name").alias("target"),
        _pick(F.col("s_suppkey"), "must", "urgent", "could").alias("priority"), F.col("s_suppkey").alias("position"),
    )
    return O.requirement_grid(_nations(spark, d), "n_nationkey", [f"c{i}" for i in range(10)], supplied)


@query("f17_referenced_evidence", "SELECT p_partkey, p_brand FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT unnest([l_partkey, l_partkey + l_suppkey]) FROM lineitem WHERE l_quantity >= 45)")
def f17(spark, d):
    """Parts of a size up to 25 stand in for paper evidence; lines of 45 pieces and more name two ids each."""
    refs = _lines(spark, d).filter("l_quantity >= 45").select(F.explode(F.array("l_partkey", F.col("l_partkey") + F.col("l_suppkey"))).alias("p_partkey"))
    return _parts(spark, d).filter("p_size <= 25").select("p_partkey", "p_brand").join(refs, "p_partkey", "left_semi")


@query("w8_conditional_routing", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'repair' WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'diagnostic' ELSE 'report' END AS route,
CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 1 ELSE o_orderkey % 2 END::BIGINT AS round FROM orders""")
def w8(spark, d):
    """Partly filled orders ask for a repair; the round is the key's last bit; the highest and lowest priority block a report."""
    rows = _orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 2).alias("round"), (F.col("o_orderstatus") == "P").alias("repair"), F.col("o_orderpriority").isin("1-URGENT", "5-LOW").alias("blocked"))
    return O.routed(rows).select("o_orderkey", "route", "round")


@query("d32_claim_lines", "SELECT conv_id, turn, '[' || coalesce(role, 'unknown') || '] ' || regexp_replace(text, '\\s+', ' ', 'g') AS line FROM conversations WHERE text IS NOT NULL")
def d32(spark, d):
    text = F.regexp_replace("text", r"\s+", " ")
    return _turns(spark, d).filter("text IS NOT NULL").select("conv_id", "turn", F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("] "), text).alias("line"))
