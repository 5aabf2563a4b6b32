"""Evidence-shaped queries: labels, units, routing, resolution that is unique or nothing, plans over grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import relations as R
from attestra.operators import retrieval as V
from attestra.plans import relational_plans as P

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("t5_caption_label", r"SELECT p_partkey, regexp_replace(regexp_extract(c, '^(Table|Figure|Fig\.) +[0-9]+'), '^Fig\.', 'Figure') AS label FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Table ' WHEN 1 THEN 'Fig. ' ELSE 'Note ' END || p_size::VARCHAR || ': ' || p_name AS c FROM part)")
def t5(spark, d):
    c = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Table ").when(F.col("p_partkey") % 3 == 1, "Fig. ").otherwise("Note "), F.col("p_size").cast("string"), F.lit(": "), F.col("p_name"))
    return P._parts(spark, d).select("p_partkey", F.regexp_replace(F.regexp_extract(c, r"^(Table|Figure|Fig\.) +[0-9]+", 0), r"^Fig\.", "Figure").alias("label"))


@query("t8_roman_numbers", """SELECT p_partkey, repeat('L', p_size // 50) || CASE WHEN p_size % 50 >= 40 THEN 'XL' ELSE repeat('X', p_size % 50 // 10) END
  || CASE p_size % 10 WHEN 9 THEN 'IX' WHEN 4 THEN 'IV' ELSE repeat('V', p_size % 10 // 5) || repeat('I', p_size % 10 % 5) END AS roman FROM part""")
def t8(spark, d):
    n = F.col("p_size")
    tens = F.when(n % 50 >= 40, "XL").otherwise(F.repeat(F.lit("X"), F.floor(n % 50 / 10).cast("int")))
    ones = F.when(n % 10 == 9, "IX").when(n % 10 == 4, "IV").otherwise(F.concat(F.repeat(F.lit("V"), F.floor(n % 10 / 5).cast("int")), F.repeat(F.lit("I"), n % 10 % 5)))
    return P._parts(spark, d).select("p_partkey", F.concat(F.repeat(F.lit("L"), F.floor(n / 50).cast("int")), tens, ones).alias("roman"))


@query("t13_unit_suffix", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN round(value, 1)::VARCHAR || '%' WHEN event_type = 'purchase' THEN round(value, 1)::VARCHAR || '×' ELSE round(value, 1)::VARCHAR END AS shown FROM events")
def t13(spark, d):
    v = F.round("value", 1).cast("string")
    return P._events(spark, d).select("event_id", F.when(F.col("event_type").isin("view", "click"), F.concat(v, F.lit("%"))).when(F.col("event_type") == "purchase", F.concat(v, F.lit("×"))).otherwise(v).alias("shown"))


@query("t22_name_match", r"SELECT n_nationkey, count(*) FILTER (regexp_matches(c_name, '(^|[^A-Za-z0-9_])' || '[Cc]ustomer' || '[-# ]*0*' || n_nationkey::VARCHAR || '($|[^A-Za-z0-9_])')) AS hits FROM nation, customer GROUP BY n_nationkey")
def t22(spark, d):
    n = P._nations(spark, d).select("n_nationkey")
    names = P._customers(spark, d).select("c_name").join(V.bounded(n), F.lit(True))
    hit = F.expr(r"c_name rlike concat('(?<![A-Za-z0-9_])[Cc]ustomer[-# ]*0*', n_nationkey, '(?![A-Za-z0-9_])')")
    return names.groupBy("n_nationkey").agg(F.count_if(hit).alias("hits"))


@query("t25_subjects", r"""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}')) AS x FROM documents) SELECT doc_id, len(x) AS subjects, CASE WHEN len(x) = 0 THEN '' ELSE list_sort(x)[1] END AS least FROM s""")
def t25(spark, d):
    x = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}"), F.lit(0)))
    return P._documents(spark, d).select("doc_id", F.size(x).cast("long").alias("subjects"), F.coalesce(F.array_min(x), F.lit("")).alias("least"))


@query("t27_table_markdown", "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey::VARCHAR || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey")
def t27(spark, d):
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    rows = P._nations(spark, d).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    return rows.select("n_regionkey", F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.array_join(F.col("x.r"), "\n")).alias("md"))


@query("t28_observation_text", "SELECT s_suppkey, s_name || ': ' || s_suppkey::VARCHAR || ' units' || CASE WHEN s_acctbal > 0 THEN '; baseline=' || s_nationkey::VARCHAR ELSE '' END AS claim FROM supplier")
def t28(spark, d):
    parts = F.concat_ws("; ", F.concat(F.col("s_name"), F.lit(": "), F.col("s_suppkey").cast("string"), F.lit(" units")), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("baseline="), F.col("s_nationkey").cast("string"))))
    return P._suppliers(spark, d).select("s_suppkey", parts.alias("claim"))


@query("t31_criteria_tags", """WITH k(tag, word) AS (VALUES ('legal', 'license'), ('legal', 'copyright'), ('secret', 'password'), ('secret', 'token'), ('contact', '@'))
SELECT doc_id, tag, count(*) AS hits FROM documents JOIN k ON contains(lower(text), word) GROUP BY ALL""")
def t31(spark, d):
    words = spark.createDataFrame([("legal", "license"), ("legal", "copyright"), ("secret", "password"), ("secret", "token"), ("contact", "@")], "tag string, word string")
    rows = P._documents(spark, d).select("doc_id", F.lower("text").alias("t")).join(F.broadcast(words), F.expr("contains(t, word)"))  # the given word list
    return rows.groupBy("doc_id", "tag").agg(F.count("*").alias("hits"))


@query("t35_brace_balance", "WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^{}]', '', 'g'), '')) AS ch, unnest(range(1, length(regexp_replace(text, '[^{}]', '', 'g')) + 1)) AS i FROM documents), r AS (SELECT doc_id, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth, i FROM c) SELECT doc_id, coalesce((SELECT min(depth) >= 0 AND arg_max(depth, i) = 0 FROM r WHERE r.doc_id = d.doc_id AND i IS NOT NULL), true) AS balanced FROM documents d")
def t35(spark, d):
    signs = F.split(F.regexp_replace("text", "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s, c):
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return P._documents(spark, d).select("doc_id", F.aggregate(signs, zero, step, lambda s: (s["depth"] == 0) & (s["least"] == 0)).alias("balanced"))


@query("t36_bbox_union", "SELECT l_orderkey, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey + l_linenumber) AS x1, max(l_suppkey + l_linenumber) AS y1 FROM lineitem GROUP BY l_orderkey")
def t36(spark, d):
    return P._lines(spark, d).groupBy("l_orderkey").agg(F.min("l_partkey").alias("x0"), F.min("l_suppkey").alias("y0"), F.max(F.col("l_partkey") + F.col("l_linenumber")).alias("x1"), F.max(F.col("l_suppkey") + F.col("l_linenumber")).alias("y1"))


@query("t38_safe_names", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS safe FROM pages")
def t38(spark, d):
    return P._pages(spark, d).select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), "(^-|-$)", "").alias("safe"))


@query("f2_active_generation", "SELECT user_id, event_id FROM events JOIN (SELECT event_type AS t, max(event_id) % 7 AS gen FROM events GROUP BY event_type) ON event_type = t AND event_id % 7 = gen")
def f2(spark, d):
    e = P._events(spark, d)
    pointer = e.groupBy("event_type").agg((F.max("event_id") % 7).alias("gen"))  # one row a type
    return e.withColumn("gen", F.col("event_id") % 7).join(V.bounded(pointer), ["event_type", "gen"]).select("user_id", "event_id")


@query("f3_eligibility", "SELECT o_orderkey, least(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, 2) AS level FROM orders WHERE o_orderdate <= TIMESTAMP '1997-12-31' AND o_orderpriority NOT LIKE '4%'")
def f3(spark, d):
    level = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return P._orders(spark, d).filter((F.col("o_orderdate") <= F.lit("1997-12-31").cast("timestamp")) & ~F.col("o_orderpriority").startswith("4")).select("o_orderkey", level.alias("level"))


@query("f7_same_page_exclusion", "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id < p.page_id AND regexp_replace(lower(q.url), '[?#].*$', '') = regexp_replace(lower(p.url), '[?#].*$', ''))")
def f7(spark, d):
    rows = P._pages(spark, d).select("page_id", F.regexp_replace(F.lower("url"), "[?#].*$", "").alias("k"))
    return rows.groupBy("k").agg(F.min("page_id").alias("page_id")).select("page_id")


@query("f16_pruned_view", """SELECT o_orderkey, '{"o_custkey":' || o_custkey::VARCHAR || ',"o_orderstatus":"' || o_orderstatus || '"' || CASE WHEN o_orderpriority LIKE '1%' THEN ',"urgent":true' ELSE '' END || '}' AS view FROM orders""")
def f16(spark, d):
    body = F.to_json(F.struct("o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), F.lit(True)).alias("urgent")))
    return P._orders(spark, d).select("o_orderkey", body.alias("view"))


@query("g5_cell_expansion", "SELECT l_orderkey, NULL::INT AS cell, count(*)::BIGINT AS n, 'row total' AS label FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, l_linenumber, 1, 'line=' || l_linenumber::VARCHAR || '; flag=' || l_returnflag FROM lineitem")
def g5(spark, d):
    rows = P._lines(spark, d)
    whole = rows.groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", F.lit(None).cast("int").alias("cell"), "n", F.lit("row total").alias("label"))
    cells = rows.select("l_orderkey", F.col("l_linenumber").alias("cell"), F.lit(1).cast("long").alias("n"), F.concat(F.lit("line="), F.col("l_linenumber").cast("string"), F.lit("; flag="), F.col("l_returnflag")).alias("label"))
    return whole.unionByName(cells)


@query("g9_best_sentence", r"""WITH s AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
SELECT source, doc_id, sha FROM (SELECT source, doc_id, sha256(s) AS sha, row_number() OVER (PARTITION BY source ORDER BY length(s) DESC, doc_id, sha256(s)) AS n FROM s) WHERE n = 1""")
def g9(spark, d):
    from attestra.functions.text import sentences

    rows = P._documents(spark, d).select("source", "doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    best = rows.groupBy("source").agg(F.min(F.struct((-F.length("s")).alias("l"), "doc_id", F.sha2("s", 256).alias("sha"))).alias("b"))  # combines before the shuffle
    return best.select("source", "b.doc_id", "b.sha")


@query("j6_adjacent", "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def j6(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return P._events(spark, d).select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("next"))


@query("j8_unique_suffix", "SELECT c_custkey, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS resolved FROM customer LEFT JOIN supplier ON right(c_name, 2) = right(s_name, 2) AND c_nationkey = s_nationkey GROUP BY c_custkey")
def j8(spark, d):
    s = P._suppliers(spark, d).select(F.col("s_nationkey").alias("c_nationkey"), F.expr("right(s_name, 2)").alias("tail"), "s_suppkey")
    n = s.groupBy("c_nationkey", "tail").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("k"))
    rows = P._customers(spark, d).select("c_custkey", "c_nationkey", F.expr("right(c_name, 2)").alias("tail")).join(n, ["c_nationkey", "tail"], "left")
    return rows.select("c_custkey", F.when(F.col("n") == 1, F.col("k")).alias("resolved"))


@query("j10_row_companions", "SELECT a.l_orderkey, a.l_linenumber, count(b.l_linenumber) AS companions FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber <> b.l_linenumber GROUP BY ALL")
def j10(spark, d):
    """Companions are counted by a window, not by joining a group with itself; lines repeated in an order count by line."""
    rows = P._lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.count("*").alias("m"))
    total = F.sum("m").over(Window.partitionBy("l_orderkey", "l_returnflag"))
    per = rows.withColumn("companions", F.col("m") * (total - F.col("m")))
    return per.groupBy("l_orderkey", "l_linenumber").agg(F.sum("companions").alias("companions"))


@query("j18_inventory_merge", "SELECT coalesce(c, s) AS nation, customers, suppliers FROM (SELECT c_nationkey AS c, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS s, count(*) AS suppliers FROM supplier GROUP BY 1) ON c = s")
def j18(spark, d):
    c = P._customers(spark, d).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return c.join(P._suppliers(spark, d).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full_outer").select("nation", "customers", "suppliers")


@query("j21_ordered_references", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'F') AS filled, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus <> 'F') AS others FROM orders GROUP BY o_custkey")
def j21(spark, d):
    rows = P._orders(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("x"))
    pick = lambda yes: F.transform(F.filter("x", lambda r: (r["o_orderstatus"] == "F") == F.lit(yes)), lambda r: r["o_orderkey"].cast("string"))
    return rows.select("o_custkey", *[F.when(F.size(pick(y)) > 0, F.array_join(pick(y), ",")).alias(n) for y, n in ((True, "filled"), (False, "others"))])


@query("r13_embedding_text", "SELECT doc_id, sha256('Section: ' || source || chr(10) || 'Object: ' || lang || chr(10) || text) AS sha FROM documents")
def r13(spark, d):
    return P._documents(spark, d).select("doc_id", F.sha2(F.concat_ws("\n", F.concat(F.lit("Section: "), "source"), F.concat(F.lit("Object: "), "lang"), "text"), 256).alias("sha"))


@query("r15_grouped_hits", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 4 END")
def r15(spark, d):
    kind = F.col("o_orderstatus") == "F"
    n = F.row_number().over(Window.partitionBy("o_custkey", kind).orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return P._orders(spark, d).withColumn("n", n).filter(F.col("n") <= F.when(kind, 8).otherwise(4)).select("o_custkey", "o_orderkey")


@query("r17_feature_ranking", "SELECT p_partkey, score FROM (SELECT p_partkey, 100 * (p_size > 40)::INT + p_size + 2 * (p_name LIKE '%a%')::INT + 2 * (p_brand LIKE '%3%')::INT AS score, row_number() OVER (PARTITION BY p_brand ORDER BY 100 * (p_size > 40)::INT + p_size + 2 * (p_name LIKE '%a%')::INT + 2 * (p_brand LIKE '%3%')::INT DESC, p_partkey) AS n FROM part) WHERE n <= 8")
def r17(spark, d):
    yes = lambda c: c.cast("int")
    score = 100 * yes(F.col("p_size") > 40) + F.col("p_size") + 2 * yes(F.col("p_name").contains("a")) + 2 * yes(F.col("p_brand").contains("3"))
    return V.top_k(P._parts(spark, d).select("p_brand", "p_partkey", score.alias("score")), 8, "p_brand", "p_partkey", "score").select("p_partkey", "score")


@query("a8_pair_status", "SELECT n_regionkey, CASE WHEN bool_and(n > 0) THEN 'direct_available' WHEN bool_or(n > 0) THEN 'limited' ELSE 'none' END AS status FROM (SELECT n_regionkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey) GROUP BY n_regionkey")
def a8(spark, d):
    s = P._suppliers(spark, d).select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    rows = P._nations(spark, d).join(s, "n_nationkey", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rows.groupBy("n_regionkey").agg(F.bool_and("hit").alias("every"), F.bool_or("hit").alias("some")).select("n_regionkey", R.first_failing([("direct_available", F.col("every")), ("limited", F.col("some")), ("none", F.lit(True))]).alias("status"))


@query("a12_decision_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P') AS unknown, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS filled, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 400 THEN 'partial' ELSE 'complete' END AS status FROM orders GROUP BY o_orderpriority")
def a12(spark, d):
    rows = P._orders(spark, d).groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").alias("unknown"), F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6).alias("filled"))
    return rows.withColumn("status", F.when(F.col("unknown") > 400, "partial").otherwise("complete"))


@query("a25_question_plan", "SELECT n_nationkey, seg, 'What about ' || n_name || ' in ' || seg || '?' AS question FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) WHERE (n_nationkey, seg) NOT IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8000)")
def a25(spark, d):
    c = P._customers(spark, d)
    grid = P._nations(spark, d).select("n_nationkey", "n_name").crossJoin(c.select(F.col("c_mktsegment").alias("seg")).distinct())  # two short lists of names
    seen = c.filter("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).distinct()
    return grid.join(seen, ["n_nationkey", "seg"], "left_anti").select("n_nationkey", "seg", F.concat(F.lit("What about "), "n_name", F.lit(" in "), "seg", F.lit("?")).alias("question"))


@query("v15_use_matrix", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'scope' WHEN o_totalprice > 300000 THEN 'size' END AS issue FROM orders")
def v15(spark, d):
    codes = [("pending", F.col("o_orderstatus") == "P"), ("scope", (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")), ("size", F.col("o_totalprice") > 300000)]
    return P._orders(spark, d).select("o_orderkey", R.first_failing(codes).alias("issue"))


@query("v16_link_integrity", "SELECT o_orderkey, o_ok, l_n FROM (SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer) AS o_ok, coalesce(n, 0) AS l_n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def v16(spark, d):
    c = P._customers(spark, d).select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known")).distinct()
    n = P._lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("l_n"))
    rows = P._orders(spark, d).select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(n, "o_orderkey", "left")
    return rows.select("o_orderkey", F.col("known").isNotNull().alias("o_ok"), F.coalesce("l_n", F.lit(0)).alias("l_n"))


@query("v21_audit_sets", "SELECT coalesce(d, l) AS doc_id, CASE WHEN l IS NULL THEN 'unaudited' WHEN d IS NULL THEN 'foreign' ELSE 'audited' END AS state FROM (SELECT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON d = l")
def v21(spark, d):
    a = P._documents(spark, d).select("doc_id", F.lit(True).alias("d"))
    rows = a.join(P._labels(spark, d).select("doc_id", F.lit(True).alias("l")).distinct(), "doc_id", "full_outer")
    return rows.select("doc_id", F.when(F.col("l").isNull(), "unaudited").when(F.col("d").isNull(), "foreign").otherwise("audited").alias("state"))


@query("v29_facet_coverage", "SELECT conv_id, list_contains(list(DISTINCT role), 'user') AND list_contains(list(DISTINCT role), 'assistant') AS covered, count(DISTINCT role) > 3 AS extra FROM conversations GROUP BY conv_id")
def v29(spark, d):
    roles = F.collect_set("role")
    rows = P._turns(spark, d).groupBy("conv_id").agg(roles.alias("r"))
    return rows.select("conv_id", (F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), "r")) == 0).alias("covered"), (F.size("r") > 3).alias("extra"))


@query("d2_namespaced_ids", "SELECT 'paper::' || s_suppkey::VARCHAR AS id, CASE WHEN count(c_custkey) = 1 THEN 'linked' ELSE 'auto' END AS link FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9900 GROUP BY s_suppkey")
def d2(spark, d):
    c = P._customers(spark, d).filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    return P._suppliers(spark, d).join(c, "s_nationkey", "left").select(F.concat(F.lit("paper::"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("n") == 1, "linked").otherwise("auto").alias("link"))


@query("d6_chunk_manifest", "SELECT source, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS manifest, count(*) AS chunks FROM documents GROUP BY source")
def d6(spark, d):
    """A source's manifest is the digest of its texts' digests in id order."""
    rows = P._documents(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("x"))
    return rows.select("source", F.sha2(F.array_join("x.h", ","), 256).alias("manifest"), F.size("x").cast("long").alias("chunks"))


@query("d17_distinct_materials", "SELECT lang, source, count(DISTINCT sha256(text)) AS materials FROM documents GROUP BY ALL")
def d17(spark, d):
    return P._documents(spark, d).groupBy("lang", "source").agg(F.count_distinct(F.sha2("text", 256)).alias("materials"))


@query("d23_dossier_assembly", "SELECT o_custkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def d23(spark, d):
    """Every part that a customer's lines refer to."""
    l = P._lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("p"))  # noqa: E741
    rows = P._orders(spark, d).select("o_orderkey", "o_custkey").join(l, "o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_set("p")).alias("x"))
    return rows.select("o_custkey", F.array_join("x", ",").alias("parts"))


# the name under which the whole dossier was first asked for
query("d23_whole_dossier", ORACLES["d23_dossier_assembly"])(d23)


@query("d29_unknown_grid", "SELECT r_name, seg, 'unknown' AS status, 'no evidence' AS reason FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def d29(spark, d):
    segments = P._customers(spark, d).select(F.col("c_mktsegment").alias("seg")).distinct()
    return P._regions(spark, d).select("r_name").crossJoin(segments).select("r_name", "seg", F.lit("unknown").alias("status"), F.lit("no evidence").alias("reason"))  # two short lists of names
