"""Secret scans over a trigram inverted index, in built-in functions only.

Index: documents are dealt into segments; for each trigram that some rule's query names, a segment has the posting list
of its documents that hold it.  Query: a rule's branch intersects its posting lists inside every segment, the branches'
results are united, and only these candidates are verified with the rule's expression.  Rules without a mandatory
trigram scan every text.  Index and queries are ASCII lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .trigram_query import mandatory

SEGMENT_ROWS = 4096


@dataclass(frozen=True)
class SecretRule:
    """kind: its name in spans.  pattern: for Java and Python alike.  group: what has to have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def branches(self) -> list[list[str]]:
        return mandatory(self.pattern)


# The three base rules in their listed order, then the kinds that this scan adds.
BASE = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
RULES = BASE + ADDED


def spans_of(text: Column, rule: SecretRule) -> Column:
    """Array of (start, end) in code points: leftmost, non-overlapping, failing matches dropped.

    ``\\G`` ties each find to the end of the last, so the text is cut into pieces of gap and match in one pass; a running
    sum of the pieces' lengths places them.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\G[\s\S]*?(?:{rule.pattern})"), F.lit(0))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(acc: Column, piece: Column) -> Column:
        # the match is the leftmost one of its own piece
        found = F.regexp_extract(piece, rule.pattern, 0)
        counted = F.regexp_extract(piece, rule.pattern, rule.group) if rule.group else found
        end = acc["at"] + F.length(piece)
        span = F.struct((end - F.length(found)).cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(counted) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def postings(docs: DataFrame, vocabulary: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index: (segment, trigram, docs); a segment holds about ``SEGMENT_ROWS`` documents by id."""
    ahead = "(?=(" + "|".join(_quoted(t) for t in vocabulary) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(ahead), F.lit(1)))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("trigram"))
    rows = rows.withColumn("segment", F.floor(F.col("id") / SEGMENT_ROWS))
    return rows.groupBy("segment", "trigram").agg(F.collect_set("id").alias("docs"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{ord(c):02x}" for c in text)


def candidates(docs: DataFrame, rules: Sequence[SecretRule], id_col: str, text_col: str) -> DataFrame:
    """(id, kinds): the rules with mandatory trigrams that a document may match."""
    queries = [(r.kind, n, b) for r in rules for n, b in enumerate(r.branches)]
    if not queries:
        return docs.sparkSession.createDataFrame([], f"id {dict(docs.dtypes)[id_col]}, kinds array<string>")
    vocabulary = sorted({t for _, _, b in queries for t in b})
    wanted = docs.sparkSession.createDataFrame([(k, n, len(b), t) for k, n, b in queries for t in b], "kind string, branch int, needs int, trigram string")
    lists = postings(docs, vocabulary, id_col, text_col).join(F.broadcast(wanted), "trigram")  # the rules' own few rows
    found = lists.groupBy("segment", "kind", "branch", "needs").agg(F.collect_list("docs").alias("lists"))
    found = found.filter(F.size("lists") == F.col("needs"))
    met = F.aggregate(F.slice("lists", 2, 1 << 20), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    rows = found.select("kind", F.explode(met).alias("id"))
    return rows.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def scan(df: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id and ``found``, an array of (start, order, kind, end) sorted by start.

    Null and empty texts give an empty array.  Rows that repeat an id share their candidate kinds and are verified one by
    one; rows with a null id are verified against every rule.  An empty table gives an empty result.
    """
    rules = list(rules)
    docs = df.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    indexed = [r for r in rules if r.branches]
    hits = candidates(docs, indexed, "id", "text").select(F.col("id").alias("_id"), "kinds")
    rows = docs.join(hits.hint("shuffle_hash"), F.col("id") == F.col("_id"), "left").drop("_id")
    none = F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")
    found = []
    for order, rule in enumerate(rules):
        spans = F.transform(spans_of(F.col("text"), rule), _named(order, rule.kind))
        if rule in indexed:
            maybe = F.col("id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            spans = F.when(maybe, spans).otherwise(none)
        found.append(spans)
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat(*found)).alias("found"))


def _named(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    return rows.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''").replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
        parts.append(f"""SELECT rid, {order} AS o, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
          SELECT rid, length(regexp_extract(piece, '{pattern}', 0)) AS lm, regexp_extract(piece, '{pattern}', 0) AS m, regexp_extract(piece, '{pattern}', {rule.group}) AS v,
                 sum(length(piece)) OVER (PARTITION BY rid ORDER BY i) AS e
          FROM (SELECT rid, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '[\\s\\S]*?(?:{pattern})') AS ps FROM d)))
        WHERE length(v) >= {rule.least}""")
    every = "\nUNION ALL\n".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({every}),
a AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
        string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, o) FILTER (o < 3) AS base,
        string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, o) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


ORACLE = _oracle()
