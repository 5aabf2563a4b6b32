"""Quality rules as a short-circuit cascade, in built-in functions only.

``order_rules`` measures each rule on a sample: its cost (seconds for the sample's rows) and its selectivity (share
it rejects), and orders the rules by rejection per cost.  ``verdict`` then evaluates them in that order inside one
CASE expression, whose later branches run only for rows that passed the earlier ones.  A row is kept when no rule
rejects it, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 5  # words in a window of the repetition count
# The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named predicate over the text column; true rejects the row."""

    name: str
    rejects: Column


def n_words(text: Column) -> Column:
    return F.size(_words(text)).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, common.SPACE + "+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, common.SPACE + "+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(common.WORD))


def n_dup_lines(text: Column) -> Column:
    lines = _lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more in the text, the first included.

    Windows are compared by 64-bit hash inside one text.  Texts whose window hashes all differ, most of them, stop
    after a hash set; the others sort (hash, place) pairs, keep places whose neighbour has the same hash, and add up
    the union of the windows from the gaps between consecutive places.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_covered(hashes)).cast("long")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: a one-element array mapped by ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    def places(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1
        key = lambda i: F.get(sorted_pairs, i).getField("h")
        hit = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & (key(i) == key(i - 1))) | ((i < last) & (key(i) == key(i + 1))))
        return F.array_sort(F.transform(hit, lambda i: F.get(sorted_pairs, i).getField("p")))

    def union(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.least(F.get(at, i) - F.get(at, i - 1), F.lit(WINDOW)))
        return F.when(F.size(at) < 2, F.size(at) * WINDOW).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, g: a + g))

    def slow(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return _let(pairs, lambda s: _let(places(s), union))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)))


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < 10) | (repeated * 100 > n * 20)


def default_rules(text: Column) -> list[Rule]:
    """The two base rules, and lenient ones that only text which is hardly prose fails."""
    n, repeated = n_words(text), _let(_words(text), repeated_words)
    return [
        Rule("too_few_words", n < 10),
        Rule("repeated_words", repeated * 100 > n * 20),
        Rule("symbols", n_symbols(text) * 4 > word_chars(text)),
        Rule("word_length", word_chars(text) > n * 40),
        Rule("no_letters", ~text.rlike(r"\p{L}")),
    ]


def sample_of(df: DataFrame, text_col: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` texts for the estimates, in a local table; taking them reads only the first partitions needed."""
    texts = df.select(common.text_or_empty(text_col).alias("text")).sample(fraction=0.25, seed=seed).take(rows)
    return df.sparkSession.createDataFrame([(r.text,) for r in texts], "text string").coalesce(1)


def order_rules(df: DataFrame, make_rules, text_col: str = "text", sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """(rule, cost, rejected share) on a sample of at most ``sample_rows`` rows, best rejection per cost first."""
    texts = sample_of(df, text_col, sample_rows)
    rules = make_rules(F.col("text"))
    total = max(1, texts.count())
    measured = []
    for rule in rules:
        probe = texts.agg(F.coalesce(F.sum(rule.rejects.cast("long")), F.lit(0)).alias("n"))
        probe.first()  # compiles the plan
        began = time.perf_counter()
        rejected = probe.first().n
        measured.append((rule, max(time.perf_counter() - began, 1e-4), rejected / total))
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[0].name))


def verdict(rules: Sequence[Rule]) -> Column:
    """The name of the first rule, in the given order, that rejects the row; null if none does."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(found)
    return found


def quality_filter(df: DataFrame, text_col: str = "text", make_rules=default_rules, sample_rows: int = 1000) -> DataFrame:
    """The rows of ``df`` that pass every rule, columns unchanged, whatever their names.

    A null text has no words and fails.  Repeated rows are judged alike; an empty table gives an empty result.  A text is
    judged as a whole, however long.
    """
    order = [m[0] for m in order_rules(df, make_rules, text_col, sample_rows)]
    names = {r.name: r for r in make_rules(common.text_or_empty(text_col))}
    return df.filter(verdict([names[r.name] for r in order]).isNull())


def statistics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 1000) -> DataFrame:
    """One row for each row of ``df``: the base counts, base_failed and the cascade's verdict ``kept``.

    Null texts have no words: all counts are 0 and base_failed is true.  Rows that repeat give equal rows; an empty table
    gives an empty result; other columns are not read.  A text is counted as a whole, however long.  The cascade has all
    rules, the base ones too, in the measured order, over counts that are returned anyway.
    """
    order = [m[0].name for m in order_rules(df, default_rules, text_col, sample_rows)]
    rows = df.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    n, text = F.col("n_words"), F.col("text")
    rejects = {  # the same rules over counts that are there already
        "too_few_words": n < 10,
        "repeated_words": F.col("n_repeat_words") * 100 > n * 20,
        "symbols": F.col("n_symbols") * 4 > F.col("word_chars"),
        "word_length": F.col("word_chars") > n * 40,
        "no_letters": ~text.rlike(r"\p{L}"),
    }
    kept = verdict([Rule(name, rejects[name]) for name in order]).isNull()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed(n, F.col("n_repeat_words")).alias("base_failed"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, len(ws) AS n, unnest(range(1, greatest(len(ws) - 3, 1))) AS p, ws FROM w),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(ws[p:p + 4], ' ')) AS c FROM g),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM h WHERE c > 1) GROUP BY rid),
s AS (SELECT d.rid, d.doc_id, d.text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 4 > word_chars OR word_chars > n_words * 40 OR NOT regexp_matches(text, '\p{L}')) AS kept
FROM f
"""
