"""Operators on evidence records: sources, tables, aliases, queues, query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import records as f

# Queries that every plan asks, by group; {} is the quoted title.
TEMPLATES = {
    "critical_inventory": ["{} abstract contributions conclusion headline results"],
    "mechanisms": ["{} method algorithm equation architecture mechanism"],
    "experiments": [
        "{} table results baseline model hardware latency throughput memory accuracy",
        '{} "Table I" testing matrix performance speedup ranges batch sizes context lengths model platform host memory disk storage',
        "{} ablation experimental setup evaluation protocol measured emulated simulated",
        "{} context sweep range averaged result action-space ablation",
        "{} prefill overhead TTFT setup preprocessing latency breakdown break-even generated tokens",
    ],
    "scope": ["{} datasets workloads model scale context length applicability assumptions"],
    "limitations": [
        "{} limitations failure cases compute data constraints reproducibility future work",
        "{} physical hardware end-to-end validation pending connector integration emulation simulation measured",
    ],
    "visuals": ["{} Table Figure architecture performance results"],
}


def first_sources(sources: DataFrame, position: str = "position", content: str = "content") -> DataFrame:
    """(hash, position) of the first source of each content; null content counts as empty."""
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    return sources.groupBy(digest.alias("hash")).agg(F.min(position).alias(position))


def common_sources(papers: DataFrame, common: DataFrame) -> DataFrame:
    """Common sources whose content no paper has; both sides as from ``first_sources``."""
    return common.join(papers.select("hash"), "hash", "left_anti")


def reading_order(elements: DataFrame, document: str) -> DataFrame:
    """``elements`` (page, y0, x0, kind, element_id) with their ``position`` in the document; no place on a page comes last."""
    placed = F.col("y0").isNotNull() & F.col("x0").isNotNull()
    at = [F.when(placed, F.col(c)).asc_nulls_last() for c in ("y0", "x0")]
    order = Window.partitionBy(document).orderBy("page", *at, f.kind_order(F.col("kind")), "element_id")
    return elements.withColumn("position", F.row_number().over(order))


def useful_tables(rows: DataFrame, table: str) -> DataFrame:
    """Verdict on tables given row by row: (table, row_index, cells array<string>, captioned).

    Useful are two rows and columns or more, a header with a word, and 35 % of all places filled, 60 % without a caption.
    Rows without cells do not count; of rows with the least index the emptiest is the header.  Rows are reduced to their counts before the shuffle."""
    filled = F.size(F.filter("cells", lambda c: c.isNotNull() & (F.trim(c) != "")))
    lines = rows.filter(F.size("cells") > 0).select(table, "row_index", "captioned", F.size("cells").alias("w"), filled.alias("n"))
    stats = lines.groupBy(table).agg(
        F.count("*").alias("n_rows"), F.max("w").cast("long").alias("width"), F.sum("n").alias("n_filled"),
        F.min(F.struct("row_index", "n"))["n"].alias("head"), F.max("captioned").alias("captioned"),
    )
    share = F.col("n_filled") / (F.col("n_rows") * F.col("width"))
    verdict = (F.col("n_rows") >= 2) & (F.col("width") >= 2) & (F.col("head") > 0) & (share >= F.when(F.col("captioned"), 0.35).otherwise(0.60))
    return stats.select(table, "n_rows", "width", "n_filled", verdict.alias("useful"))


def resolve_aliases(refs: DataFrame, aliases: DataFrame, raw: str = "ref") -> DataFrame:
    """``refs`` with ``resolved``: the alias of the id, else of the id without its ``owner::`` prefix, else that bare id.

    ``aliases`` has one row an ``alias`` with its ``target``."""
    bare = F.regexp_replace(raw, "^[a-z]+::", "")
    whole = aliases.select(F.col("alias").alias(raw), F.col("target").alias("_whole"))
    part = aliases.select(F.col("alias").alias("_bare"), F.col("target").alias("_part"))
    both = refs.withColumn("_bare", bare).join(whole, raw, "left").join(part, "_bare", "left")
    return both.withColumn("resolved", F.coalesce("_whole", "_part", "_bare")).drop("_bare", "_whole", "_part")


def requirement_grid(requests: DataFrame, request: str, criteria: list[str], supplied: DataFrame) -> DataFrame:
    """Every criterion of every request with its supplied (target, priority), the last by ``position``, or the defaults.

    ``supplied`` has (request, criterion, target, priority, position); an unknown priority becomes should."""
    last = supplied.groupBy(request, "criterion").agg(F.max(F.struct("position", "target", "priority")).alias("s"))
    grid = requests.select(request).distinct().withColumn("criterion", F.explode(F.array(*map(F.lit, criteria))))
    rows = grid.join(last, [request, "criterion"], "left")
    given = F.when(F.col("s.priority").isin("must", "should", "could"), F.col("s.priority")).otherwise("should")
    return rows.select(request, "criterion", F.coalesce("s.target", F.lit("unspecified")).alias("target"), given.alias("priority"))


def routed(reviews: DataFrame) -> DataFrame:
    """``reviews`` (round, repair, blocked) with their ``route`` and next ``round``: a repair is made once, in round 0.

    A repair asked for in a later round goes on as if it had not been."""
    again = F.coalesce(F.col("repair"), F.lit(False)) & (F.col("round") == 0)
    route = F.when(again, "repair").when(F.col("blocked"), "diagnostic").otherwise("report")
    return reviews.withColumn("route", route).withColumn("round", F.when(again, F.lit(1)).otherwise(F.col("round")).cast("long"))


def candidate_queue(ranked: DataFrame, group: str, question: str, most: int = 3) -> DataFrame:
    """Candidates (group, question, rank, …) in turns: every question's first, then every second, up to ``most``."""
    order = Window.partitionBy(group).orderBy("rank", question)
    return ranked.filter(F.col("rank") <= most).withColumn("position", F.row_number().over(order))


def augmented_queries(queries: DataFrame, plan: str, position: str, text: str, title: Column, most: int = 4) -> DataFrame:
    """(plan, topic, queries): the first ``most`` queries of a plan, then the topic's own, without repeats.

    Only the first ones of a plan are collected; a plan without a query is not in the result."""
    first = queries.withColumn("_n", F.row_number().over(Window.partitionBy(plan).orderBy(position))).filter(F.col("_n") <= most)
    packed = first.groupBy(plan).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("q")))).alias("_q"))
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    own = F.array(*[F.struct(F.lit(topic).alias("topic"), F.array(*[F.concat(quoted, F.lit(t[2:])) for t in lines]).alias("lines")) for topic, lines in TEMPLATES.items()])
    rows = packed.select(plan, F.transform("_q", lambda s: s["q"]).alias("_q"), F.explode(own).alias("_t"))
    return rows.select(plan, F.col("_t.topic").alias("topic"), F.array_distinct(F.concat("_q", F.col("_t.lines"))).alias("queries"))
