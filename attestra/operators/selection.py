"""Ranked and bounded choices: search candidates, technical premises, stakeholder targets, deferred opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import relevance as R

# Roles that stand in where no target was chosen for a domain, and the most targets of a domain.
FALLBACK_ROLES = {
    "operator": "서비스·인프라 운영자", "developer": "기술·플랫폼 개발자", "supplier": "공급자·경쟁 기술 진영", "observer": "투자·애널리스트·미디어",
}
MOST_TARGETS = 8
ORGANIZATION = "의 LLM 추론 서비스 운영 조직"  # Fixed value: follows the domain's name.


def rank_candidates(hits: DataFrame, request: str, position: str, name: Column, criteria: tuple[str, ...]) -> DataFrame:
    """``hits`` (url, title, content) with ``direct``, ``first_party``, ``purpose``, ``score`` and their rank in a request;
    ties keep their position."""
    body = R.joined(F.col("title"), F.col("content"))
    low = F.lower(body)
    terms = tuple(t for c in criteria for t in R.CRITERION_TERMS[c])
    scored = hits.withColumns({
        "direct": F.contains(low, F.lower(name)), "first_party": R.host(F.col("url")).isin(*R.FIRST_PARTY),
        "purpose": R.contains_any(low, terms), "score": R.relevance_score(body, name, criteria),
    })
    order = [F.desc(c) for c in ("direct", "first_party", "purpose", "score")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order, position)))


def technical_premises(evidence: DataFrame, technology: str, item: str, most: int = 2) -> DataFrame:
    """Summaries (excerpt, locator) that name an effect and memory, the best ``most`` of each technology, with their score."""
    text = F.col("excerpt")
    effects = R.effect_count(text)
    kept = evidence.filter((effects > 0) & R.has(text, "memory|cache|메모리|캐시"))
    scored = kept.withColumn("score", effects + F.when(R.has(F.col("locator"), "conclusion|abstract"), 4).otherwise(0))
    order = Window.partitionBy(technology).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def select_targets(candidates: DataFrame, domains: DataFrame, position: str) -> DataFrame:
    """(domain_id, id, name, fallback): valid candidates (domain_id, id, name, reason) of known ``domains`` (domain_id).

    An id is of letters, digits and hyphens and counts once in a domain in any case; the first ``MOST_TARGETS`` stay.  A
    domain without any gets the fixed roles.  Nulls make a candidate invalid."""
    filled = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") != ""
    valid = candidates.filter(F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9-]{0,95}\z") & filled(F.col("name")) & filled(F.col("reason")))
    known = domains.select("domain_id").distinct()
    valid = valid.join(known, "domain_id", "left_semi").withColumn("_key", F.lower("id"))
    first = valid.groupBy("domain_id", "_key").agg(F.min_by(F.struct("id", "name"), position).alias("t"), F.min(position).alias("at"))
    order = Window.partitionBy("domain_id").orderBy("at", "_key")
    chosen = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_TARGETS)
    chosen = chosen.select("domain_id", "t.id", "t.name", F.lit(False).alias("fallback"))
    roles = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in FALLBACK_ROLES.items()]))
    missing = known.join(valid, "domain_id", "left_anti").select("domain_id", roles.alias("t"))
    return chosen.unionByName(missing.select("domain_id", "t.id", "t.name", F.lit(True).alias("fallback")))


def operating_organizations(domains: DataFrame) -> DataFrame:
    """One deciding organization for each domain (domain_id, name); a null name counts as empty."""
    return domains.select(F.lit("operator").alias("id"), "domain_id", F.concat(F.coalesce("name", F.lit("")), F.lit(ORGANIZATION)).alias("name"))


def defer_rejected(opinions: DataFrame, checks: DataFrame, request: str) -> DataFrame:
    """``opinions`` (request, item_id) with ``deferred``; no row of a request that has to be withdrawn as a whole.

    ``checks`` has (request, item_id, verdict), and a verdict other than supported (null too) rejects.  A request is
    withdrawn if its limitations are rejected, if nothing is, or if nothing stays."""
    rejected = checks.filter(~F.col("verdict").eqNullSafe("supported")).select(request, "item_id").distinct()
    open_ = opinions.join(rejected.filter("item_id = 'limitations'").select(request).distinct(), request, "left_anti")
    marked = open_.join(rejected.withColumn("_rejected", F.lit(True)), [request, "item_id"], "left")
    marked = marked.withColumn("deferred", F.coalesce("_rejected", F.lit(False))).drop("_rejected")
    verdict = marked.groupBy(request).agg(F.bool_or("deferred").alias("_some"), F.bool_and("deferred").alias("_all"))
    return marked.join(verdict.filter("_some and not _all").select(request), request, "left_semi")
