"""Precise evidence for what a claim says: numbers, evaluation modes, and the context around visuals.

A match counts only if it is the one best; ties are refused.  Candidates are found by equality joins on an inverted index of
(document, number) or (document, page, object, number) and summed up at once, so no list of pairs is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import normalized_numbers
from attestra.functions.records import lexical_words
from attestra.tables import written

# How a passage names its evaluation mode, and the kinds of chunks.
MODES = {
    "emulated": r"(?i)\bemulat(?:e|ed|es|ing|ion|ions)\b", "simulated": r"(?i)\bsimulat(?:e|ed|es|ing|ion|ions)\b",
    "measured": r"(?i)\bmeasur(?:e|ed|es|ing|ement|ements)\b", "analytical": r"(?i)\banalyt(?:ic|ical|ically|ics)\b",
}
VISUAL, CONTEXT = ("table", "figure", "chart", "diagram"), ("text", "table", "caption")
LEAST_WORDS, LEAST_MODE_WORDS = 2, 3  # words that a claim has to share with a passage of its document
NOWHERE = -10_000  # page affinity of a passage without a page


def _numbers_of(evidence: DataFrame) -> DataFrame:
    """(evidence_id, document_id, page, objects, words, numbers, exact): a row for each evidence, ``exact`` its precise numbers."""
    cell = lambda c: F.concat(*[normalized_numbers(c[f]) for f in ("raw_text", "row_header", "column_header")])
    cells = F.coalesce(F.flatten(F.transform("cells", cell)), F.array().cast("array<string>"))
    objects = F.filter(F.array_distinct(F.array("element_id", "parent_element_id")), lambda o: o.isNotNull() & (o != ""))
    table, place = F.col("kind").eqNullSafe("table"), F.when(F.col("method") == "vision", F.col("has_crop")).otherwise(F.col("has_span"))
    rows = evidence.select("evidence_id", "document_id", "page", table.alias("_table"), F.coalesce(place, F.lit(False)).alias("_place"), F.when(table, cells).alias("_cells"), objects.alias("objects"), lexical_words(F.col("snippet")).alias("words"), normalized_numbers(F.col("snippet")).alias("numbers"))
    # numbers are taken by two branches, so the planner doesn't read the texts anew in either
    exact = F.when(F.col("_table"), F.array_intersect("numbers", "_cells")).when(F.col("_place"), F.col("numbers")).otherwise(F.array().cast("array<string>"))
    return rows.select("evidence_id", "document_id", "page", "objects", "words", "numbers", exact.alias("exact"))


def _affinity(page: Column, pages: Column) -> list[Column]:
    """Whether a page is among ``pages``, then minus the distance to the nearest; no page is farthest."""
    gap = F.array_min(F.transform(pages, lambda p: F.abs(p - page)))
    return [F.coalesce((gap == 0).cast("int"), F.lit(-1)).alias("here"), F.coalesce(-gap, F.lit(NOWHERE)).cast("long").alias("near")]


def numeric_locators(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, place, number, evidence_id, how): exact evidence for numbers whose cited evidence is not precise.

    ``claims``: unique claim_id, text, refs (evidence ids); ``evidence``: unique evidence_id, document_id, page, element_id,
    parent_element_id, kind, method, snippet, has_span, has_crop, cells (raw_text, row_header, column_header).  ``place`` is
    the number's place in the text.  First the one precise evidence of the same object on the same page as a cited one
    that has the number (how: object); else the one precise evidence of a cited document that shares most words, two at
    least, and is nearest to a cited page (how: document).  Nulls are no numbers, words, pages or objects; unknown refs are
    passed over; an empty side gives an empty result.
    """
    asked = claims.select("claim_id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), lexical_words(F.col("text")).alias("said"), normalized_numbers(F.col("text")).alias("numbers"))
    asked, index = written(asked, "claims"), written(_numbers_of(evidence), "numbers")  # texts are read once, whatever follows
    wanted = asked.filter(F.size("numbers") > 0)
    own = lambda c: F.array_intersect(c, "_wanted").alias(c)
    cited = wanted.select("claim_id", F.col("numbers").alias("_wanted"), F.explode(F.array_distinct("refs")).alias("evidence_id")).join(index.select("evidence_id", "document_id", "page", "objects", "numbers", "exact"), "evidence_id")
    cited = cited.select("claim_id", F.struct("document_id", "page", "objects", own("numbers"), own("exact")).alias("cite")).groupBy("claim_id").agg(F.collect_list("cite").alias("cites"))
    settled = F.flatten(F.col("cites.exact"))
    numbers = F.transform("numbers", lambda n, i: F.struct(i.cast("int").alias("place"), n.alias("number")))
    pending = wanted.join(cited, "claim_id").withColumn("_settled", settled).select("claim_id", "refs", "said", "cites", F.filter(numbers, lambda n: ~F.array_contains("_settled", n["number"])).alias("open"))
    papers = pending.filter(F.size("open") > 0).select("claim_id", "refs", "said", "open", F.explode("cites").alias("cite"))
    papers = papers.groupBy("claim_id", F.col("cite.document_id").alias("document_id")).agg(*[F.first(c).alias(c) for c in ("refs", "said", "open")], F.collect_set("cite.page").alias("pages"), F.collect_list("cite").alias("cites"))
    sought = papers.select("claim_id", "document_id", "refs", "said", "pages", "cites", F.explode("open").alias("n")).select("*", "n.place", "n.number").drop("n")
    exact = index.select("evidence_id", "document_id", "page", "objects", "words", F.explode("exact").alias("number"))
    # the objects of cited evidence are its document's, so both stages look at the same pairs
    met = sought.join(exact, ["document_id", "number"]).filter(~F.array_contains("refs", F.col("evidence_id")))
    same = F.exists("cites", lambda c: c["page"].eqNullSafe(F.col("page")) & F.arrays_overlap(c["objects"], F.col("objects")) & F.array_contains(c["numbers"], F.col("number")))
    here, near = _affinity(F.col("page"), F.col("pages"))
    scored = met.select("claim_id", "number", "place", "evidence_id", same.alias("same"), F.size(F.array_intersect("said", "words")).alias("shared"), here, near)
    fit = lambda x: F.when(F.col("shared") >= LEAST_WORDS, x)
    best = scored.groupBy("claim_id", "number").agg(
        F.min("place").alias("place"), F.min(F.when(F.col("same"), F.col("evidence_id"))).alias("one"), F.max(F.when(F.col("same"), F.col("evidence_id"))).alias("other"),
        F.min(fit(F.struct(-F.col("shared"), -F.col("here"), -F.col("near"), F.col("evidence_id").alias("id")))).alias("low"), F.max(fit(F.struct("shared", "here", "near", F.col("evidence_id").alias("id")))).alias("high"),
    )
    by_object, by_document = F.col("one") == F.col("other"), F.col("low.id") == F.col("high.id")
    found = best.select("claim_id", "place", "number", F.when(by_object, F.col("one")).when(by_document, F.col("low.id")).alias("evidence_id"), F.when(by_object, "object").otherwise("document").alias("how"))
    return found.filter("evidence_id IS NOT NULL")


def with_locators(claims: DataFrame, found: DataFrame) -> DataFrame:
    """``claims`` whose refs have the found evidence after their own, in order of the numbers, each id once."""
    added = found.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("_added"))
    refs = F.array_distinct(F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.coalesce("_added", F.array().cast("array<string>"))))
    return claims.join(added, "claim_id", "left").withColumn("refs", refs).drop("_added")


def evaluation_modes(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(observation_id, mode, evidence_id) for observations whose document says, in one best passage, how it evaluates.

    ``observations``: observation_id, description, refs; ``evidence`` as above.  Passages of cited documents that name exactly
    one mode and share three words or more compete; the mode is taken if all those that share most words name it, and the
    passage nearest to a cited page, the least id of these, supports it.
    """
    said = observations.select("observation_id", lexical_words(F.col("description")).alias("said"), F.explode(F.array_distinct("refs")).alias("evidence_id"))
    papers = said.join(evidence.select("evidence_id", "document_id", "page"), "evidence_id").groupBy("observation_id", "document_id").agg(F.first("said").alias("said"), F.collect_set("page").alias("pages"))
    named = F.array_compact(F.array(*[F.when(F.col("snippet").rlike(p), m) for m, p in MODES.items()]))
    passages = evidence.select("evidence_id", "document_id", "page", lexical_words(F.col("snippet")).alias("words"), named.alias("modes")).filter(F.size("modes") == 1)
    here, near = _affinity(F.col("page"), F.col("pages"))
    rows = papers.join(passages, "document_id").select("observation_id", "evidence_id", F.get("modes", F.lit(0)).alias("mode"), F.size(F.array_intersect("said", "words")).alias("shared"), here, near)
    level = rows.filter(F.col("shared") >= LEAST_MODE_WORDS).groupBy("observation_id", "shared").agg(F.min("mode").alias("mode"), F.max("mode").alias("other"), F.min(F.struct(-F.col("here"), -F.col("near"), F.col("evidence_id").alias("id"))).alias("best"))
    top = level.groupBy("observation_id").agg(F.max_by(F.struct("mode", "other", "best"), "shared").alias("top")).filter("top.mode = top.other")
    return top.select("observation_id", F.col("top.mode").alias("mode"), F.col("top.best.id").alias("evidence_id"))


# ------------------------------------------------------------------ context around visuals


def neighbours(anchors: list[dict], page: dict[str, np.ndarray], most: int) -> list[tuple[str, str, int, float]]:
    """(anchor, chunk, relation, distance) of up to ``most`` chunks for each anchor in turn, none of them twice.

    Relation 0: linked by element ids, 1: the same label, 2: the label is in the text, 3: only near, which needs boxes on
    both sides.  Then the vertical distance decides, then the id.
    """
    folded = [x.casefold() for x in page["text"]]
    labels = np.array([x.casefold() for x in page["object_label"]], object)
    rank = np.argsort(np.argsort(page["chunk_id"].astype(str)))
    free = np.ones(len(folded), bool)
    told: dict[str, np.ndarray] = {}
    out = []
    for a in anchors:
        relation = np.full(len(folded), 3)
        label = (a["object_label"] or "").casefold()
        if label:
            if label not in told:
                told[label] = np.fromiter((label in x for x in folded), bool, len(folded))
            relation[told[label]] = 2
            relation[labels == label] = 1
        element, parent = a["element_id"] or "", a["parent_element_id"] or ""
        if element:
            relation[page["parent_element_id"] == element] = 0
        if parent:
            relation[(page["element_id"] == parent) | (page["parent_element_id"] == parent)] = 0
        distance = np.full(len(folded), np.inf)
        if a["y0"] is not None and a["y1"] is not None:
            gap = np.maximum(np.maximum(a["y0"] - page["y1"], page["y0"] - a["y1"]), 0.0)
            distance = np.where(np.isnan(gap), np.inf, gap)
        at = np.flatnonzero(free & ~((relation == 3) & np.isinf(distance)))
        at = at[np.lexsort((rank[at], distance[at], relation[at]))][:most]
        free[at] = False
        out += [(a["chunk_id"], page["chunk_id"][i], int(relation[i]), float(distance[i])) for i in at.tolist()]
    return out


def context_expansion(chunks: DataFrame, selected: DataFrame, most: int = 2) -> DataFrame:
    """(request, anchor_id, chunk_id, relation, distance, place): chunks to add around the visuals of each request.

    ``chunks``: unique chunk_id, document_id, document_version, page, kind, text, element_id, parent_element_id, object_label,
    y0, y1 (null without a box); ``selected``: request, chunk_id, place.  Anchors are a request's selected tables, figures,
    charts and diagrams, or its captions if it has none; each gets at most ``most`` texts, tables or captions of its page that
    are neither selected nor given to an anchor before it.  Pages are independent, so each is settled by itself, with one
    row of distances at a time.
    """
    page = ["document_id", "document_version", "page"]
    about = ["chunk_id", "element_id", "parent_element_id", "object_label", "y0", "y1"]
    base = selected.groupBy("request", "chunk_id").agg(F.min("place").cast("long").alias("place"))
    rows = written(base.join(chunks.select(*page, *about, "kind"), "chunk_id"), "selected")  # without texts; read four times
    visual = F.col("kind").isin(*VISUAL)
    seen = rows.filter(visual).select("request").distinct()
    anchors = rows.filter(visual).unionByName(rows.filter("kind = 'caption'").join(seen, "request", "left_anti")).select("request", *page, *about, "place", F.lit(None).cast("string").alias("text"), F.lit(True).alias("anchor"))
    key = F.struct(*page)
    pages = anchors.select("request", key.alias("_page")).distinct()
    # what is selected comes to its page and is left out there, so texts need not meet it first
    others = chunks.filter(F.col("kind").isin(*CONTEXT)).withColumn("_page", key).join(pages, "_page").select("request", *page, *about, F.lit(None).cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("anchor"))
    chosen = rows.filter(F.col("kind").isin(*CONTEXT)).withColumn("_page", key).join(pages, ["request", "_page"], "left_semi")
    chosen = chosen.select("request", *page, *about, "place", F.lit(None).cast("string").alias("text"), F.lit(False).alias("anchor"))
    both = anchors.unionByName(chosen).unionByName(others)
    request = both.schema["request"].dataType
    whole = ["request", *page]
    both = both.repartition(*whole).sortWithinPartitions(*whole)

    def settle(group: list[dict]) -> list[tuple]:
        own = sorted((r for r in group if r["anchor"]), key=lambda r: (r["place"], r["chunk_id"]))
        taken = {r["chunk_id"] for r in group if r["text"] is None}
        rest = [r for r in group if r["text"] is not None and r["chunk_id"] not in taken]
        if not own or not rest:
            return []
        near = {c: np.array([r[c] or "" for r in rest], object) for c in ("chunk_id", "text", "element_id", "parent_element_id", "object_label")}
        near |= {c: np.array([np.nan if r[c] is None else r[c] for r in rest], float) for c in ("y0", "y1")}
        places: dict[str, int] = {}
        out = []
        for anchor, chunk, relation, distance in neighbours(own, near, most):
            places[anchor] = places.get(anchor, 0) + 1
            out.append((own[0]["request"], anchor, chunk, relation, None if np.isinf(distance) else distance, places[anchor]))
        return out

    def run(batches):
        at, group = None, []
        names = ["request", "anchor_id", "chunk_id", "relation", "distance", "place"]

        def table(found, kind):
            kinds = (kind, pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:  # pages come in order; one that goes on in the next batch waits for it
            kind, found = batch.schema.field("request").type, []
            for r in batch.to_pylist():
                if (own := tuple(r[c] for c in whole)) != at:
                    found += settle(group)
                    at, group = own, []
                group.append(r)
            yield table(found, kind)
        if group:
            yield table(settle(group), kind)

    return both.mapInArrow(run, f"request {request.simpleString()}, anchor_id string, chunk_id string, relation int, distance double, place int")
