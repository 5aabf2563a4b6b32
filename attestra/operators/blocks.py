"""Chunks of layout elements: merged text blocks, row groups of tables, windows cut at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import ordered

TOKEN = re.compile(r"\w+|[^\w\s]")  # fixed value: a word, or a single other character


def coalesce_blocks(elements: DataFrame, doc: str, at: str, max_tokens: int, block: int = ordered.BLOCK) -> DataFrame:
    """Adjacent text elements merged while page, section and printed page stay and ``max_tokens`` are not exceeded.

    ``elements``: ``doc``, ``at`` (0, 1, 2 ... in reading order), kind, text, page, section, printed_page, element_id and bbox (a
    struct x0, y0, x1, y1 or null).  One row a group: doc, first (position of its first element), kind, page, section, printed_page,
    text, tokens, elements, element_id, parent_element_id, bbox.  Elements of other kinds and texts that stay single keep
    their own text, id and box; a merged text is normalised, has the union of the boxes if all have one, an id of its own
    and its first element as parent.  A null text is empty; rows of a null document are one document's.
    """
    text = F.coalesce("text", F.lit(""))
    part = F.struct((F.col("kind") == "text").alias("t"), "page", "section", "printed_page")
    rows = elements.withColumns({"text": text, "_part": part, "_of": F.floor(F.col(at) / block), "tokens": T.token_count(T.normalize_text(text))})
    border = rows.filter(F.col(at) % block == block - 1).select(F.col(doc).alias("_doc"), (F.col("_of") + 1).alias("_next"), F.col("_part").alias("_border"))
    rows = rows.join(border, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_next")), "left")
    before = F.lag("_part").over(Window.partitionBy(doc, "_of").orderBy(at))
    before = F.when(F.col(at) % block == 0, F.col("_border")).otherwise(before)
    rows = rows.withColumn("_new", ~before.eqNullSafe(F.col("_part"))).drop("_doc", "_next", "_border", "_of", "_part")
    grouped = ordered.budget_groups(rows, doc, at, F.col("tokens"), F.lit(max_tokens), F.col("_new"), F.coalesce(F.col("kind") != "text", F.lit(True)), max_tokens, block)
    own = F.min_by(F.struct("kind", "page", "section", "printed_page", "element_id", "parent_element_id", "bbox"), F.col(at))
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    out = grouped.groupBy(doc, "first").agg(
        own.alias("o"), F.count(F.lit(1)).alias("elements"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct(at, "text"))).alias("parts"),
        F.when(F.count("bbox") == F.count(F.lit(1)), box).alias("box"),
    )
    many = F.col("elements") > 1
    joined = F.when(many, T.normalize_text(F.array_join(F.col("parts.text"), "\n\n"))).otherwise(F.get("parts", F.lit(0))["text"])
    out = out.withColumn("text", joined)
    group_id = T.stable_id(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.coalesce(F.col("o.page").cast("string"), F.lit("")), F.lit("text-group"), F.col("first").cast("string"), F.col("text"), length=12)
    return out.select(
        doc, "first", "o.kind", "o.page", "o.section", "o.printed_page", "text", "tokens", "elements",
        F.when(many, F.concat(F.lit("elem-text-group-"), group_id)).otherwise(F.col("o.element_id")).alias("element_id"),
        F.when(many, F.col("o.element_id")).otherwise(F.col("o.parent_element_id")).alias("parent_element_id"), F.when(many, F.col("box")).otherwise(F.col("o.bbox")).alias("bbox"),
    )


def table_row_groups(rows: DataFrame, table: str, at: str, line: Column, header: Column, max_tokens: int, hard_limit: int, block: int = ordered.BLOCK) -> DataFrame:
    """Rows of tables in groups that fit ``max_tokens`` with their repeated header; (table, first, n_rows, tokens, text).

    ``rows`` has a row for each table row, ``at`` its place, not negative and unique in the table; ``header`` is the table's
    head and separator line.  A row that exceeds ``hard_limit`` with the header is a group by itself.  A table whose header
    takes ``hard_limit`` or more is one group whole.  Null lines are empty rows.
    """
    own = rows.select(table, at, F.coalesce(line, F.lit("")).alias("line"), F.coalesce(header, F.lit("")).alias("header"))
    own = own.withColumns({"tokens": T.token_count(F.col("line")), "head": T.token_count(F.col("header"))})
    whole = F.col("head") >= hard_limit
    fits = own.filter(~whole)
    room = F.greatest(max_tokens - F.col("head"), F.lit(0))
    grouped = ordered.budget_groups(fits, table, at, F.col("tokens"), room, F.lit(False), F.col("tokens") + F.col("head") > hard_limit, max_tokens, block)
    grouped = grouped.unionByName(own.filter(whole).withColumn("first", F.lit(-1).cast("long")))
    lines = F.array_sort(F.collect_list(F.struct(at, "line")))
    out = grouped.groupBy(table, "first").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("tokens") + F.first("head")).alias("tokens"), F.first("header").alias("header"), lines.alias("lines"), F.min(at).alias("least"))
    return out.select(table, F.col("least").alias("first"), "n_rows", "tokens", F.concat("header", F.lit("\n"), F.array_join(F.col("lines.line"), "\n")).alias("text"))


def markdown_rows(df: DataFrame, table: str, text: Column) -> DataFrame:
    """(table, at, line, header) of texts that are Markdown tables; texts without a separator in the second line have no rows."""
    lines = F.split(text, "\r\n|\n|\r")
    rows = df.select(table, lines.alias("_l")).filter((F.size("_l") >= 3) & F.get("_l", F.lit(1)).rlike(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+"))
    rows = rows.withColumn("header", F.concat_ws("\n", F.slice("_l", 1, 2)))
    return rows.select(table, "header", F.posexplode(F.slice("_l", F.lit(3), F.size("_l") - 2)).alias("at", "line")).withColumn("at", (F.col("at") + 1).cast("long"))


def boundary_spans(text: str, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Exact spans of windows of ``max_tokens`` that share ``overlap`` tokens, cut where a paragraph, line, sentence, clause or
    word ends in the second half, if that leaves half of the tokens at least."""
    places = [m.span() for m in TOKEN.finditer(text)]
    if len(places) <= max_tokens:
        return [(0, len(text))]
    begins, ends = [a for a, _ in places], [b for _, b in places]
    spans, start = [], 0
    while start < len(text):
        k = bisect_right(ends, start)  # the first token that is not over before the window
        end = begins[k + max_tokens] if k + max_tokens < len(begins) else len(text)
        if end < len(text):
            half = start + max(1, (end - start) // 2)
            cut = max(text.rfind(mark, half, end) for mark in ("\n", ". ", "; ", " "))
            if cut >= 0:
                cut += 2 if text[cut : cut + 2] in ("\n\n", ". ", "; ") else 1
                if bisect_left(begins, cut) - k >= max_tokens // 2:
                    end = cut
        raw = text[start:end]
        left, right = start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())
        if right > left:
            spans.append((left, right))
        if end >= len(text):
            break
        last = bisect_left(begins, end) - overlap  # so many tokens before the cut are repeated
        again = max(ends[last - 1] if last > 0 else start, start) if overlap else end
        start = again if again > start else end
    return spans


def boundary_chunks(df: DataFrame, id_col: str, text_col: str, max_tokens: int, overlap: int) -> DataFrame:
    """(id, chunk_no, start, end, chunk): the windows of ``boundary_spans``, places in code points; a null text has none."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("windows have to be longer than their overlap")
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time: its windows are a little more than the text
                text = batch.column(1)[i].as_py()
                spans = boundary_spans(text, max_tokens, overlap)
                columns = [pa.array(range(len(spans)), pa.int32()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array([text[a:b] for a, b in spans], pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(spans), batch.column(0).type), *columns], names=["id", "chunk_no", "start", "end", "chunk"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, chunk_no int, start long, end long, chunk string").withColumnRenamed("id", id_col)
