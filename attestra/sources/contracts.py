"""Markdown documents with agreed sections and tables, read into cells or error codes, many documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FENCES = "B[^B]*(?:B|$)|T[^T]*(?:T|$)|[^BT]+"  # stretches of lines: inside a fence of either kind, or outside


def lines_of(x: Column) -> Column:
    """The lines of a text; what ends a line ends no empty one after it."""
    x = F.coalesce(x, F.lit(""))
    parts = F.split(x, LINE_END, -1)
    return F.when(x == "", F.array().cast("array<string>")).when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fenced(lines: Column) -> Column:
    """Whether each line is in a code fence, its marks included.  A fence ends at the next mark of its own kind.

    The marks' kinds are written as a string of letters, which one regular expression cuts into stretches."""
    kind = F.transform(lines, lambda s: F.when(s.rlike(r"^\s*`{3,}"), "B").when(s.rlike(r"^\s*~{3,}"), "T").otherwise("."))
    stretches = F.regexp_extract_all(F.array_join(kind, ""), F.lit(FENCES), F.lit(0))
    return F.flatten(F.transform(stretches, lambda s: F.array_repeat(~s.startswith("."), F.length(s))))


def section_lines(df: DataFrame, id_col: str, text: Column, level: int) -> DataFrame:
    """(id, nth, section, start, line_no, line): the lines below each heading of ``level``; its own line has line_no = start.

    Headings in fences are none.  Lines are numbered from 1; those before the first heading are left out."""
    rows = df.select(F.col(id_col).alias("id"), lines_of(text).alias("lines")).select("id", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), fenced(F.col("lines")).alias("inside"))).alias("i", "l"))
    head = F.when(~F.col("l.inside"), F.regexp_extract("l.line", rf"^#{{{level}}}\s+(.+?)\s*#*\s*$", 1))
    rows = rows.select("id", (F.col("i") + 1).alias("line_no"), F.col("l.line").alias("line"), F.when(head != "", head).alias("head"))
    # a document's lines come from one row, so a window has no more than one text
    nth = F.count("head").over(Window.partitionBy("id").orderBy("line_no"))
    rows = rows.withColumn("nth", nth).filter("nth > 0")
    own = Window.partitionBy("id", "nth")
    return rows.select("id", "nth", F.max("head").over(own).alias("section"), F.min("line_no").over(own).alias("start"), "line_no", "line")


def cells_of(line: Column) -> Column:
    """The cells of a table row: cut at pipes that are not escaped, trimmed, pipes unescaped."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|", -1), lambda c: F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("\\|"), F.lit("|")))


def contract_tables(df: DataFrame, id_col: str, text: Column, tables: dict[str, list[str]], level: int = 2) -> DataFrame:
    """(id, section, row, column, cell, error, line): cells of each agreed table, numbered from row 1, and errors.

    ``tables``: the header that each section's table has to have.  Errors have no row, column or cell: missing_section;
    duplicate_section at the second heading; columns at the first row with another number of cells; header at the
    section's heading, where the first row is another one or there is none.  A table with an error has no cells; rules
    (rows of dashes) are passed over.  Ids are unique; a null text has no sections.
    """
    lines = section_lines(df, id_col, text, level)
    wanted = F.create_map(*[x for name, head in tables.items() for x in (F.lit(name), F.array(*map(F.lit, head)))])
    lines = lines.filter(F.col("section").isin(*tables)).withColumn("wanted", F.try_element_at(wanted, F.col("section")))
    heads = lines.filter("line_no = start").groupBy("id", "section").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    twice = heads.filter(F.size("starts") > 1).select("id", "section", F.lit("duplicate_section").alias("error"), F.get("starts", F.lit(1)).alias("line"))
    names = df.select(F.col(id_col).alias("id")).select("id", F.explode(F.array(*map(F.lit, tables))).alias("section"))
    missing = names.join(heads, ["id", "section"], "left_anti").select("id", "section", F.lit("missing_section").alias("error"), F.lit(None).cast("int").alias("line"))
    rows = lines.filter((F.col("line_no") > F.col("start")) & F.col("line").rlike(r"^\s*\|")).withColumn("cells", cells_of(F.col("line")))
    rows = rows.filter(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    place = Window.partitionBy("id", "section", "nth").orderBy("line_no")
    rows = rows.withColumns({"row": F.row_number().over(place) - 1, "odd": F.size("cells") != F.size("wanted")})
    tests = lines.filter("line_no = start").select("id", "section", "nth", "start").join(
        rows.groupBy("id", "section", "nth").agg(F.min(F.when(F.col("odd"), F.col("line_no"))).alias("odd"), F.bool_or((F.col("row") == 0) & (F.col("cells") == F.col("wanted"))).alias("named")), ["id", "section", "nth"], "left")
    error = F.when(F.col("odd").isNotNull(), "columns").when(~F.coalesce("named", F.lit(False)), "header")
    wrong = tests.withColumn("error", error).filter("error IS NOT NULL").select("id", "section", "nth", "error", F.coalesce("odd", "start").alias("line"))
    good = rows.filter("row > 0").join(wrong.select("id", "section", "nth"), ["id", "section", "nth"], "left_anti").join(twice.select("id", "section"), ["id", "section"], "left_anti")
    cells = good.select("id", "section", "row", F.posexplode(F.arrays_zip(F.col("wanted").alias("column"), F.col("cells").alias("cell"))).alias("i", "c"), F.lit(None).cast("string").alias("error"), F.col("line_no").alias("line"))
    errors = twice.unionByName(missing).unionByName(wrong.join(twice.select("id", "section"), ["id", "section"], "left_anti").drop("nth"))
    errors = errors.select("id", "section", F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("cell"), "error", "line")
    return cells.select("id", "section", "row", "c.column", "c.cell", "error", "line").unionByName(errors).withColumnRenamed("id", id_col)
