"""Nested JSON records: a canonical form to fingerprint, and the records of a shape found at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.tables import written


def canonical_json(x: Column) -> Column:
    """JSON with sorted keys and no blanks, nulls kept, arrays in order; null for what is not JSON."""
    return F.to_json(F.try_parse_json(x))


def fingerprint(x: Column) -> Column:
    """SHA-256 of the canonical form: the order of keys does not count, a null does."""
    return F.sha2(canonical_json(x), 256)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def records_in(df: DataFrame, id_col: str, json: Column, required: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, place, record): the objects, at any depth, whose ``required`` fields have the given kinds.

    ``required`` maps fields to the beginning of a type (STRING, ARRAY, BIGINT ...).  ``path`` has the keys and list places that
    lead to the object, ``place`` their numbers in order, so that sorting by it walks depth first, in the order of the
    text.  Fields in ``skip`` are not entered.  What is not JSON, or null, has no records.  Each level of depth is a table.
    """
    container = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    level = df.select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), json.alias("raw"))
    level = level.withColumn("kind", _kind(F.try_parse_json("raw"))).filter(container)
    found = []
    while True:
        level = written(level, "tree-level")
        objects = level.filter(F.col("kind").startswith("OBJECT")).withColumns({"s": F.from_json("raw", "map<string,string>"), "v": F.from_json("raw", "map<string,variant>")})
        shaped = reduce(lambda a, b: a & b, [F.coalesce(_kind(F.try_element_at("v", F.lit(f))).startswith(k), F.lit(False)) for f, k in required.items()], F.lit(True))
        found.append(objects.filter(shaped).select("id", "path", "place", F.col("raw").alias("record")))
        if level.isEmpty():
            break
        inner = objects.select("id", "path", "place", "v", F.posexplode("s").alias("i", "key", "raw")).filter(~F.col("key").isin(*skip)).withColumn("kind", _kind(F.try_element_at("v", F.col("key"))))
        lists = level.filter(F.col("kind").startswith("ARRAY")).withColumn("v", F.from_json("raw", "array<variant>"))
        items = lists.select("id", "path", "place", "v", F.posexplode(F.from_json("raw", "array<string>")).alias("i", "raw")).withColumns({"key": F.col("i").cast("string"), "kind": _kind(F.get("v", F.col("i")))})
        names = ["id", "path", "place", "i", "key", "raw", "kind"]
        level = inner.select(*names).unionByName(items.select(*names)).filter(container)
        level = level.select("id", F.concat("path", F.array("key")).alias("path"), F.concat("place", F.array("i")).alias("place"), "raw", "kind")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)
