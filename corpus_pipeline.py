"""A corpus pipeline: quality rules, exact dedup, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of their docs, with the docs' own values, whatever the columns are
called.  In every stage a null text counts as empty and an empty table gives an empty result; texts are read whole, however
long; what becomes of repeated rows, ties and null ids is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe_automaton, common, exact_dedup, jaccard_join, quality_rules, source_mix

ORACLE_SQL = None  # tokens are not expressible in SQL; the tests hold the rows against a brute-force version


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` columns, which a stage reads, and the others in a struct, where no name clashes with the stage's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own] or [F.lit(0).alias("_none")]
    return docs.select(*own, F.struct(*rest).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in own else F.col(f"_rest.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; empty texts are rejected, repeated rows are judged alike."""
    return quality_rules.quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, one of them where it repeats; a null id is less than any other."""
    return _unpacked(exact_dedup.exact_dedup(_packed(docs, "doc_id", "text")).filter("kept"), docs, "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row: with the least doc_id, a null one last.  Texts without words all stay.

    A row's key is a hash of its id and text; rows that share it have equal texts, so they are one group's.
    """
    rows = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", common.text_or_empty("text")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    groups = jaccard_join.similar_groups(rows.select("_key", F.col("_row.text").alias("text")), id_col="_key")
    groups = groups.groupBy("_key", "component_id").agg(F.sum((F.col("n_shingles") > 0).cast("long")).alias("times"))
    groups = common.written(groups, "near-groups")
    ids = rows.select("_key", F.col("_row.doc_id").alias("id")).distinct()
    best = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key", "times")).alias("best"))
    stay = common.written(best.select(F.col("best._key").alias("_key"), F.col("best.times").alias("times")), "near-stay")
    # most rows stay, as the only ones of their key; a filter of the other keys passes them without a shuffle of their texts
    gone = groups.join(stay, "_key", "left_anti").select("_key").unionByName(stay.filter("times > 1").select("_key"))
    doubtful = jaccard_join.passes(jaccard_join.filter_bits(gone), F.col("_key"))
    rows = rows.withColumn("_doubtful", doubtful)
    sure, rows = rows.filter("not _doubtful").select("_row.*"), rows.filter("_doubtful").drop("_doubtful")
    once = rows.join(stay.filter("times <= 1"), "_key", "left_semi")
    again = rows.join(stay.filter("times > 1"), "_key", "left_semi").withColumns({"_id": F.col("_row.doc_id"), "_text": F.col("_row.text")})
    return sure.unionByName(once.select("_row.*")).unionByName(again.dropDuplicates(["_key", "_id", "_text"]).select("_row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, never an empty one; rows that repeat an id share its random number."""
    own = ("doc_id", "text", "source")
    # words are counted once; the mix reads the counts several times
    sized = _packed(docs, *own).withColumn("_size", F.size(common.words_of("text")).cast("long"))
    taken = source_mix.mix(common.written(sized, "mix-documents"), size=F.col("_size")).filter("taken > 0")
    copies = F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))
    return _unpacked(taken.withColumn("_copy", F.explode(copies)), docs, *own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the decoded text's digest, one row for each row."""
    rows = bpe_automaton.encode(docs, bpe_automaton.tokenizer_path())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("source_mix", mixture), ("bpe_tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
