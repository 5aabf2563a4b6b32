"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

A source with target T and size S gives every document floor(T / S) certain copies.  What is left of the target is a
sample without replacement: document i has an inclusion weight p_i, a uniform number u_i made from its id, and the rank
u_i / (1 - u_i) / (p_i / (1 - p_i)), random odds over inclusion odds; documents are taken by ascending rank until the
left-over words are reached, and the one of the source's other documents whose size fits the rest best closes the sample.
Inclusion weights are in proportion to the logarithm of the size; where one would exceed 1 the document is certain, rank
0, and the others' weights are solved again for what is left, so that they always add up to the words to be sampled.

No source is ever sorted as a whole: ranks fall into ``BUCKETS`` buckets of a source, the buckets' sums are added up,
and only the documents of the bucket where the target falls are ordered among themselves.  The closing document is found
from the least rank of each size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``: shares by weight, none above ``limit`` times its size.

    Weights repeat along the sources in code-point order, a null source last.  The excess of capped sources goes to
    the others by weight: the fixed point is min(limit * size, level * weight), whose level is found by ordering the
    sources by size over weight.  The rows are sources, so one window over all of them is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick.cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(limit))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rows = rows.withColumn("_want", F.sum("source_size").over(all_rows) * F.lit(share))
    rows = rows.withColumn("_left", F.col("_want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_free", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / F.col("_free"))
    fits = F.col("_level") * F.col("weight") <= F.col("cap")  # the first source that its level does not fill sets the level
    rows = rows.withColumn("_set", F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), "source", "_level"))).over(all_rows).getField("_level"))
    target = F.coalesce(F.least(F.col("cap"), F.col("_set") * F.col("weight")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def uniform(*keys: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the keys only, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 20, size: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` with size, source_size, target and taken (copies times size) added.

    Null or empty texts have size 0 and are taken 0 times; sources without words have target 0.  Rows that repeat an
    id share its random number, and ties are ordered by size and id.  Columns of ``df`` named like an added one are
    replaced; the others come back as they are.  Of a text, however long, only the number of words counts.
    """
    size = F.size(common.words_of(text_col)).cast("long") if size is None else size
    names = [c for c in df.columns if c not in ("size", "source_size", "target", "taken")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), size.alias("size"), F.col(source_col).alias("source"))
    rows = rows.withColumn("u", uniform(F.col(f"row.`{id_col}`"), F.col("source"), seed=seed))
    rows = rows.withColumn("p", F.log(F.col("size") + 2.0))
    # one row for each size of a source: as many as there are different sizes, not documents
    hist = common.written(rows.groupBy("source", "size").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("p")).alias("sp")), "mix-sizes-of-sources")
    plan = source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.floor(ratio + 1e-12).alias("whole"),
        F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0)).alias("part"),
    )
    plan = common.written(_solved(plan, hist), "mix-plan")
    rows = _with_plan(rows, plan)
    odds = F.greatest(F.col("level") * F.col("p"), F.lit(1e-12))
    rank = F.when(odds >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) / (odds / (1 - odds)))
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    return _sampled(rows, names, id_col)


def _solved(plan: DataFrame, hist: DataFrame) -> DataFrame:
    """``plan`` with ``level``: a document of weight p is included with probability level * p, or surely where that is 1
    or more, and the included words add up to ``part`` of the source's.

    Weights rise with size.  From the largest size down, a size's level supposes that all larger ones are certain; the
    first size that is not certain at its own level has the right one.
    """
    order = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("sp").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sizes = hist.filter("size > 0").join(plan.select("_source", "source_size", "part"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sizes = sizes.withColumn("level", (F.col("part") * F.col("source_size") - larger) / rest)
    open_ = sizes.filter(F.col("level") * F.col("sp") < F.col("words"))
    levels = open_.groupBy("source").agg(F.max_by("level", "size").alias("level"))
    return plan.join(levels, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source").fillna(0.0, ["level"])


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the sources' plan; it is broadcast while its rows are few by count, and shuffled with a skew join beyond."""
    few = plan.limit(20_001).count() <= 20_000
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sampled(rows: DataFrame, names: list[str], id_col: str) -> DataFrame:
    left = F.col("part") * F.col("source_size")  # words that the sample has to give
    open_ = rows.filter((F.col("size") > 0) & (F.col("part") > 0))
    sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("part").alias("part"), F.first("source_size").alias("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = sums.filter((F.col("before") <= left) & (F.col("before") + F.col("n") > left))
    edge = common.written(at.select(F.col("source").alias("_source"), F.col("bucket").alias("edge"), "before"), "mix-edges")
    few = edge.limit(20_001).count() <= 20_000
    rows = rows.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    live = (F.col("size") > 0) & (F.col("part") > 0)
    sure = live & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    rows = rows.withColumn("state", F.when(sure, 1).when(live & (F.col("bucket") == F.col("edge")), 2).otherwise(0))
    # the documents of the edge buckets: one bucket in BUCKETS of a source
    key = [F.col("rank"), F.col("size"), F.col(f"row.`{id_col}`"), F.col("u")]
    upto = Window.partitionBy("source").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.filter("state = 2").withColumn("upto", F.col("before") + F.sum("size").over(upto))
    inside = inside.withColumn("more", (F.col("upto") <= left).cast("int"))
    reach = F.coalesce(F.max(F.when(F.col("more") == 1, F.col("upto"))), F.max("before"))
    gaps = inside.groupBy("source").agg((F.max(left) - reach).alias("gap"))
    # the closing document: of the source's untaken ones that whose size comes nearest to the gap, if that is nearer than none
    rows = rows.filter("state != 2").withColumn("more", F.col("state")).unionByName(inside.drop("upto"))
    spare = live & (F.col("more") == 0)
    sizes = rows.filter(spare).groupBy("source", "size").agg(F.min("rank").alias("rank"))
    gaps = common.written(gaps.select(F.col("source").alias("_source"), "gap"), "mix-gaps")
    few = gaps.limit(20_001).count() <= 20_000
    sizes = sizes.join(F.broadcast(gaps) if few else gaps, F.col("source").eqNullSafe(F.col("_source")))
    miss = F.abs(F.col("size") - F.col("gap"))
    best = sizes.filter(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "size")).alias("best"))
    best = common.written(best.select(F.col("source").alias("_source"), F.col("best.rank").alias("_rank"), F.col("best.size").alias("_size")), "mix-closing")
    rows = rows.join(F.broadcast(best) if few else best, F.col("source").eqNullSafe(F.col("_source")), "left")
    tied = F.coalesce(spare & (F.col("rank") == F.col("_rank")) & (F.col("size") == F.col("_size")), F.lit(False))
    # more than one row only where rows repeat an id
    first = F.row_number().over(Window.partitionBy("source").orderBy(*key))
    closing = rows.filter(tied).withColumn("more", (first == 1).cast("int"))
    taken = ((F.col("whole") + F.col("more")) * F.col("size")).cast("long")
    out = lambda part: part.select(F.col("row.*"), "size", "source_size", "target", taken.alias("taken"))
    return out(rows.filter(~tied)).unionByName(out(closing))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", F.size(common.words_of("text")).cast("long").alias("n"))
    rows = common.written(docs, "mix-sizes")
    return mix(rows, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")
