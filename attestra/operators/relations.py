"""Joins, merges, budgets and constraint queries over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_TASK = 1 << 20
MOST_GROUPS, MOST_TASKS = 10_000, 4096  # groups whose sizes are broadcast; tasks that pairs are dealt to


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks whose number grows with its rows, so that what a task holds does not."""
    return df.repartition(max(1, -(-df.count() // ROWS_A_TASK)), *keys)


def unresolved(refs: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """References whose key is not registered."""
    return refs.join(registry.select(key).distinct(), key, "left_anti")


def used(registry: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    return registry.join(refs.select(key).distinct(), key, "left_semi")


def completeness_grid(rows: DataFrame, columns: DataFrame, provided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row x column cell with ``n``, how often it is provided, and its status; both axes are short lists of names."""
    counts = provided.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = rows.crossJoin(columns).join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "once").otherwise("repeated"))


def nearest(anchors: DataFrame, targets: DataFrame, key: str, at: str, target_id: str, within: float) -> DataFrame:
    """For each anchor the nearest target of its key by |difference|, ties by target id, none beyond ``within``."""
    t = targets.select(F.col(key), F.col(at).alias("_at"), F.col(target_id).alias("target"))
    joined = anchors.join(t, key).withColumn("distance", F.abs(F.col(at) - F.col("_at"))).filter(F.col("distance") <= within)
    order = Window.partitionBy(*anchors.columns).orderBy("distance", "target")
    return joined.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*anchors.columns, "target", "distance")


def pair_coverage(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """All unordered pairs of a short list with how often ``pairs`` (a, b) has them."""
    want = members.select(F.col(key).alias("a")).join(members.select(F.col(key).alias("b")), F.col("a") < F.col("b"))
    have = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return want.join(have, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def pairs_within(df: DataFrame, group: str, order: str, block: int = 2048) -> DataFrame:
    """Every two rows of a group as structs ``a`` and ``b``, a's ``order`` the lower; rows whose group or order is null have no pair.

    Blocks of a group meet block by block, each two of them in a group of their own, so that no group, however large, is one
    task's."""
    rows = df.filter(F.col(group).isNotNull() & F.col(order).isNotNull())
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("_blocks"))
    dealt = rows.select(F.col(group).alias("_group"), F.struct(*df.columns).alias("_row"), F.col(order).alias("_order"))
    dealt = dealt.join(F.broadcast(sizes.withColumnRenamed(group, "_group")), "_group") if sizes.count() <= MOST_GROUPS else dealt.join(sizes.withColumnRenamed(group, "_group"), "_group")
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("_order"), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    met = dealt.withColumn("_other", every).select("_group", "_row", "_order", "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))
    # a number of tasks that grows with the pairs: blocks that meet are few rows, so their size says little
    parts = max(1, min(MOST_TASKS, int(sizes.agg(F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2)).first()[0] or 1)))
    met = met.repartition(parts, "_group", "_x", "_y")
    left, right = met.alias("l"), met.alias("r")
    same = (F.col("l._group") == F.col("r._group")) & (F.col("l._x") == F.col("r._x")) & (F.col("l._y") == F.col("r._y"))
    apart = (F.col("l._x") == F.col("l._y")) | (F.col("l._own") != F.col("r._own"))
    return left.join(right.hint("shuffle_hash"), same & apart & (F.col("l._order") < F.col("r._order"))).select(F.col("l._row").alias("a"), F.col("r._row").alias("b"))


def last_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def merge_conflicts(a: DataFrame, b: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys that the two tables give different values."""
    both = a.select(key, value.alias("_v")).unionByName(b.select(key, value.alias("_v")))
    return both.groupBy(key).agg(F.count_distinct("_v").alias("values")).filter("values > 1")


def prefer_current(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer merge in which a current row replaces the previous one as a whole."""
    p = previous.select(F.col(key), F.struct(*fields).alias("_p"))
    c = current.select(F.col(key), F.struct(*fields).alias("_c"))
    joined = p.join(c, key, "full_outer").select(key, F.coalesce("_c", "_p").alias("_r"), F.when(F.col("_c").isNull(), "previous").otherwise("current").alias("origin"))
    return joined.select(key, "_r.*", "origin")


def newest_round(df: DataFrame, key: str, round_: str) -> DataFrame:
    """Rows of each key's highest round."""
    return df.withColumn("_m", F.max(round_).over(Window.partitionBy(key))).filter(F.col(round_) == F.col("_m")).drop("_m")


def interleave(df: DataFrame, facet: str, order: Sequence[Column], per_facet: int | None = None) -> DataFrame:
    """Round-robin order over facets: ``round`` inside a facet; sort by (round, facet) to read it."""
    rows = df.withColumn("round", F.row_number().over(Window.partitionBy(facet).orderBy(*order)))
    return rows if per_facet is None else rows.filter(F.col("round") <= per_facet)


def running_budget(df: DataFrame, key: str, order: Sequence[Column], cost: Column, budget: int) -> DataFrame:
    """``allowed``: what is left of the key's budget for the row, at most its cost."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("allowed", F.greatest(F.least(cost, F.lit(budget) - before), F.lit(0)))


def pack(df: DataFrame, group: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Skip-and-continue packing: in order, a row is taken if it still fits.  Groups are bounded by what one owner cites."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size"))))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("kept"))

    def step(state, x):
        fits = state["total"] + x["_size"] <= budget
        return F.struct(F.when(fits, state["total"] + x["_size"]).otherwise(state["total"]).alias("total"), F.concat(state["kept"], F.array(fits)).alias("kept"))

    rows = df.groupBy(group).agg(items.alias("x")).withColumn("k", F.aggregate("x", zero, step)["kept"])
    return rows.select(group, F.explode(F.arrays_zip("x", "k")).alias("z")).select(group, *[F.col(f"z.x.{c}").alias(c) for c in order], F.col("z.x._size").alias(size), F.col("z.k").alias("kept"))


def carry_forward(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_failing(codes: Sequence[tuple[str, Column]]) -> Column:
    """An ordered gate: the first code whose condition holds, null if none does."""
    out = F.lit(None).cast("string")
    for code, condition in reversed(codes):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out
