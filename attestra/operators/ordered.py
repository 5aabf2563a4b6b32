"""Groups of ordered rows under a budget: a fold whose next state depends on every row before it, spread over blocks.

A greedy budget has few states: nothing open, or a group open with so much in it.  A block of rows is therefore a function
from the state it is entered with to the state it is left with, one small array, or a single number where some row starts
a group in any case.  Such functions are computed block by block and composed in a tree, so a key with any number of rows
is never in one task; then every block is folded from the state it is really entered with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 10_000  # positions of a key that one task folds at once
FAN = 256  # blocks, or nodes, that are composed at once


def step(state, weight, room, starts, most: int):
    """(next state, whether a group starts here) for one state or an array of them.

    State 0: nothing open; k + 1: a group of weight k.  A group whose weight is above ``room`` is closed at once.
    """
    fresh = starts | (state == 0) | (state - 1 + weight > room)
    total = np.where(fresh, weight, state - 1 + weight)
    return np.where(total > room, 0, np.minimum(total, most) + 1), fresh


def block_function(at: np.ndarray, weight: np.ndarray, room: np.ndarray, starts: np.ndarray, alone: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(state that each entering state leaves with, where the last group starts or -1); of one entry if they are all equal."""
    fixed = np.flatnonzero(starts | alone)
    low = int(fixed[-1]) if len(fixed) else 0
    entering = np.zeros(1, np.int64) if len(fixed) else np.arange(most + 2)
    state, back = np.unique(entering, return_inverse=True)
    last = np.full(len(entering), -1, np.int64)
    for i in range(low, len(at)):
        after, fresh = step(state, weight[i], room[i], starts[i] | alone[i], most)
        last[fresh[back]] = at[i]
        if alone[i]:
            after = np.zeros_like(after)
        state, new = np.unique(after, return_inverse=True)
        back = new[back]
    out = state[back]
    return (out[:1], last[:1]) if (out == out[0]).all() and (last == last[0]).all() else (out, last)


def composed(first: tuple, then: tuple) -> tuple:
    """The function of ``first`` and what follows it."""
    pick = lambda table, at: np.broadcast_to(table[0], at.shape) if len(table) == 1 else table[at]
    out, last = pick(then[0], first[0]), pick(then[1], first[0])
    return np.array(out), np.where(last >= 0, last, first[1])


def _functions(key: str, at: str, most: int):
    def run(table: pa.Table) -> pa.Table:
        own = table.select([at, "_weight", "_room", "_starts", "_alone"]).to_pandas().sort_values(at)
        out, last = block_function(*(own[c].to_numpy() for c in (at, "_weight", "_room", "_starts", "_alone")), most)
        return pa.table({key: table.column(key).slice(0, 1), "_block": table.column("_block").slice(0, 1), "out": [out.tolist()], "last": [last.tolist()]})

    return run


def _entries(functions: DataFrame, key: str, key_type: str) -> DataFrame:
    """(key, block, state, first): what each block is entered with, by composition in a tree of FAN blocks a node."""
    schema = f"{key} {key_type}, _block long, state long, first long"
    tables = lambda rows: [(np.array(o), np.array(x)) for o, x in zip(rows["out"], rows["last"], strict=True)]

    def walked(rows: pd.DataFrame, state: int = 0, first: int = -1) -> pd.DataFrame:
        rows = rows.sort_values("_block")
        found = []
        for out, last in tables(rows):
            found.append((state, first))
            k = 0 if len(out) == 1 else state
            state, first = int(out[k]), int(last[k]) if last[k] >= 0 else first
        return pd.DataFrame({key: rows[key], "_block": rows["_block"], "state": [s for s, _ in found], "first": [x for _, x in found]})

    if functions.filter(F.col("_block") >= FAN).limit(1).count() == 0:
        return functions.groupBy(key).applyInPandas(lambda rows: walked(rows), schema)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for table in tables(rows.sort_values("_block")):
            whole = table if whole is None else composed(whole, table)
        return pd.DataFrame({key: rows[key].iloc[:1], "_block": rows["_node"].iloc[:1], "out": [whole[0].tolist()], "last": [whole[1].tolist()]})

    nodes = functions.withColumn("_node", F.floor(F.col("_block") / FAN))
    above = nodes.groupBy(key, "_node").applyInPandas(joined, f"{key} {key_type}, _block long, out array<long>, last array<long>")
    entered = _entries(above, key, key_type).withColumnRenamed("_block", "_node")

    def below(rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        return walked(rows, int(head["state"].iloc[0]), int(head["first"].iloc[0]))

    return nodes.groupBy(key, "_node").cogroup(entered.groupBy(key, "_node")).applyInPandas(below, schema)


def _folded(key: str, at: str, most: int, names: list[str]):
    def run(batches):
        before, state, first = None, 0, -1
        for batch in batches:
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_pylist()
            firsts = []
            for k, block, place, weight, room, starts, alone, lead, own in zip(col(key), col("_block"), col(at), col("_weight"), col("_room"), col("_starts"), col("_alone"), col("_lead_state"), col("_lead_first"), strict=True):
                if (k, block) != before:
                    before, state, first = (k, block), 0, -1
                if lead is not None:
                    state, first = lead, own
                    firsts.append(None)
                    continue
                fresh = starts or alone or state == 0 or state - 1 + weight > room
                total = weight if fresh else state - 1 + weight
                state = 0 if alone or total > room else min(total, most) + 1
                first = place if fresh else first
                firsts.append(first)
            out = batch.select(names).append_column("first", pa.array(firsts, pa.int64()))
            yield out.filter(out.column(out.num_columns - 1).is_valid())

    return run


def budget_groups(df: DataFrame, key: str, at: str, weight, room, starts, alone, most: int, block: int = BLOCK) -> DataFrame:
    """``df`` with ``first``: the position of the first row of each row's group.

    Rows of a ``key``, in order of ``at`` (a long, not negative, unique in the key), join the open group while its weight stays
    within ``room``; a row where ``starts`` holds opens one, a row where ``alone`` holds is a group by itself.  ``room`` is at most
    ``most``, and the first row of a group may be heavier.  Null weights count as 0, null conditions as false; rows with a
    null key form one more key.  An empty table gives an empty result; columns named ``first`` or ``_block`` are not allowed.
    """
    if set(df.columns) & {"first", "_block", "_weight", "_room", "_starts", "_alone"}:
        raise ValueError("a column's name clashes with one that the fold adds")
    rows = df.withColumns({"_block": F.floor(F.col(at) / block), "_weight": F.coalesce(weight.cast("long"), F.lit(0)), "_room": room.cast("long"), "_starts": F.coalesce(starts, F.lit(False)), "_alone": F.coalesce(alone, F.lit(False))})
    led = rows.withColumns({"_lead_state": F.lit(None).cast("long"), "_lead_first": F.lit(None).cast("long")})
    further = rows.filter(F.col("_block") > 0).select(key).distinct()
    if further.limit(1).count():
        key_type = df.schema[key].dataType.simpleString()
        tall = rows.join(further, rows[key].eqNullSafe(further[key]), "left_semi").select(key, at, "_block", "_weight", "_room", "_starts", "_alone")
        functions = tall.groupBy(key, "_block").applyInArrow(_functions(key, at, most), f"{key} {key_type}, _block long, out array<long>, last array<long>")
        heads = _entries(functions, key, key_type).select(key, "_block", F.col("state").alias("_lead_state"), F.col("first").alias("_lead_first"))
        led = led.unionByName(heads, allowMissingColumns=True)
    led = led.repartition(key, "_block").sortWithinPartitions(key, "_block", F.col("_lead_state").isNull(), at)
    return led.mapInArrow(_folded(key, at, most, df.columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", first long")
