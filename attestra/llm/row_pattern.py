"""Row pattern matching: ``A (D|U)*? P`` and ``A (D|U)* P`` over the ordered rows of each key.

Within a run of rows that a match could span, one scan from the last row to the first answers every start.  Goals that
could end a match are kept on a monotonic stack: reluctant, the next goal not less than A is found on the stack of next
greater goals; greedy, the last one on the records of the suffix maximum; both by binary search.  A row that is no step
empties the stack.  The matches that a search from the left would take are then read off by jumping from end to start.

Rows are dealt by key and time bucket, so a hot key is in as many tasks as it has buckets.  A match may only cross the
border of two buckets if rows lie within the longest gap of it on both sides and no row there stops every match.  Rows of
such pieces are kept apart, few as a rule.  Where some lead through whole buckets, the kept rows are dealt into longer
buckets and scanned again, as long as no task gets more than PIECE_ROWS of a key so.  What is left is settled between the
buckets: what is the greatest goal that a piece can reach to its right (doubling joins of one short row a piece), then,
piece by piece from the left, which start is waiting for a goal.  No step gathers a key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MINUTE = 60_000_000  # microseconds
PREFIX, SUFFIX, WHOLE = 0, 1, 2  # a piece is open to the left, to the right, to both sides
COARSE = 64  # buckets that make a longer one, and whose matches are numbered together
PIECE_ROWS = 1_000_000  # kept rows of a key and longer bucket at most


def ends(values: list[int], link: list[bool], goal: list[bool], after: int | None = None, greedy: bool = False) -> list[int]:
    """Where a match that starts at each row ends: an index, -1 for none, or len(values) for a goal beyond the last row.

    ``link``: the row is a step from the one before it; ``goal``: it may end a match; ``after``: the greatest goal that
    follows the last row, with steps only before it.
    """
    n = len(values)
    out = [-1] * n
    places: list[int] = []
    kept: list[int] = []  # reluctant: goals negated, nearest last, ascending; greedy: goals, nearest last, ascending
    for i in range(n - 1, -1, -1):
        j = i + 1
        if j < n:
            if not link[j]:
                places.clear()
                kept.clear()
                after = None
            if goal[j]:
                if greedy:
                    if not kept or values[j] > kept[-1]:
                        kept.append(values[j])
                        places.append(j)
                else:
                    while kept and kept[-1] >= -values[j]:
                        kept.pop()
                        places.pop()
                    kept.append(-values[j])
                    places.append(j)
        x = values[i]
        if greedy:
            k = bisect_left(kept, x)
            found = places[k] if k < len(kept) else -1
            if after is not None and after >= x:
                found = n
        else:
            k = bisect_right(kept, -x) - 1
            found = places[k] if k >= 0 else n if after is not None and after >= x else -1
        out[i] = found
    return out


def taken(found: list[int], start: int = 0) -> tuple[list[tuple[int, int]], int | None]:
    """The (first, last) rows that a search from ``start`` takes, and the start whose goal lies beyond, if it meets one."""
    out, i, n = [], start, len(found)
    while i < n:
        if found[i] < 0:
            i += 1
        elif found[i] < n:
            out.append((i, found[i]))
            i = found[i] + 1
        else:
            return out, i
    return out, None


def waited(x: int, values: list[int], link: list[bool], goal: list[bool], after: int | None, greedy: bool) -> int:
    """The row at which a match that waits for a goal of at least ``x`` ends; len(values) if that lies beyond."""
    last, n = -1, len(values)
    for j in range(n):
        if goal[j] and values[j] >= x:
            last = j
            if not greedy:
                return j
        if not link[j]:
            return last
    return n if after is not None and after >= x else last


def _wrapped(total: int) -> int:
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


# ------------------------------------------------------------------ rows of a bucket

_NUMBERS = ("bucket", "t", "id", "v")
_RESULT = {"kind": "int", "key": None, "bucket": "long", "side": "int", "t": "long", "id": "long", "v": "long", "step": "boolean", "goal": "boolean", "t2": "long", "v2": "long", "best": "long",
           "passes": "boolean", "last_id": "long", "n": "long", "total": "long", "labels": "string"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
MATCH, ROW, PIECE, STATE = range(4)


def _schema(key_type: str) -> str:
    return ", ".join(f"{name} {kind or key_type}" for name, kind in _RESULT.items())


def _arrow_schema(batch: pa.RecordBatch) -> pa.Schema:
    key = batch.schema.field("key").type
    return pa.schema([(name, _ARROW[kind] if kind else key) for name, kind in _RESULT.items()])


def _arrays(batch) -> dict:
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    out = {name: pc.fill_null(col(name), 0).to_numpy(zero_copy_only=False).astype(np.int64) for name in _NUMBERS}
    out |= {name: pc.fill_null(col(name), False).to_numpy(zero_copy_only=False) for name in ("step", "goal")}
    # rows that were kept: the bucket they had, and the side of their piece; others count as of one piece
    kept = "side0" in batch.schema.names
    out |= {"bucket0": col("bucket0").to_numpy() if kept else out["bucket"], "side0": col("side0").to_numpy() if kept else np.full(batch.num_rows, WHOLE)}
    return out | {"ok": col("v").is_valid().to_numpy(zero_copy_only=False), "key": col("key")}


def _joined(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {k: pa.concat_arrays([p[k] for p in parts]) if k == "key" else np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _cut(part: dict, low: int, high: int) -> dict:
    return {k: x.slice(low, high - low) if k == "key" else x[low:high] for k, x in part.items()}


def _flagged(part: dict, before: dict | None, gap: int) -> dict:
    """Whether each row is of another bucket than the row before it, a step from it, a goal after it, or none of these."""
    n = len(part["t"])
    last = _joined([before, _cut(part, 0, n - 1)]) if before else _joined([_cut(part, 0, 1), _cut(part, 0, n - 1)])
    same = pc.equal(part["key"], last["key"]).to_numpy(zero_copy_only=False) & (part["bucket"] == last["bucket"])
    if before is None:
        same[0] = False
    within = (part["bucket0"] == last["bucket0"]) & (part["side0"] == last["side0"])
    met = (part["bucket0"] == last["bucket0"] + 1) & (last["side0"] != PREFIX) & (part["side0"] != SUFFIX)
    near = same & (within | met) & (part["t"] - last["t"] <= gap) & part["ok"] & last["ok"]
    link, goal = near & part["step"] & (part["v"] != last["v"]), near & part["goal"]
    return part | {"new": ~same, "link": link, "end": goal, "stop": ~(link | goal), "down": part["v"] < last["v"]}


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    """Columns by name; those that are missing are null."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (x := columns.get(f.name)) is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def _settled(part: dict, stops_bucket: bool, gap: int, width: int, greedy: bool, schema: pa.Schema):
    """Matches of the closed runs of ``part``, whose runs are all whole; rows and a summary of each open one."""
    first = np.flatnonzero(part["stop"])
    last = np.append(first[1:], len(part["t"])) - 1
    closes = np.append(part["new"][first[1:]], stops_bucket)
    t, bucket = part["t"], part["bucket"]
    left = part["new"][first] & (t[first] - bucket[first] * width < gap) & part["ok"][first] & (part["step"][first] | part["goal"][first]) & (part["side0"][first] != SUFFIX)
    right = closes & ((bucket[last] + 1) * width - t[last] <= gap) & part["ok"][last] & (part["side0"][last] != PREFIX)
    held = left | right
    rows = {k: [] for k in ("at", "last", "n", "total", "labels")}
    letters = np.where(part["down"], ord("D"), ord("U")).astype(np.uint8)
    for k in np.flatnonzero(~held & (np.add.reduceat(part["end"], first) > 0)).tolist():
        low, high = int(first[k]), int(last[k]) + 1
        values = part["v"][low:high].tolist()
        for a, b in taken(ends(values, part["link"][low:high].tolist(), part["end"][low:high].tolist(), None, greedy))[0]:
            rows["at"].append(low + a)
            rows["last"].append(low + b)
            rows["n"].append(b - a + 1)
            rows["total"].append(_wrapped(sum(values[a : b + 1])))
            rows["labels"].append("A" + letters[low + a + 1 : low + b].tobytes().decode() + "P")
    if rows["at"]:
        at, to = np.array(rows["at"]), np.array(rows["last"])
        yield _batch(schema, {"kind": np.full(len(at), MATCH), "key": part["key"].take(pa.array(at)), "bucket": bucket[at], "t": t[at], "id": part["id"][at], "last_id": part["id"][to],
                              "n": rows["n"], "total": rows["total"], "labels": rows["labels"]}, len(at))
    if held.any():
        side = np.where(left & right, WHOLE, np.where(right, SUFFIX, PREFIX))
        at = np.flatnonzero(np.repeat(held, last - first + 1))
        yield _batch(schema, {"kind": np.full(len(at), ROW), "key": part["key"].take(pa.array(at)), "bucket": bucket[at], "side": np.repeat(side, last - first + 1)[at],
                              **{k: part[k][at] for k in ("t", "id", "v", "step", "goal")}}, len(at))
        a, b = first[held], last[held]
        best: list[int | None] = []
        passes = []
        for low, high in zip(a.tolist(), b.tolist(), strict=True):
            walls = np.flatnonzero(~part["link"][low + 1 : high + 1])
            reach = low + 1 + int(walls[0]) if len(walls) else high
            goals = part["v"][low + 1 : reach + 1][part["end"][low + 1 : reach + 1]]
            best.append(int(goals.max()) if len(goals) else None)
            passes.append(not len(walls))
        yield _batch(schema, {"kind": np.full(len(a), PIECE), "key": part["key"].take(pa.array(a)), "bucket": bucket[a], "side": side[held], "t": t[a], "v": part["v"][a], "step": part["step"][a],
                              "goal": part["goal"][a], "t2": t[b], "v2": part["v"][b], "best": best, "passes": passes}, len(a))


def _in_buckets(gap: int, width: int, greedy: bool):
    def run(batches):
        held: list[dict] = []  # the run that the rows so far end with
        before = schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or _arrow_schema(batch)
            part = _arrays(batch)
            row = _cut(part, len(part["t"]) - 1, len(part["t"]))
            part, before = _flagged(part, before, gap), row
            stops = np.flatnonzero(part["stop"])
            if held and not len(stops):
                held.append(part)
                continue
            at = int(stops[-1])
            if held or at:
                yield from _settled(_joined([*held, _cut(part, 0, at)] if at else held), bool(part["new"][at]), gap, width, greedy, schema)
            held = [_cut(part, at, len(part["t"]))]
        if held:
            yield from _settled(_joined(held), True, gap, width, greedy, schema)

    return run


# ------------------------------------------------------------------ between buckets


def _next_pieces(pieces: DataFrame, gap: int) -> DataFrame:
    """For each piece that goes on in the next bucket: (key, bucket, after, more), the greatest goal that it can reach there,
    and whether it may lead on through that bucket."""
    step = (F.col("r.step")) & (F.col("r.v") != F.col("l.v2"))
    left = pieces.filter(F.col("side") != PREFIX).alias("l")
    right = pieces.filter(F.col("side") != SUFFIX).alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.bucket") + 1 == F.col("r.bucket")) & (F.col("r.t") - F.col("l.t2") <= gap) & (step | F.col("r.goal")))
    reach = met.select(F.col("l.key").alias("key"), F.col("l.bucket").alias("bucket"), F.greatest(F.when(F.col("r.goal"), F.col("r.v")), F.when(step, F.col("r.best"))).alias("after"),
                       (step & F.col("r.passes") & (F.col("r.side") == WHOLE)).alias("more"))
    return common.written(reach, "pattern-reach")


def _reaches(reach: DataFrame) -> DataFrame:
    """(key, bucket, after): the greatest goal that a piece can reach at all; each round looks through twice as many."""
    hop = 1
    while reach.filter("more").limit(1).count():
        next_ = reach.select("key", (F.col("bucket") - hop).alias("bucket"), F.col("after").alias("after_"), F.col("more").alias("more_"))
        reach = reach.join(next_, ["key", "bucket"], "left").select("key", "bucket", F.greatest("after", F.when(F.col("more"), F.col("after_"))).alias("after"), (F.col("more") & F.coalesce("more_", F.lit(False))).alias("more"))
        reach, hop = common.written(reach, "pattern-reach"), 2 * hop
    return reach.drop("more")


def _across(gap: int, greedy: bool):
    """Pieces one after another, each led by its STATE row: matches that end in it, and the state it hands on.

    STATE rows: ``side`` of the piece; ``best`` the greatest goal after it, ``passes`` whether it goes on; ``t2``, ``v2`` the last
    row before it, if it is a continuation; ``v`` what a waiting match has for A, with its ``t``, ``id``, ``n``, ``total`` and ``labels`` so far.
    """

    def piece(state: dict, rows: dict):
        values, n = rows["v"].tolist(), len(rows["v"])
        link, goal = rows["link"].tolist(), rows["end"].tolist()
        down = rows["down"].copy()
        link[0] = goal[0] = False
        if state["t2"] is not None and rows["t"][0] - state["t2"] <= gap:
            link[0], goal[0] = bool(rows["step"][0]) and values[0] != state["v2"], bool(rows["goal"][0])
            down[0] = values[0] < state["v2"]
        letters, start, after = np.where(down, ord("D"), ord("U")).astype(np.uint8), 0, state["best"]
        out, key, bucket = [], state["key"], state["bucket"]

        def match(kind, low, high, began):
            """Rows low to high - 1 beside what ``began`` has; its last letter is P where it is a match."""
            own = letters[low:high].tobytes().decode()
            if began is None:
                own, began = "A" + own[1:], {"t": int(rows["t"][low]), "id": int(rows["id"][low]), "v": values[low], "n": 0, "total": 0, "labels": ""}
            row = began | {"kind": kind, "key": key, "n": began["n"] + high - low, "total": _wrapped(began["total"] + sum(values[low:high])), "labels": began["labels"] + own}
            return row | ({"labels": row["labels"][:-1] + "P", "last_id": int(rows["id"][high - 1])} if kind == MATCH else {})

        waiting = None
        if state["v"] is not None:
            began = {k: state[k] for k in ("t", "id", "v", "n", "total", "labels")}
            end = waited(state["v"], values, link, goal, after, greedy)
            if end < n:
                out.append(match(MATCH, 0, end + 1, began))
                start = end + 1
            else:
                waiting, start = match(STATE, 0, n, began), n
        if waiting is None:
            found, open_ = taken(ends(values, link, goal, after, greedy), start)
            out += [match(MATCH, a, b + 1, None) for a, b in found]
            waiting = match(STATE, open_, n, None) if open_ is not None else None
        if state["passes"]:
            out.append((waiting or {"kind": STATE, "key": key}) | {"bucket": bucket + 1, "t2": int(rows["t"][-1]), "v2": values[-1]})
        return out

    def run(batches):
        state, parts, out, schema = None, [], [], None

        def closed():
            rows = _joined(parts)
            return piece(state, _flagged(rows, None, gap))

        for batch in batches:
            schema = schema or _arrow_schema(batch)
            kinds = batch.column(0).to_numpy()
            edges = [0, *np.flatnonzero(kinds == STATE).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if kinds[low] == STATE:
                    if state is not None:
                        out += closed()
                    state, parts = batch.slice(low, 1).to_pylist()[0], []
                    low += 1
                if high > low:
                    parts.append(_arrays(batch.slice(low, high - low)))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if state is not None:
            out += closed()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _settle(kept: DataFrame, gap: int, width: int, greedy: bool, schema: str) -> list[DataFrame]:
    """Matches of the open pieces."""
    pieces = kept.filter(F.col("kind") == PIECE)
    if not pieces.limit(1).count():
        return []
    reach = _next_pieces(pieces, gap)
    if reach.filter("more").limit(1).count():
        longer = kept.filter(F.col("kind") == ROW).select("key", F.col("bucket").alias("bucket0"), F.col("side").alias("side0"), "t", "id", "v", "step", "goal").withColumn("bucket", _bucket("t", width * COARSE))
        if longer.groupBy("key", "bucket").count().agg(F.max("count")).first()[0] <= PIECE_ROWS:
            again = _scanned(longer, gap, width * COARSE, greedy, schema)
            return [again.filter(F.col("kind") == MATCH), *_settle(again, gap, width * COARSE, greedy, schema)]
    return _handed_on(kept, pieces, common.written(_reaches(reach), "pattern-after"), gap, greedy, schema)


def _handed_on(kept: DataFrame, pieces: DataFrame, reach: DataFrame, gap: int, greedy: bool, schema: str) -> list[DataFrame]:
    """Matches of the open pieces, round by round from those that nothing leads into."""
    led = reach.select("key", (F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("led"))
    info = pieces.select("key", "bucket", "side").join(reach.withColumn("on", F.lit(True)), ["key", "bucket"], "left").join(led, ["key", "bucket"], "left")
    open_right, open_left = F.col("side") != PREFIX, F.col("side") != SUFFIX
    info = info.select("key", "bucket", "side", F.when(open_right, F.col("after")).alias("best"), (open_right & F.coalesce("on", F.lit(False))).alias("passes"), (open_left & F.coalesce("led", F.lit(False))).alias("led"))
    info = common.written(info, "pattern-pieces")
    own = ["t", "id", "v", "t2", "v2", "n", "total", "labels"]
    none = lambda c: F.lit(None).cast(_RESULT[c]).alias(c)
    rows = kept.filter(F.col("kind") == ROW)
    states = info.filter("not led").select("key", "bucket", "side", "best", "passes", *map(none, own))
    done = []
    while True:
        led_by = states.select(F.lit(STATE).alias("kind"), *[F.col(c) if c in states.columns else none(c) for c in rows.columns if c != "kind"])
        turn = rows.join(states.select("key", "bucket", "side"), ["key", "bucket", "side"], "left_semi").select(*rows.columns).unionByName(led_by)
        turn = turn.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "side", F.desc("kind"), "t", "id", "v", "step", "goal")
        out = common.written(turn.mapInArrow(common.tidy(_across(gap, greedy)), schema), "pattern-turn")
        done.append(out.filter(F.col("kind") == MATCH))
        handed = out.filter(F.col("kind") == STATE).drop("side", "best", "passes")
        if not handed.limit(1).count():
            return done
        states = handed.join(info.filter("led").select("key", "bucket", "side", "best", "passes"), ["key", "bucket"]).select("key", "bucket", "side", "best", "passes", *own)


def _bucket(t: str, width: int) -> Column:
    return F.expr(f"{t} div {width} - CASE WHEN {t} % {width} < 0 THEN 1 ELSE 0 END")


def _scanned(rows: DataFrame, gap: int, width: int, greedy: bool, schema: str) -> DataFrame:
    rows = rows.repartition("key", "bucket").sortWithinPartitions("key", "t", "id", "v", "step", "goal")
    return common.written(rows.mapInArrow(common.tidy(_in_buckets(gap, width, greedy)), schema), "pattern-buckets")


def matches(df: DataFrame, key: str, at: str, row_id: str, value: Column, step: Column, goal: Column, gap: int = 10 * MINUTE, bucket: int = 240 * MINUTE, greedy: bool = False) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, total, labels) of every match of ``A (D|U)*? P``, or ``A (D|U)* P`` if ``greedy``.

    The distinct rows of each ``key`` in order of ``at`` (a timestamp) and ``row_id``; rows with a null key or time are left out.
    ``value`` (a long) decides: A has one; D and U satisfy ``step`` and are below or above the row before; P satisfies ``goal``
    and is no less than A; D, U and P come at most ``gap`` microseconds after the row before.  A row whose value is null fits
    no letter, and a null condition is not satisfied.  Rows of equal order are taken by value.  ``total`` sums the values,
    modulo 2**64.  An empty table gives an empty result; all columns tell distinct rows apart, others than those named play
    no part besides, whatever their names.

    ``bucket`` (microseconds, no less than ``gap``) is how much of a key's time one task has at once.  A match may be as long as
    it likes; only where no row stops matches over more than PIECE_ROWS rows do rounds follow one another, bucket by bucket.
    """
    if bucket < max(gap, 1):
        raise ValueError("a bucket has to be as long as the gap at least")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(f"`{at}`").cast("timestamp_ntz"))
    rows = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{at}`").isNotNull()).dropDuplicates()
    rows = rows.select(F.col(f"`{key}`").alias("key"), micros.alias("t"), F.col(f"`{row_id}`").cast("long").alias("id"), value.cast("long").alias("v"), step.alias("step"), goal.alias("goal"))
    schema = _schema(df.schema[key].dataType.simpleString())
    kept = _scanned(rows.withColumn("bucket", _bucket("t", bucket)), gap, bucket, greedy, schema)
    found = [kept.filter(F.col("kind") == MATCH), *_settle(kept, gap, bucket, greedy, schema)]
    columns = ["key", "t", "id", "last_id", "n", "total", "labels"]
    found = reduce(DataFrame.unionByName, [f.select(*columns) for f in found]).withColumn("bucket", _bucket("t", bucket))
    return _numbered(found).select(F.col("key").alias(key), "match_no", F.col("id").alias("first_id"), "last_id", F.col("n").alias("n_rows"), "total", "labels")


def _numbered(found: DataFrame) -> DataFrame:
    """``match_no`` from 1 for each key: in a bucket, plus the buckets before in a coarse one, plus the coarse ones before."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = F.floor(F.col("bucket") / COARSE).alias("coarse")
    counts = found.groupBy("key", coarse, "bucket").agg(F.count(F.lit(1)).alias("here"))
    most = counts.groupBy("key", "coarse").agg(F.sum("here").alias("here")).select("key", "coarse", F.coalesce(F.sum("here").over(before("key", "coarse")), F.lit(0)).alias("far"))
    offsets = counts.select("key", "coarse", "bucket", F.coalesce(F.sum("here").over(before("key", "coarse", "bucket")), F.lit(0)).alias("near")).join(most, ["key", "coarse"])
    offsets = offsets.select("key", "bucket", (F.col("near") + F.col("far")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("t", "id", "last_id"))
    return found.withColumn("inside", inside).join(offsets, ["key", "bucket"]).withColumn("match_no", (F.col("inside") + F.col("offset")).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    cents = F.when(~F.isnan("value"), F.floor(100 * F.col("value") + 0.5))
    rows = matches(clicks, "client_id", "ts", "click_id", cents, step=F.col("kind") != "error", goal=F.col("kind") == "purchase")
    return rows.select("client_id", "match_no", "first_id", "last_id", "n_rows", F.col("total").alias("sum_cents"), F.sha2("labels", 256).alias("labels_sha256"))


ORACLE = """
WITH RECURSIVE d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT client_id, click_id, ts, kind, floor(100 * value + 0.5)::BIGINT AS cents, row_number() OVER w AS i, lag(ts) OVER w AS ts0, lag(floor(100 * value + 0.5)::BIGINT) OVER w AS cents0
      FROM d WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
f AS (SELECT *, coalesce(ts - ts0 <= INTERVAL 10 MINUTE AND kind <> 'error' AND cents <> cents0, false) AS link,
        coalesce(ts - ts0 <= INTERVAL 10 MINUTE AND kind = 'purchase' AND cents IS NOT NULL, false) AS goal FROM o),
r AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT client_id, i, cents, CASE WHEN link THEN run ELSE run - 1 END AS run FROM r WHERE goal),
e AS (SELECT a.client_id, a.i AS first_i, min(g.i) AS last_i FROM r a JOIN g ON g.client_id = a.client_id AND g.run = a.run AND g.i > a.i AND g.cents >= a.cents GROUP BY ALL),
n AS (SELECT r.client_id, r.i, min(e.first_i) OVER (PARTITION BY r.client_id ORDER BY r.i DESC ROWS UNBOUNDED PRECEDING) AS first_i
      FROM r LEFT JOIN e ON e.client_id = r.client_id AND e.first_i = r.i),
m AS (SELECT n.client_id, 1 AS match_no, e.first_i, e.last_i FROM n JOIN e ON e.client_id = n.client_id AND e.first_i = n.first_i WHERE n.i = 1
      UNION ALL
      SELECT m.client_id, m.match_no + 1, e.first_i, e.last_i FROM m JOIN n ON n.client_id = m.client_id AND n.i = m.last_i + 1 JOIN e ON e.client_id = n.client_id AND e.first_i = n.first_i)
SELECT m.client_id, m.match_no::BIGINT AS match_no, any_value(CASE WHEN r.i = m.first_i THEN r.click_id END) AS first_id, any_value(CASE WHEN r.i = m.last_i THEN r.click_id END) AS last_id,
  count(*) AS n_rows, sum(r.cents)::BIGINT AS sum_cents,
  sha256(string_agg(CASE WHEN r.i = m.first_i THEN 'A' WHEN r.i = m.last_i THEN 'P' WHEN r.cents < r.cents0 THEN 'D' ELSE 'U' END, '' ORDER BY r.i)) AS labels_sha256
FROM m JOIN r ON r.client_id = m.client_id AND r.i BETWEEN m.first_i AND m.last_i
GROUP BY m.client_id, m.match_no
"""
