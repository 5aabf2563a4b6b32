"""Row patterns against a backtracking matcher, with matches inside one bucket and over many."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.llm import row_pattern as rp

GAP = timedelta(minutes=10)
DDL = "client_id long, ts timestamp_ntz, click_id long, value double, kind string, props string"


def brute(rows, greedy):
    """Search from the left, trying every end in the order of the quantifier."""
    by = {}
    for r in set(rows):
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    out = []
    for client, own in by.items():
        own.sort(key=lambda r: (r[1], r[2]))
        cents = [None if r[3] is None else int((100 * r[3] + 0.5) // 1) for r in own]
        i, number = 0, 0
        while i < len(own):
            found = None
            if cents[i] is not None:
                j = i + 1
                while j < len(own) and own[j][1] - own[j - 1][1] <= GAP and cents[j] is not None:
                    if own[j][4] == "purchase" and cents[j] >= cents[i]:
                        found = j
                        if not greedy:
                            break
                    if own[j][4] in (None, "error") or cents[j] == cents[j - 1]:
                        break
                    j += 1
            if found is None:
                i += 1
                continue
            number += 1
            letters = "A" + "".join("D" if cents[k] < cents[k - 1] else "U" for k in range(i + 1, found)) + "P"
            out.append((client, number, own[i][2], own[found][2], found - i + 1, sum(cents[i : found + 1]), letters))
            i = found + 1
    return sorted(out)


def clicks(seed, n, gaps, kinds, values):
    r = random.Random(seed)
    rows, now = [], {c: datetime(2024, 1, 1) + timedelta(minutes=r.randrange(99)) for c in range(5)}
    now[1] = datetime(1969, 12, 31, 20)  # before the epoch
    for i in range(n):
        c = r.choice([0, 0, 0, 1, 2, 3, 4])
        now[c] += timedelta(seconds=r.choice(gaps))
        rows.append((c, now[c], i, r.choice(values), r.choice(kinds), "x"))
        if r.random() < 0.1:
            rows.append(rows[-1])
    return rows + [(None, datetime(2024, 1, 1), 1, 1.0, "purchase", None), (0, None, 2, 1.0, "purchase", None), (None, None, None, None, None, None), (9, datetime(2024, 1, 1), 7, 5.0, "purchase", "")]


def run(spark, rows, greedy=False, bucket=10 * rp.MINUTE, **more):
    df = spark.createDataFrame(rows, DDL).withColumn("bucket", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    cents = F.floor(100 * F.col("value") + 0.5)
    got = rp.matches(df, "client_id", "ts", "click_id", cents, F.col("kind") != "error", F.col("kind") == "purchase", bucket=bucket, greedy=greedy, **more)
    return sorted(map(tuple, got.collect()))


LONG = dict(gaps=[100, 300, 450, 600], kinds=["view", "click", "purchase"], values=[x / 4 for x in range(-40, 400)])
MIXED = dict(gaps=[0, 5, 200, 600, 600.000001, 5000], kinds=["view", "purchase", "purchase", "error", None], values=[None, 1.0, 2.0, 2.005, 3.0, -1.0, 5.5, 8.0])


@pytest.mark.parametrize("greedy", [False, True])
@pytest.mark.parametrize("shape", ["long", "mixed"])
def test_against_backtracking(spark, shape, greedy):
    rows = clicks(3 + greedy, 900, **(LONG if shape == "long" else MIXED))
    want = brute(rows, greedy)
    assert len(want) > (5 if greedy else 40)
    for bucket in (10, 240):
        assert run(spark, rows, greedy, bucket * rp.MINUTE) == want


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_a_match_over_many_buckets(spark, monkeypatch, most):
    """No row stops the match for hours: it is handed on from bucket to bucket, or found in a longer one."""
    monkeypatch.setattr(rp, "PIECE_ROWS", most)
    t = datetime(2024, 1, 1)
    mixed = [r for r in clicks(6, 150, **MIXED) if r[0] == 0]
    rows = mixed + [(1, t + timedelta(minutes=9 * i), i, 500.0 - i, "view", "x") for i in range(12)] + [(1, t + timedelta(minutes=9 * 12), 12, 499.0, "purchase", "x"), (1, t + timedelta(minutes=9 * 13), 13, 600.0, "purchase", "x")]
    for greedy in (False, True):
        got = run(spark, rows, greedy)
        assert got == brute(rows, greedy)
        assert max(r[4] for r in got) >= 12


def test_scans_answer_every_start():
    r = random.Random(1)
    for _ in range(400):
        n = r.randrange(1, 14)
        v = [r.randrange(4) for _ in range(n)]
        link, goal = [r.random() < 0.8 for _ in v], [r.random() < 0.5 for _ in v]
        after = r.choice([None, 0, 2, 5])
        for greedy in (False, True):
            want = []
            for i in range(n):
                hits, j = [], i + 1
                while j < n:
                    if goal[j] and v[j] >= v[i]:
                        hits.append(j)
                    if not link[j]:
                        break
                    j += 1
                if j >= n and after is not None and after >= v[i]:
                    hits.append(n)
                want.append((hits[-1] if greedy else hits[0]) if hits else -1)
            assert rp.ends(v, link, goal, after, greedy) == want


def test_edge_cases(spark):
    assert run(spark, []) == []
    t = datetime(2024, 1, 1)
    ties = [(1, t, 1, 1.0, "view", "a"), (1, t, 1, 1.0, "view", "a"), (1, t, 2, 3.0, "purchase", "a"), (1, t, 2, 3.0, "purchase", "a")]
    assert run(spark, ties) == [(1, 1, 1, 2, 2, 400, "AP")]
    with pytest.raises(ValueError):
        run(spark, ties, bucket=rp.MINUTE)


def test_query_has_the_rows_of_its_sql(spark, tmp_path):
    rows = clicks(8, 1500, **MIXED)
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "clicks.parquet"))
    for folder, files in (("/root/testdata/sf0.001", "/root/testdata/sf0.001/clicks.parquet"), (str(tmp_path), f"{tmp_path}/clicks.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW clicks AS SELECT * FROM '{files}'")
        rel = con.sql(rp.ORACLE)
        got = rp.query(spark, folder)
        assert got.columns == rel.columns
        assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
