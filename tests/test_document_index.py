"""Merging of batches into a published index: replays, failures, rollback, other profiles."""

import pytest
from pyspark.sql import functions as F

from attestra.sinks import document_index as D

DDL = "source_kind string, document_id string, chunk_id string, text string, page int"
PROFILE = {"model": "m", "dense": 8}


def rows(spark, *chunks):
    return spark.createDataFrame([("paper", *c) for c in chunks], DDL)


def texts(spark, path):
    return sorted((r.document_id, r.chunk_id, r.text) for r in D.read_active(spark, path).collect())


def test_batches_replace_whole_documents(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    one = rows(spark, ("a", "a1", "first", 1), ("a", "a2", "second", None), ("b", "b1", "other", 1), (None, "x", "no document", 1))
    assert D.read_active(spark, path) is None and D.upsert(one.limit(0), path, PROFILE) is None
    assert D.upsert(one, path, PROFILE) == 1
    assert texts(spark, path) == [("a", "a1", "first"), ("a", "a2", "second"), ("b", "b1", "other")]
    # the same rows in another order, some repeated, are no change
    assert D.upsert(one.unionByName(one).repartition(3), path, PROFILE) is None
    assert D.upsert(rows(spark, ("a", "a1", "changed", 1), ("c", "c1", "new", 2)), path, PROFILE) == 2
    assert texts(spark, path) == [("a", "a1", "changed"), ("b", "b1", "other"), ("c", "c1", "new")]
    assert D.active_documents(spark, path).count() == 3
    # a null is not an empty value
    assert D.upsert(rows(spark, ("c", "c1", None, 2)), path, PROFILE) == 3 and D.upsert(rows(spark, ("c", "c1", "", 2)), path, PROFILE) == 4
    assert D.rollback(spark, path) == 3 and ("c", "c1", None) in texts(spark, path)
    assert D.upsert(rows(spark, ("a", "a1", "changed", 1)), path, PROFILE) is None
    before = {r.document_id: r.generation for r in D.active_documents(spark, path).collect()}
    number = D.upsert(rows(spark, ("a", "a1", "changed", 1)), path, PROFILE, force=True)
    after = {r.document_id: r.generation for r in D.active_documents(spark, path).collect()}
    assert number == 5 and after["a"] != before["a"] and after["b"] == before["b"] and len(D.read_active(spark, path).filter("document_id = 'a'").collect()) == 1


def test_a_failed_batch_leaves_what_was_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    D.upsert(rows(spark, ("a", "a1", "old", 1)), path, PROFILE)
    broken = rows(spark, ("a", "a1", "new", 1)).withColumn("text", F.expr("if(text = 'new', raise_error('no'), text)").cast("string"))
    with pytest.raises(Exception):  # noqa: B017
        D.upsert(broken, path, PROFILE)
    moved = D._moved

    def fails(spark, source, target):
        if "/documents/" in target:
            raise OSError("lost")
        moved(spark, source, target)

    monkeypatch.setattr(D, "_moved", fails)
    with pytest.raises(OSError):
        D.upsert(rows(spark, ("a", "a1", "new", 1)), path, PROFILE)
    monkeypatch.setattr(D, "_moved", moved)
    assert texts(spark, path) == [("a", "a1", "old")] and not list((tmp_path / "i/staging").iterdir())
    assert D.upsert(rows(spark, ("a", "a1", "new", 1)), path, PROFILE) == 3
    assert texts(spark, path) == [("a", "a1", "new")]


def test_profiles_do_not_mix(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    D.upsert(rows(spark, ("a", "a1", "old", 1)), path, PROFILE)
    with pytest.raises(D.ProfileMismatch):
        D.upsert(rows(spark, ("b", "b1", "new", 1)), path, PROFILE | {"dense": 16})
    assert texts(spark, path) == [("a", "a1", "old")]
    (tmp_path / "i/profile.json").write_text("{")
    for crc in (tmp_path / "i").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(D.ProfileMismatch):
        D.guard(spark, path, PROFILE)


def test_vacuum_keeps_what_a_rollback_needs(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    for k in range(4):
        D.upsert(rows(spark, ("a", "a1", f"v{k}", 1)), path, PROFILE)
    assert D.vacuum(spark, path) == [1, 2]
    assert texts(spark, path) == [("a", "a1", "v3")]
    D.rollback(spark, path)
    assert texts(spark, path) == [("a", "a1", "v2")]


def test_batches_of_a_stream(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/i"
    rows(spark, ("a", "a1", "one", 1)).coalesce(1).write.parquet(str(source))
    for _ in range(2):  # the second start on the checkpoint finds the new file only
        stream = spark.readStream.schema(DDL).parquet(str(source)).writeStream.foreachBatch(lambda batch, _: D.upsert(batch, path, PROFILE) and None)
        stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        rows(spark, ("a", "a1", "two", 1)).coalesce(1).write.mode("append").parquet(str(source))
    assert texts(spark, path) == [("a", "a1", "two")]
