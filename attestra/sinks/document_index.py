"""An index of documents' chunks that batches are merged into, one generation a document.

A batch is compared with what is published by digests of whole documents; only changed documents are written, beside the
old ones, and become active with one rename.  A replayed batch is a no-op, a failed one leaves what was there, the last
one can be rolled back, and a folder takes rows of one profile only.

    profile.json            what the rows were made with
    chunks/commit=N         rows of the documents that commit N changed
    documents/commit=N      (keys, generation, fingerprint) of these; there once the commit is whole
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sinks.generations import _fs, _names

KEYS = ("source_kind", "document_id")


class ProfileMismatch(ValueError):
    """The folder's rows were made with another profile, or its manifest cannot be read."""


def profile_fingerprint(profile: dict) -> str:
    return hashlib.sha256(json.dumps(profile, ensure_ascii=True, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def guard(spark: SparkSession, path: str, profile: dict) -> str:
    """The profile's fingerprint; it is written down by the first call, and has to be the same in later ones."""
    fs, manifest, _ = _fs(spark, f"{path}/profile.json")
    mark = profile_fingerprint(profile)
    if not fs.exists(manifest):
        out = fs.create(manifest, False)
        out.writeBytes(json.dumps({"fingerprint": mark, "profile": profile}, ensure_ascii=True, sort_keys=True))
        out.close()
        return mark
    try:
        there = json.loads(spark.read.text(f"{path}/profile.json", wholetext=True).first()[0])
        told = there["fingerprint"] == profile_fingerprint(there["profile"])
    except (ValueError, KeyError, TypeError) as error:
        raise ProfileMismatch(f"the manifest of {path} is damaged") from error
    if not told or there["fingerprint"] != mark:
        raise ProfileMismatch(f"{path} has rows of another profile" if told else f"the manifest of {path} is damaged")
    return mark


def document_fingerprints(chunks: DataFrame, mark: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, fingerprint, n_chunks): a digest of each document's distinct rows in any order, nulls told from empty values.

    Row digests are summed up by their first three digits, then these by document, so that a long document's rows are
    spread over tasks.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in chunks.columns if c not in keys)), {"ignoreNullFields": "false"}), 256)
    rows = chunks.select(*keys, row.alias("row")).distinct()
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = rows.groupBy(*keys, F.substring("row", 1, 3).alias("part")).agg(joined("row").alias("digest"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(*keys).agg(joined(F.concat("part", "digest")).alias("digest"), F.sum("n").alias("n_chunks"))
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return whole.select(*keys, F.sha2(F.concat_ws("\x1f", F.lit(mark), *key, "digest"), 256).alias("fingerprint"), "n_chunks")


def _commits(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, f"{path}/documents") if n.startswith("commit="))


def _record(spark: SparkSession, path: str, until: int | None = None) -> DataFrame | None:
    commits = [c for c in _commits(spark, path) if until is None or c <= until]
    if not commits:
        return None
    return spark.read.option("basePath", f"{path}/documents").parquet(*[f"{path}/documents/commit={c}" for c in commits])


def active_documents(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, until: int | None = None) -> DataFrame | None:
    """(keys, fingerprint, generation, commit): each document's last commit; None before the first one."""
    record = _record(spark, path, until)
    if record is None:
        return None
    last = record.groupBy(*keys).agg(F.max_by(F.struct("fingerprint", "generation", F.col("commit").cast("long").alias("commit")), "commit").alias("last"))
    return last.select(*keys, "last.*")


def upsert(chunks: DataFrame, path: str, profile: dict, keys: Sequence[str] = KEYS, force: bool = False) -> int | None:
    """Publish the documents of ``chunks`` that differ from what is active; the commit's number, or None if none does.

    A document of the batch replaces the active one whole; others stay.  ``force`` gives every document of the batch a new
    generation.  Rows that repeat count once; documents with null keys are left out; an empty batch is a no-op.  Two
    writers that meet on one number: the second fails and leaves the first's.
    """
    spark = chunks.sparkSession
    mark = guard(spark, path, profile)
    chunks = chunks.dropna(subset=list(keys)).distinct()
    staged = f"{path}/staging/{uuid.uuid4().hex[:12]}"
    try:
        now = document_fingerprints(chunks, mark, keys)
        active = active_documents(spark, path, keys)
        if active is not None and not force:
            now = now.join(active.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
        salt = F.concat("fingerprint", F.lit(f"|{uuid.uuid4().hex}")) if force else None
        generation = F.substring(F.sha2(salt, 256) if force else F.col("fingerprint"), 1, 24)
        now.withColumn("generation", generation).write.parquet(f"{staged}/documents")
        changed = spark.read.parquet(f"{staged}/documents")
        if changed.isEmpty():
            return None
        chunks.join(changed.select(*keys, "generation"), list(keys)).write.parquet(f"{staged}/chunks")
        number = max(_commits(spark, path) + [int(n.split("=")[1]) for n in _names(spark, f"{path}/claims")] + [0]) + 1
        fs, claim, _ = _fs(spark, f"{path}/claims/commit={number}")
        fs.create(claim, False).close()  # raises if another writer has it
        for name in ("chunks", "documents"):  # the second rename makes the commit active
            _moved(spark, f"{staged}/{name}", f"{path}/{name}/commit={number}")
        return number
    finally:
        fs, p, _ = _fs(spark, staged)
        fs.delete(p, True)


def _moved(spark: SparkSession, source: str, target: str) -> None:
    fs, to, jvm = _fs(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(jvm.org.apache.hadoop.fs.Path(source), to):
        raise OSError(f"{target} could not be published")


def read_active(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """The rows of every document's active generation; None before the first commit."""
    active = active_documents(spark, path, keys)
    if active is None:
        return None
    needed = [r["commit"] for r in active.select("commit").distinct().collect()]  # at most the number of commits kept
    rows = spark.read.option("basePath", f"{path}/chunks").parquet(*[f"{path}/chunks/commit={c}" for c in needed])
    rows = rows.withColumn("commit", F.col("commit").cast("long"))
    return rows.join(active.select(*keys, "generation", "commit"), [*keys, "generation", "commit"], "left_semi").drop("commit")


def rollback(spark: SparkSession, path: str) -> int | None:
    """Undo the last commit; the number of the one that is active now, or None."""
    commits = _commits(spark, path)
    if not commits:
        return None
    for name in ("documents", "chunks"):
        fs, p, _ = _fs(spark, f"{path}/{name}/commit={commits[-1]}")
        fs.delete(p, True)
    return commits[-2] if len(commits) > 1 else None


def vacuum(spark: SparkSession, path: str, keep: int = 1, keys: Sequence[str] = KEYS) -> list[int]:
    """Delete commits that no document needs, neither now nor after up to ``keep`` rollbacks; their numbers."""
    commits = _commits(spark, path)
    needed: set[int] = set()
    for until in commits[-keep - 1 :]:
        active = active_documents(spark, path, keys, until)
        needed |= {r["commit"] for r in active.select("commit").distinct().collect()}
    gone = [c for c in commits if c not in needed]
    for c in gone:
        for name in ("documents", "chunks"):
            fs, p, _ = _fs(spark, f"{path}/{name}/commit={c}")
            fs.delete(p, True)
    return gone
