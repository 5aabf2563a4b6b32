"""Generations of a table: written beside each other, published by a pointer, the last one kept for rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pointer(spark: SparkSession, path: str):
    names = sorted((n for n in _names(spark, f"{path}/pointer") if n.isdigit()), key=int)
    return names[-1] if names else None


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: count and sum of row hashes."""
    n, s = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n:x}-{int(s) & (1 << 64) - 1:016x}"


def publish(df: DataFrame, path: str, force: bool = False) -> tuple[str, bool]:
    """(generation, whether it was written): rows equal to the active generation's are a no-op unless forced.

    A generation is whole before its marker file appears, so a reader sees the old table or the new one.
    """
    spark = df.sparkSession
    mark, last = fingerprint(df), _pointer(spark, path)
    if last is not None and not force and f"{mark}" in _names(spark, f"{path}/marks/{last}"):
        return last, False
    new = str(int(last) + 1 if last is not None else 0)
    df.write.mode("overwrite").parquet(f"{path}/generation/{new}")
    for where in (f"{path}/marks/{new}/{mark}", f"{path}/pointer/{new}"):
        fs, p, _ = _fs(spark, where)
        fs.create(p, True).close()
    for old in _names(spark, f"{path}/generation"):
        if old.isdigit() and int(old) < int(new) - 1:
            fs, p, _ = _fs(spark, f"{path}/generation/{old}")
            fs.delete(p, True)
    return new, True


def read_active(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/generation/{_pointer(spark, path)}")
