"""Table-generating operators: windows, sentences, token chunks, overlapping packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(df: DataFrame, text: Column, size: int, overlap: int, name: str = "chunk") -> DataFrame:
    """Sliding windows of ``size`` words that share ``overlap`` words; one row a window, empty texts none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.when(F.size("_w") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(step)))
    rows = df.withColumn("_w", words).withColumn("_s", F.explode(starts))
    return rows.withColumn(f"{name}_no", (F.col("_s") / step).cast("int")).withColumn(name, F.array_join(F.slice("_w", F.col("_s") + 1, size), " ")).drop("_w", "_s")


def char_windows(df: DataFrame, text: Column, size: int, stride: int, name: str = "part") -> DataFrame:
    """Windows of ``size`` characters every ``stride``; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    rows = df.withColumn("_t", text).withColumn("start", F.explode(starts))
    return rows.withColumn(name, F.substring(F.col("_t"), F.col("start") + 1, F.lit(size))).drop("_t")
