"""What the operators of this subpackage share: the shared folder, written intermediates, word patterns."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts, and a word, as regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session, as in tests, may do
    without and gets a folder of its own; on a cluster it would be one machine's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="attestra-shared-")
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; one for each call, so reruns never meet old files."""
    return f"{shared_folder(spark)}/attestra/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, before the next step adds its own.

    The first collection finds the plans, the second what they held; the cleaner works in a thread of its own.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def local_path(uri: str) -> str:
    """The POSIX path of a file: URI (or plain path); index and archive files need a shared folder that is mounted."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"random-access files need a mounted shared folder, not {uri!r}")
    return unquote(parts.path)


def publish(path: str, write) -> None:
    """Write a file under an attempt's own name and rename it: a retried or speculative task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    attempt = f"{path}.{uuid.uuid4().hex[:8]}.part"
    try:
        with open(attempt, "wb") as out:
            write(out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(attempt, path)
    finally:
        if os.path.exists(attempt):
            os.remove(attempt)


def slices(batches, rows: int = 1000):
    """Arrow batches in slices of ``rows``, so that Python objects are made for few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(step):
    """``step`` over Arrow batches, which hands freed memory back when its task ends."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Hand freed memory back to the system: a worker is reused by later tasks, whose JVM needs it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(column: str = "text"):
    """All words of a text as an array; a null text has none."""
    return F.filter(F.split(text_or_empty(column), SPACE + "+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def owners_for(spark: SparkSession) -> int:
    """Tasks that own key ranges: as many as the session's shuffle partitions, which follow the cluster and the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
