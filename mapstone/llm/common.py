"""Shared plumbing of the training-data operators: shared storage, code shipping and table access."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it.
WS = "[\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch, where the session keeps Spark's own default (10,000): whole texts are held on both sides.
BATCH_ROWS = 500
#: Rows of a table of numbers that may be broadcast: some 30 MB. Beyond it Spark joins by sorting.
BROADCAST_ROWS = 1_000_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it; see BATCH_ROWS."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of no more than `size` meanwhile, for rows that are large arrays; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="mapstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders `by` columns, and read it back: columnar, prunable and safe against lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/mapstone/{label}-{uuid.uuid4().hex}"
    to = df.write.option("compression", "zstd")  # whole texts take a quarter less of the disk than by Spark's default
    (to.partitionBy(*by) if by else to).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def numbered(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One stored row per document: id, rid (a row number of its own) and whole (the row)."""
    return materialize(docs.select(F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("whole")), "numbered")


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it is counted to have BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of numbered() rows, all columns, without those whose rid is dropped."""
    gone = small(materialize(dropped.select("rid"), "dropped"))
    return rows.select("rid", "whole").join(gone, "rid", "left_anti").select("whole.*")


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n 64-bit hashes, given in arrays."""
    ones = np.zeros(64, np.int64)
    for x in hashes:
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def lean(run: Callable) -> Callable:
    """A pass over Arrow batches that gives what it has freed back to the system: workers are reused by later stages."""

    def passed(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return passed


def kept(spark: SparkSession, label: str, source: str, build: Callable[[], dict]) -> dict:
    """What build() makes, which depends on nothing but the file source: read from the shared folder, or made and left there."""
    code = hashlib.sha256(Path(source).read_bytes()).hexdigest()[:16]
    at = f"{shared_dir(spark)}/mapstone/models/{label}-{code}"
    try:
        rows = spark.read.schema("model string").json(at).collect()
        if len(rows) == 1 and rows[0][0]:
            return json.loads(rows[0][0])
    except AnalysisException:  # nobody left it there yet
        pass
    model = build()
    spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").json(at)
    return json.loads(json.dumps(model))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int = 5):
    """crc32(doc_id as text) mod n; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    """A public tokenizer file, found at run time on the machine that asks; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
