"""What the operators of this subpackage share: input columns, word splitting,
the fixed train/holdout split, and a folder that every executor can see."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as in ``[^\x20\x09-\x0D]+``. ``bytes.split()`` parts at the same six bytes.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes, about, of a batch of rows on its way to Python: the JVM holds each batch several times outside its heap.
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts need, whatever else the table holds; from here on they go to Python in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch by BATCH_BYTES, unless the session has a bound of its own. It stays: results are read later."""
    if (bound := "spark.sql.execution.arrow.maxBytesPerBatch") not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


@contextmanager
def released() -> Iterator[None]:
    """Afterwards the memory that this Python worker has freed is the system's again: idle workers live on beside the next stages."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for ``mapInArrow``, with its memory released at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            yield from run(batches)

    return task


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is missing, as in tests on one machine, a temporary
    folder is used; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lumenframe-shared")
    return f"{base.rstrip('/')}/lumenframe-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps neither recompute it nor depend on any one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    # its shuffle files go when the table is whole: nothing else reads them
    clean, was = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        was = spark.conf.get(clean, None)
        spark.conf.set(clean, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, was) if was is not None else spark.conf.unset(clean)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, table: DataFrame) -> None:
    """Deletes the files that a plan over materialised tables reads, once nothing reads them any more."""
    paths = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: decides which labelled rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def blobs(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text, without decoding; null counts as empty."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads close values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
