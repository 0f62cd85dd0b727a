"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that Spark hands to Python at once: whole texts are long, and each of a task's batches is held several times.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session, unless the user has set a bound of their own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; ``release`` removes it.

    Only where the setting is absent (a single machine, as in tests) a temporary folder takes its place until the
    process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="strandlake-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = _local[app]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    _made.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Removes all folders that this process got from ``shared_dir``; results that read them must have been written."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, decide: Callable[[list[str | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts ``decide`` marks; all columns pass as they are, and texts go to Python once."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_bucket(doc_id: Column | str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small views of a batch, which bound what a Python worker holds at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8_rows(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each row of a string column without making Python strings; null rows are empty."""
    if pa.types.is_large_string(column.type):
        import numpy as np

        kind = np.int64
    else:
        import numpy as np

        column = column.cast(pa.string())
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield data[int(ends[i]) : int(ends[i + 1])] if valid is None or valid[i] else memoryview(b"")


def give_back() -> None:
    """Hands memory that a driver's training no longer needs back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc32_text(value: object) -> int:
    return zlib.crc32(str(value).encode())
