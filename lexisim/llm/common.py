"""Helpers that the training-data operators share.

Nothing here collects rows: tables that cut lineage are written to the shared
checkpoint folder, and Python kernels see Arrow batches cut to a bounded number
of text bytes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised kernel call sees (one longer text may exceed it).
CHUNK_BYTES = 1 << 18
#: Bytes and rows that an Arrow batch between the JVM and Python holds.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000

#: Rows (of some ten bytes each) that are sent to all tasks, at most.
FEW = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexisim-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is deleted when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark)}/lexisim-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lexisim_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` gave, once all that reads them has been written."""
    for table in tables:
        drop_path(table.sparkSession, table._lexisim_path)


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be sent to all tasks of a join if it has FEW rows at most."""
    return F.broadcast(table) if table.count() <= FEW else table


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``new_path`` gave, on whichever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] != path]


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, unless the session has set narrower ones."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone already
            return


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` text bytes at most, one row at least."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (of bytes not in ``white``), and the n+1 offsets of rows into them."""
    ink = ~white[data]
    first, last = ink.copy(), ink.copy()
    if len(ink):
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        edge = off[:-1][off[:-1] < len(ink)]
        first[edge] = ink[edge]
        edge = off[1:][off[1:] > 0] - 1
        last[edge] = ink[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
_BASE = 0x9FB21C651E98DF25  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        tables = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
        if size > 4 * CHUNK_BYTES:  # for one very long text only; not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over prefix sums, finalised with the length."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
