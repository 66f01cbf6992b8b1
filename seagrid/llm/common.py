"""Shared plumbing: scratch tables, table paths and Arrow builders."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Lists of paths, innermost last; each thread has its own.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the path layout of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a temporary
    folder is used instead; on a cluster executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="seagrid-")
    return f"file://{_OWN_DIR[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/seagrid-llm/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Inside a ``scratch_scope`` the table goes with that scope, unless ``keep`` hands
    it to the scope around it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    scopes = _SCOPES.get()
    scopes = scopes[: len(scopes) - keep]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables materialized inside; what leaves the block must not read them."""
    paths: list[str] = []
    outer = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(outer)
        gc.collect()  # else the driver's JVM keeps the plans that frames out of use refer to
        release_memory()
        for path in paths:
            delete_path(spark, path)


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A bit map of ``bits`` places (a power of two), whatever the corpus, with a column's integers."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    chunks = hashes.groupBy(F.bitmap_bucket_number(place).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = bytearray(max(1 << 12, bits // 8))
    rows = chunks.toArrow()  # one job; as many rows as the map has chunks, at most
    for chunk, part in zip(rows.column("chunk").to_pylist(), rows.column("bits")):
        bitmap[(chunk - 1) * 4096 : chunk * 4096] = part.as_buffer()
    return bytes(bitmap)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 20) -> None:
    """Fewer rows and bytes in an Arrow batch, as texts are long: a batch stands in the JVM and in Python at once.

    A batch ends after the row that reaches ``size`` bytes. Holds for the session from
    now on, as results are computed later; smaller settings stay.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, str(size))


def release_memory() -> None:
    """Give freed memory back to the system; workers are used again and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python's copies stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release_memory()


def finite_vector(vec: Column) -> Column:
    """True for a non-empty array of non-null finite numbers."""
    inside = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(inside, F.lit(False))


def vector_groups(ids: pa.Array, vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length that occurs among the vectors of one batch."""
    lengths = vecs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    keys = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield keys[at], flat[starts[at][:, None] + np.arange(d)]
