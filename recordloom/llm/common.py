"""Shared helpers: the shared work folder, staged tables and text batching."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one Python step holds at a time beside the Arrow batch.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session has Spark's default; texts are long.
BATCH_ROWS = 1000

#: Keys with more than this fraction of a join's rows (1/HOT) don't go through its shuffle.
HOT = 1000

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run that driver and executors share.

    It lies under the session's ``spark.checkpoint.dir``. Only where that is
    unset (tests, one machine) a temporary folder is made and set.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
            spark.sparkContext.setCheckpointDir(base)
        _FOLDERS[app] = f"{qualified(spark, base).rstrip('/')}/recordloom-{app}"
        atexit.register(clear_shared, spark)
    return _FOLDERS[app]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of its file system.

    A path without a scheme means Hadoop's default file system to Spark, but
    the local disk to readers inside a task, so both get the same full name.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", full)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this run has staged. Results read from it must be saved first."""
    try:
        folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except (OSError, AttributeError, Py4JError):  # the session has ended already
        pass


def written(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet in the shared folder; gives the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, keeps a result that several plans read from being
    computed twice, and survives the loss of executors.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def stored(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a staged table, read inside a task, at most ``rows`` at a time."""
    system, folder = fs.FileSystem.from_uri(path)
    files = system.get_file_info(fs.FileSelector(folder))
    for name in sorted(f.path for f in files if f.path.endswith(".parquet") and f.size):
        with system.open_input_file(name) as raw:
            yield from pq.ParquetFile(raw).iter_batches(batch_size=rows)


def split_join(left: DataFrame, right: DataFrame, on: list[str], n: str, semi: bool = False) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key and the key's rows in ``left`` as ``n``.

    A key with more than 1/HOT of the rows would land in one task, so such
    keys, fewer than HOT by their definition, are broadcast; ``left`` stays
    where it is for them. The other keys meet in a shuffle. Keys aren't null.
    """
    most = right.agg(F.max(n), F.sum(n)).first()
    how = "left_semi" if semi else "inner"
    if most[0] is None or most[0] * HOT <= most[1]:
        return left.join(right.drop(n), on, how)
    much = F.col(n) * F.lit(HOT) > F.lit(most[1])
    hot, rest = right.where(much).drop(n), right.where(~much).drop(n)
    some = left.join(F.broadcast(hot), on, how)
    return some.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``.

    Where the session has Spark's default of 10,000 rows for an Arrow batch,
    this sets it to BATCH_ROWS, and it stays so: texts are long, and a batch is
    made when the lazy result runs. A size that the session has set is kept.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that one slice holds about SLICE_BYTES of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def tidied(run):
    """``run``, a step over Arrow batches, that gives freed memory back to the system at its end.

    Python workers outlive their tasks; what the allocators keep would stand
    beside the memory of whatever the executor does next.
    """

    def step(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library than glibc
            pass

    return step


def bare(name: str, taken: list[str]) -> str:
    """A column name that is not among ``taken``."""
    while name.lower() in {x.lower() for x in taken}:
        name = "_" + name
    return name


def same(a, b):
    """Null-safe equality of two columns."""
    return a.eqNullSafe(b)


def text_key(text: str = "text"):
    """With doc_id, this names a document: rows equal in both are one document."""
    return F.xxhash64(F.col(text), F.length(F.col(text)))


def grown(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """A copy of ``schema`` with fields (name, DDL type) at its end; a taken name gets underscores."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out.add(bare(name, out.names), T.DataType.fromDDL(kind))
    return out
