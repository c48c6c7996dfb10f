"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: without one Spark and readers in tasks may mean different places."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", full)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; a local one only where that is unset (tests, one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of the sources that a task gets of rows that cost much.
SHARE = 2 << 20


def spread(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if its ``sources`` are too small to be cut into so many splits.

    Rows that cost much (pattern searches, comparisons) would else wait for the
    few tasks that small files give. There is a part for each SHARE of the
    sources, so a task's work doesn't grow with them. Tables of a split for each
    core or more stay as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = sum(int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for s in sources or (df,))
    return df.repartition(max(cores, -(-size // SHARE))) if size < cores * split else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and the same again if an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
