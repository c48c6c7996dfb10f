"""Numbers without gaps over a whole order, and inside keys, however large a key is.

Rows are range-partitioned and sorted once, and staged with their place in
their partition. A partition's rows, and the rows of keys that go on from one
partition to the next, are counted; these few counts carry the numbers on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: monotonically_increasing_id has the partition above this bit and the row in it below.
_BITS = 33


def _sorted(df: DataFrame, order: list[str | Column], partitions: int | None) -> DataFrame:
    """``df`` with _part and _at, the partition and the place in it, of its rows in ``order``."""
    rows = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", _BITS).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_id")
    return staged(rows, "numbered")


def numbered(df: DataFrame, order: list[str | Column], name: str = "id", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the number of its row in ``order``, from 0 and without gaps.

    Rows that tie may come in any order. Nulls come first. An empty table stays empty.
    """
    rows = _sorted(df, order, partitions)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def ranked(df: DataFrame, key: str, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the number of its row among those of its ``key`` in ``order``, from 0 and without gaps.

    A key with many rows takes many partitions: ranks are counted inside a
    partition and carried on by the counts of the keys at partitions' edges, two
    for each partition. A null key is a key like any other.
    """
    rows = _sorted(df, [key, *order], partitions)
    edge = F.col("_k").eqNullSafe(F.col("_low")) | F.col("_k").eqNullSafe(F.col("_high"))
    ends = rows.groupBy("_part").agg(F.min_by(F.struct(F.col(key).alias("k")), "_at").alias("_a"), F.max_by(F.struct(F.col(key).alias("k")), "_at").alias("_b"))
    ends = ends.select("_part", F.col("_a.k").alias("_low"), F.col("_b.k").alias("_high"))
    # only keys at an edge can go on in another partition
    at_edges = rows.select("_part", F.col(key).alias("_k")).join(F.broadcast(ends), "_part").where(edge).groupBy("_part", "_k").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = at_edges.select(F.col("_part").alias("_p"), "_k", before.alias("_before")).where("_before > 0")
    inside = F.row_number().over(Window.partitionBy("_part", key).orderBy("_at")) - 1
    out = rows.withColumn("_i", inside)
    out = out.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.withColumn(name, F.col("_i") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_i", "_p", "_k", "_before")


def dictionary(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(value, id): the distinct values of a column that aren't null, numbered from 0 in their order."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, ["value"], "id", partitions)
