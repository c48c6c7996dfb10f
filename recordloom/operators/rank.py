"""Competing readings of a document: score them, keep the best, list the attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas

#: What counts, in order; larger is better.
ORDER = ("known", "ready", "valid_fields", "few_invalid", "few_warnings", "confidence_percent", "preference", "filled")


def in_policy_order(policy: tuple[str, ...], available: Column) -> Column:
    """The engines of a policy that are available, in the policy's order."""
    return F.array_intersect(F.array(*[F.lit(e) for e in policy]), available)


def preference(kind: Column, engine: Column) -> Column:
    """How much a type prefers an engine: most for the first, 0 for one not listed."""
    weights = [x for t, own in schemas.ENGINES_BY_TYPE.items() for i, e in enumerate(own) for x in (F.lit(f"{t}/{e}"), F.lit(len(own) - i))]
    return F.coalesce(F.try_element_at(F.create_map(*weights), F.concat_ws("/", kind, engine)), F.lit(0))


def policy(spark: SparkSession) -> DataFrame:
    """(type, engine, place): each type's engines, the preferred one at place 1."""
    rows = [(t, e, i) for t, own in schemas.ENGINES_BY_TYPE.items() for i, e in enumerate(own, 1)]
    return spark.createDataFrame(rows, "type string, engine string, place int")


def available(readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, engine, place, weight): a type's engines in order, as far as they really read the document.

    ``readings`` (key, type, engine, text): an engine counts if any of its
    texts isn't blank. ``place`` is that in the policy among the engines left,
    ``weight`` what ranking gives the engine. Types without a policy give no rows.
    """
    read = readings.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, "type", "engine").distinct()
    own = read.join(F.broadcast(policy(readings.sparkSession)), ["type", "engine"])
    order = Window.partitionBy(key, "type").orderBy("place")
    return own.select(key, "type", "engine", F.row_number().over(order).alias("place"), preference(F.col("type"), F.col("engine")).alias("weight"))


def filled(values: Column) -> Column:
    """The number of fields with a value; a flag counts even when it is false."""
    kept = F.filter(F.map_entries(values), lambda e: e["key"].isin(*schemas.FLAGS) | (F.trim(e["value"]) != ""))
    return F.coalesce(F.size(kept), F.lit(0))


def scored(records: DataFrame) -> DataFrame:
    """``records`` (validated) with score: a struct that orders readings."""
    known = F.col("type") != "unknown"
    return records.withColumn(
        "score",
        F.struct(
            known.alias("known"),
            F.col("ready").alias("ready"),
            F.col("valid_fields").alias("valid_fields"),
            (-F.col("invalid_fields")).alias("few_invalid"),
            (-F.col("warnings")).alias("few_warnings"),
            F.col("confidence_percent").alias("confidence_percent"),
            preference(F.col("type"), F.col("engine")).alias("preference"),
            filled(F.col("values")).alias("filled"),
        ),
    )


def best(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best scored reading of each document; of equals, that of the lowest ordinal.

    A row_number filter over the whole partition lets Spark limit each group
    before the shuffle.
    """
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "ordinal")
    return records.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def attempts(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's readings in order: engine, type, confidence, counts. Bounded by the engines."""
    entry = F.struct("ordinal", "engine", "type", "confidence_percent", "ready", "valid_fields", "invalid_fields", "warnings")
    return records.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("attempts"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """``primary``, and rows of ``fallback`` for the keys that it has none for."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))
