"""Reports over scored readings: (image, side, quality, model, accuracy, seconds, failed, complete) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def averages(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean accuracy (a missing score counts as 0) and mean time (a missing one doesn't count) of each model."""
    return rows.groupBy(*by, "model").agg(
        F.countDistinct("image").alias("images"),
        F.bround(F.avg(F.coalesce("accuracy", F.lit(0.0))), 2).alias("accuracy"),
        F.coalesce(F.bround(F.avg("seconds"), 4), F.lit(0.0)).alias("seconds"),
    )


def quality_summary(rows: DataFrame) -> DataFrame:
    """For each quality: best and worst model by accuracy, fastest and slowest by time, names breaking ties.

    The worst and the slowest are the last of the same order, so among equals
    they are the alphabetically last.
    """
    per = averages(rows.withColumn("quality", F.coalesce(F.nullif("quality", F.lit("")), F.lit("unknown"))), ["quality"])
    score, time = F.struct(-F.col("accuracy"), "model"), F.struct("seconds", "model")
    out = per.groupBy("quality").agg(
        F.max("images").alias("images"),
        F.min_by("model", score).alias("best_model"),
        F.max("accuracy").alias("best_accuracy"),
        F.max_by("model", score).alias("worst_model"),
        F.min("accuracy").alias("worst_accuracy"),
        F.min_by("model", time).alias("fastest_model"),
        F.min("seconds").alias("fastest_seconds"),
        F.max_by("model", time).alias("slowest_model"),
        F.max("seconds").alias("slowest_seconds"),
    )
    return out.withColumn("accuracy_difference", F.bround(F.col("best_accuracy") - F.col("worst_accuracy"), 2))


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Means by side and by quality in one table, from one scan with grouping sets."""
    named = rows.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("side", "quality")})
    sets = named.groupingSets([["side", "model"], ["quality", "model"]], "side", "quality", "model")
    out = sets.agg(
        F.grouping("side").alias("g"),
        F.countDistinct("image").alias("images"),
        F.bround(F.avg(F.coalesce("accuracy", F.lit(0.0))), 2).alias("accuracy"),
        F.coalesce(F.bround(F.avg("seconds"), 4), F.lit(0.0)).alias("seconds"),
    )
    group = F.when(F.col("g") == 0, "document side").otherwise("image quality category")
    return out.select(group.alias("group_name"), F.when(F.col("g") == 0, F.col("side")).otherwise(F.col("quality")).alias("value"), "model", "images", "accuracy", "seconds")


def field_summary(compared: DataFrame) -> DataFrame:
    """For each scored field and model: accuracy, mean similarity, and the most readings any model had."""
    per = compared.where("used").groupBy("field", "model").agg(
        F.bround(F.avg(F.col("match").cast("int")) * 100, 2).alias("accuracy"),
        F.bround(F.avg("similarity"), 2).alias("similarity"),
        F.count("*").alias("n"),
    )
    return per.withColumn("evaluated", F.max("n").over(Window.partitionBy("field"))).drop("n")


def model_summary(rows: DataFrame) -> DataFrame:
    """For each model: readings, means of the scores and times there are, failures, complete records and their rate."""
    out = rows.groupBy("model").agg(
        F.count("*").alias("images"),
        F.coalesce(F.bround(F.avg("accuracy"), 2), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.bround(F.avg("seconds"), 4), F.lit(0.0)).alias("seconds"),
        F.count_if("failed").alias("failures"),
        F.count_if("complete").alias("complete"),
    )
    return out.withColumn("complete_rate", F.bround(F.col("complete") / F.col("images") * 100, 2))


def pivoted(rows: DataFrame, models: list[str]) -> DataFrame:
    """A row for each image with a column for each model's accuracy."""
    return rows.groupBy("image").pivot("model", models).agg(F.first("accuracy"))


def sheets(rows: DataFrame, compared: DataFrame, models: list[str], profile: str | None = None) -> dict[str, DataFrame]:
    """The report's tables by name; receipts have a profile of their own."""
    if profile == "invoice":
        return {"accuracy": pivoted(rows, models), "field_accuracy": field_summary(compared), "summary": model_summary(rows)}
    return {
        "accuracy": pivoted(rows, models),
        "quality_front": quality_summary(rows.where("side = 'front'")),
        "quality_back": quality_summary(rows.where("side = 'back'")),
        "summary": accuracy_summary(rows),
    }
