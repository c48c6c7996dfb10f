"""Records that language models return: prompts, and JSON that may be wrapped in talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify, schemas, validate


def model_list(setting: Column, default: list[str]) -> Column:
    """Model names of a comma list, trimmed, or the default; each with the prefix llm:."""
    own = F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    names = F.when(F.size(own) > 0, own).otherwise(F.array(*[F.lit(x) for x in default]))
    return F.transform(names, lambda x: F.when(x.startswith("llm:"), x).otherwise(F.concat(F.lit("llm:"), x)))


def prompt(kind: Column, source: Column, text: Column) -> Column:
    """What a model is asked: the type's exact keys, the rules, and the text if there is one."""
    keys = F.create_map(*[x for t, own in schemas.schemas().items() for x in (F.lit(t), F.lit(", ".join(f for f, _, _ in own)))])
    head = F.format_string("Read the document %s (%s). Return one JSON object with exactly these keys: %s. Use an empty string for what is not there.", source, kind, F.coalesce(F.try_element_at(keys, kind), F.lit("")))
    return F.when(text.isNotNull(), F.concat(head, F.lit("\n\n"), text)).otherwise(head)


def json_object(raw: Column) -> Column:
    """map<string,string> of a response: the whole of it, else from the first { to the last }; null if neither is an object."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = F.when(F.trim(raw).startswith("{"), F.from_json(raw, "map<string,string>"))
    return F.coalesce(whole, F.when(inner != "", F.from_json(inner, "map<string,string>")))


def projected(fields: Column, keys: Column) -> Column:
    """``fields`` cut to ``keys``; missing and null ones are empty."""
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(fields, k), F.lit(""))))


def results(responses: DataFrame) -> DataFrame:
    """``responses`` (type, path, raw) as validated records: the type's own fields, sure of the type.

    A response without a JSON object gives empty fields. A receipt that names
    no source image takes the file's name. Unknown types have null values.
    """
    keys = F.create_map(*[x for t, own in schemas.schemas().items() for x in (F.lit(t), F.array(*[F.lit(f) for f, _, _ in own]))])
    own = projected(F.coalesce(json_object(F.col("raw")), F.create_map().cast("map<string,string>")), F.try_element_at(keys, F.col("type")))
    rows = classify.forced(responses, F.col("type")).withColumn("values", own)
    name, unnamed = F.element_at(F.split("path", "/"), -1), F.coalesce(F.trim(F.try_element_at("values", F.lit("source_image"))), F.lit("")) == ""
    others = F.map_filter("values", lambda k, v: k != "source_image")
    filled = F.when((F.col("type") == "invoice") & unnamed, F.map_concat(others, F.create_map(F.lit("source_image"), name))).otherwise(F.col("values"))
    return validate.summary(rows.withColumn("values", filled))
