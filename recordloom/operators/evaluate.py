"""Readings against ground truth, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount_key, date_key, let, plain_key, text_or_empty, tokens
from .similarity import sequence_ratio

# How fields are compared, and what is metadata.
FUZZY = (
    "name hindi_name address hindi_address hindi_address_lines father_name husband_name care_of hindi_father_name hindi_husband_name"
    " hindi_care_of bank_name hindi_bank_name branch_name account_holder account_type relationship_label mop continuation company"
).split()
DATES = ("date_of_birth", "account_opened", "date_of_issue", "date")
METADATA = ("source_image", "pdf_type", "pages")
# Words of file names that tell the quality, in the order of search.
QUALITIES = (
    "clean_digital rotated_page skewed_text cropped_page partial_content low_contrast_text jpeg_heavy_compression low_resolution"
    " mobile_photo partial_crop overexposed low_light blurred shadow skewed cropped rotated clean"
).split()


def token_recall(extracted: Column, expected: Column) -> Column:
    """The share of the expected distinct tokens that were extracted; 0 if either has none."""
    a, b = F.array_distinct(tokens(extracted)), F.array_distinct(tokens(expected))
    return let(b, lambda b: F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0))


def with_similarity(pairs: DataFrame, fuzzy_only: bool = True) -> DataFrame:
    """``pairs`` (field, extracted, expected) with similarity 0 to 100 of fuzzy fields, null for others.

    Tokens are looked at for fuzzy fields alone. The sequence ratio runs in
    Python, in the same pass over the rows; only texts of rows that need it go
    there: fuzzy fields with tokens on both sides whose recall isn't whole
    already. Of the others it sees nulls.
    """
    asked = F.col("field").isin(*FUZZY) if fuzzy_only else F.lit(True)
    words = lambda c: F.when(asked, tokens(F.col(c)))
    rows = pairs.withColumn("_t", F.struct(words("extracted").alias("a"), words("expected").alias("b")))
    a, b = F.array_distinct("_t.a"), F.array_distinct("_t.b")
    rows = rows.withColumn("_r", F.when(F.size("_t.a") * F.size("_t.b") > 0, F.size(F.array_intersect(a, b)) / F.size(b)).when(asked, 0.0))
    asks = F.coalesce((F.col("_r") < 1) & (F.size("_t.a") > 0) & (F.size("_t.b") > 0), F.lit(False))
    said = F.when(asks, F.struct(F.array_join("_t.a", " ").alias("a"), F.array_join("_t.b", " ").alias("b")))
    rows = rows.withColumn("_s", F.coalesce(sequence_ratio(said["a"], said["b"]), F.lit(0.0)))
    return rows.withColumn("similarity", F.bround(F.greatest("_r", "_s") * 100, 2)).withColumn("similarity", F.when(F.col("_r").isNotNull(), F.col("similarity"))).drop("_t", "_r", "_s")


def exact_match(field: Column, extracted: Column, expected: Column) -> Column:
    """Whether a field that isn't fuzzy agrees, by the key of its kind."""
    base = lambda c: F.lower(F.element_at(F.split(text_or_empty(c), "/"), -1))
    flag = F.lower(F.trim(text_or_empty(extracted))).isin("true", "yes", "present", "1")
    return (
        F.when(field.isin(*DATES), date_key(extracted) == date_key(expected))
        .when(field == "total", amount_key(extracted) == amount_key(expected))
        .when(field == "source_image", base(extracted) == base(expected))
        .when(field == "branch_manager_stamp_present", flag == (text_or_empty(expected) != ""))
        .otherwise(plain_key(extracted) == plain_key(expected))
    )


def is_present(expected: Column) -> Column:
    """A truth worth scoring: not null, blank, false or an empty list."""
    return F.coalesce(~F.trim(expected).isin("", "False", "false", "[]", "{}"), F.lit(False))


def compare(pairs: DataFrame) -> DataFrame:
    """``pairs`` (field, extracted, expected) with used, reason, match and similarity.

    Metadata and fields without truth aren't scored. Names and addresses match
    from a similarity of 80 (addresses 65) on; others match by key, with
    similarity 100 or 0.
    """
    fuzzy, meta = F.col("field").isin(*FUZZY), F.col("field").isin(*METADATA)
    used = ~meta & is_present(F.col("expected"))
    rows = pairs.withColumn("extracted", text_or_empty(F.col("extracted"))).withColumn("used", used)
    rows = rows.withColumn("reason", F.when(meta, "metadata field").when(~F.col("used"), "ground truth value not present").otherwise(""))
    # keys of what isn't fuzzy, bound once
    rows = rows.withColumn("_m", F.when(F.col("used") & ~fuzzy, exact_match(F.col("field"), F.col("extracted"), F.col("expected"))))
    rows = with_similarity(rows)
    near = F.col("similarity") >= F.when(F.col("field") == "address", 65).otherwise(80)
    rows = rows.withColumn("match", F.col("used") & F.when(fuzzy, near).otherwise(F.coalesce("_m", F.lit(False))))
    share = F.when(fuzzy, F.col("similarity")).otherwise(F.when(F.col("_m"), 100.0).otherwise(0.0))
    return rows.withColumn("similarity", F.when(F.col("used"), share)).drop("_m")


def accuracy(compared: DataFrame, keys: list[str]) -> DataFrame:
    """For each document: matched and scored fields, accuracy in percent, whether all match."""
    out = compared.groupBy(*keys).agg(F.count_if("match").alias("matched_fields"), F.count_if("used").alias("scored_fields"))
    share = F.when(F.col("scored_fields") > 0, F.col("matched_fields") / F.col("scored_fields") * 100).otherwise(0.0)
    return out.withColumn("accuracy", F.bround(share, 2)).withColumn("complete", (F.col("scored_fields") > 0) & (F.col("matched_fields") == F.col("scored_fields")))


def against_truth(truth: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """Truth (keys, field, expected) beside readings (keys, field, extracted); fields not read are empty."""
    return truth.join(readings, [*keys, "field"], "left").withColumn("extracted", text_or_empty(F.col("extracted")))


def merged_with_fallback(kind: Column, values: Column, fallback: Column) -> Column:
    """What the family's own extractor adds to the mapped values.

    It replaces passbooks and invoices, unknown types and empty records; else
    its values that aren't empty override.
    """
    empty = F.coalesce(~F.exists(F.map_values(values), lambda v: F.trim(v) != ""), F.lit(True))
    some = F.map_filter(fallback, lambda k, v: F.trim(v) != "")
    kept = F.map_filter(values, lambda k, v: ~F.array_contains(F.map_keys(some), k))
    return F.when(kind.isin("passbook", "invoice", "unknown") | empty, fallback).otherwise(F.map_concat(kept, some))


def quality_of(path: Column) -> Column:
    """The first quality word in a file's name, else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(name.contains(QUALITIES[0]), QUALITIES[0])
    for q in QUALITIES[1:]:
        out = out.when(name.contains(q), q)
    return out.otherwise("unknown")


def side_of(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("front"), "front").when(name.contains("back"), "back").otherwise("unknown")
