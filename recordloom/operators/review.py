"""Human review: edits over extracted fields, the latest review, and what needs a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import title_label
from .numbering import ranked

# Groups of fields by what their names contain, in the order of search.
GROUPS = {
    "Identity": ("name", "employee", "aadhaar", "pan_number", "gender", "relationship", "father", "husband", "care_of"),
    "Dates": ("date", "birth", "joining", "opened", "issue", "year"),
    "Address": ("address", "pincode", "city", "state"),
    "Bank": ("bank", "branch", "ifsc", "micr", "account", "cif", "mop", "nom", "phone", "email"),
    "Invoice": ("company", "receipt", "subtotal", "tax", "discount", "total", "currency", "source"),
    "Review": ("signature", "continuation", "stamp", "vid", "mobile"),
}

# The fields that a type's page shows even when they are empty.
_FRONT = "aadhaar_number vid name hindi_name date_of_birth year_of_birth gender".split()
_BACK = (
    "aadhaar_number vid relationship_label care_of father_name husband_name hindi_relationship_label hindi_care_of hindi_father_name"
    " hindi_husband_name address hindi_address hindi_address_lines pincode"
).split()
DISPLAYED = {"aadhaar_front": _FRONT, "aadhaar_back": _BACK, "aadhaar_full": list(dict.fromkeys(_FRONT + _BACK))}


def field_group(field: Column) -> Column:
    out = None
    for name, parts in GROUPS.items():
        hit = field.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def overlay(fields: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``fields`` (keys, field, value) with the values of ``edits`` (keys, field, edited) over them, and edited flags."""
    rows = fields.join(edits.withColumn("_e", F.lit(True)), [*keys, "field"], "left")
    value = F.when(F.col("_e"), F.col("edited")).otherwise(F.col("value"))
    return rows.select(*keys, "field", F.col("value").alias("original"), value.alias("value"), (~value.eqNullSafe(F.col("value"))).alias("is_edited"))


def latest(reviews: DataFrame, key: str = "file_name") -> DataFrame:
    """The last review of each file; of reviews at one time, the one of the highest id."""
    order = Window.partitionBy(key).orderBy(F.col("reviewed_at").desc(), F.col("review_id").desc())
    return reviews.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def needs_look(validated: DataFrame) -> DataFrame:
    """Fields that are edited, invalid or warned about."""
    return validated.where("is_edited or not valid or warning <> ''")


def displayed_fields(spark: SparkSession) -> DataFrame:
    """(type, field): what DISPLAYED says, as a relation."""
    return spark.createDataFrame([(t, f) for t, own in DISPLAYED.items() for f in own], "type string, field string")


def projection(fields: DataFrame) -> DataFrame:
    """The rows of ``fields`` (type, field, value and others) that a page shows, with label, group and group_order.

    A type with a list of displayed fields shows those, and others only if they
    have a value; other types show all. Groups have the order of GROUPS, what
    is in none comes last. One pass: the list is a constant of this package.
    """
    listed = F.broadcast(displayed_fields(fields.sparkSession).withColumn("_listed", F.lit(True)))
    rows = fields.join(listed, ["type", "field"], "left")
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    shown = rows.where(F.col("_listed") | ~F.coalesce(F.col("type").isin(*DISPLAYED), F.lit(False)) | filled).drop("_listed")
    order = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("field_group"))
    shown = shown.withColumn("field_group", field_group(F.col("field"))).withColumn("group_order", F.when(order > 0, order).otherwise(len(GROUPS) + 1).cast("int"))
    return shown.withColumn("label", title_label(F.col("field")))


def shown_counts(shown: DataFrame, keys: list[str]) -> DataFrame:
    """For each document of ``projection``'s rows (with valid, warning, is_edited): how many fields are shown, ready, invalid, warned about, and need a look."""
    warned, invalid = F.coalesce(F.col("warning") != "", F.lit(False)), ~F.coalesce("valid", F.lit(True))
    return shown.groupBy(*keys).agg(
        F.count("*").alias("checked"),
        F.count_if(F.coalesce("valid", F.lit(False))).alias("ready_fields"),
        F.count_if(invalid).alias("invalid_fields"),
        F.count_if(warned).alias("warnings"),
        F.count_if(F.col("is_edited") | invalid | warned).alias("to_review"),
    )


def unique_names(files: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``files`` with unique_name: later ones of equal names get _1, _2 and so on before the suffix.

    Ranks are carried from partition to partition, so one name on all rows is no single task.
    """
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    rows = ranked(files, name, order, "_n")
    return rows.withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), suffix))).drop("_n")


def highlights(text: Column, query: str) -> Column:
    """Places (from 1) of a word in a text, whatever the case."""
    low, q = F.lower(text), query.lower()
    parts = F.split(low, F.lit("\\Q" + q + "\\E").cast("string"))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("p"))
    step = lambda a, x: F.struct(F.concat(a["at"], F.array(a["p"] + F.length(x))).alias("at"), (a["p"] + F.length(x) + len(q)).alias("p"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["at"]
