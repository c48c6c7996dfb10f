"""Validation: a rule for each field, a verdict for each value, a summary for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, text_or_empty
from . import schemas

MISSING, OPTIONAL = "Required field missing", "Optional field missing"
NO_SCHEMA = "Document type is unknown, so validation could not run."


def _strip(c: Column, what: str) -> Column:
    return F.regexp_replace(c, what, "")


def is_date(v: Column) -> Column:
    """A real calendar day as d/M/y, d-M-y, d.M.y or y-M-d, blanks beside separators aside."""
    t = F.regexp_replace(v, r"(?U)\s*([/.-])\s*", "$1")
    return let(t, _is_date)


def _is_date(t: Column) -> Column:
    shaped = t.rlike(r"^\d{1,2}([/.-])\d{1,2}\1\d{4}$") | t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    days = [F.try_to_date(t, f) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")]
    return shaped & F.coalesce(*days).isNotNull()


def _digits(n: int, blanks: str = r"(?U)[\s\-]+"):
    return lambda v: _strip(v, blanks).rlike(rf"(?U)^\d{{{n}}}$")


def _some_digits(v: Column) -> Column:
    return v.rlike(r"(?U)\d")


def _plain(v: Column) -> Column:
    return F.upper(_strip(F.upper(v), "[^A-Z0-9]"))


def _count(low: int, high: int):
    return lambda v: F.length(_strip(v, r"(?U)\D")).between(low, high)


#: Fields with a format: the test of a value that isn't empty, and what is said if it fails.
CHECKS = {
    "email": (lambda v: _strip(F.lower(v), r"(?U)\s+").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "Invalid email format"),
    "pincode": (_digits(6), "Pincode must be exactly 6 digits"),
    "date_of_birth": (is_date, "Invalid date format or value"),
    "date_of_joining": (is_date, "Invalid date format or value"),
    "account_opened": (is_date, "Invalid date format or value"),
    "date_of_issue": (is_date, "Invalid date format or value"),
    "employee_id": (lambda v: v.rlike("^[A-Za-z0-9_-]+$"), "Employee ID must contain only letters, numbers, hyphens or underscores"),
    "aadhaar_number": (_digits(12), "Aadhaar number must have exactly 12 digits"),
    "vid": (_digits(16), "VID must have exactly 16 digits"),
    "pan_number": (lambda v: _plain(v).rlike(r"^[A-Z]{5}\d{4}[A-Z]$"), "PAN number must match format AAAAA9999A"),
    "ifsc": (lambda v: _plain(v).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "IFSC must match format AAAA0999999"),
    "micr": (_count(9, 9), "MICR must have exactly 9 digits"),
    "account_number": (_count(9, 18), "Account number must have 9 to 18 digits"),
    "cif_number": (_some_digits, "CIF number must contain digits"),
    "nom_reg_no": (_some_digits, "Nomination registration number must contain digits"),
    "branch_code": (_some_digits, "Branch code must contain digits"),
    "branch_manager_stamp_present": (lambda v: F.lower(v).isin("true", "false", "yes", "no", "present", "missing"), "Value must be boolean-like"),
    "total": (lambda v: F.trim(_strip(F.replace(v, F.lit(","), F.lit("")), "^[A-Za-z$]+")).rlike(r"^\d+(?:\.\d{2})?$"), "Total must be a valid amount"),
}


def format_error(field: Column, value: Column) -> Column:
    """What is wrong with a value that isn't empty; empty if nothing."""
    number = _strip(value, r"(?U)[\s\-().]+")
    mobile = F.when(~number.rlike(r"(?U)^\d+$"), "Mobile number must contain only digits").when(F.length(number) != 10, "Mobile number must have exactly 10 digits")
    out = F.when(field == "mobile_number", F.coalesce(mobile, F.lit("")))
    for name, (test, said) in CHECKS.items():
        out = out.when(field == name, F.when(test(value), "").otherwise(said))
    return out.otherwise("")


def checked(field: Column, value: Column) -> Column:
    """The text that is validated: lists as lines joined by blanks, a false flag as nothing."""
    v = F.trim(F.regexp_replace(text_or_empty(value), r"^(?U)\s+|(?U)\s+$", ""))
    return F.when(field.isin(*schemas.FLAGS) & (v == "False"), "").when(field.isin(*schemas.LISTS), F.regexp_replace(v, "\n", " ")).otherwise(v)


def verdict(field: Column, value: Column, required: Column) -> Column:
    """struct<valid, error, warning> of one value."""

    def said(v: Column) -> Column:
        error = F.when((v == "") & required, MISSING).when(v == "", "").otherwise(format_error(field, v))
        warning = F.when((v == "") & ~required, OPTIONAL).otherwise("")
        return let(error, lambda e: F.struct((e == "").alias("valid"), e.alias("error"), warning.alias("warning")))

    return let(checked(field, value), said)


def expected(kind: Column) -> Column:
    """array<struct<field, required>> of a type, in rule order; null for an unknown type."""
    by_type = []
    for t, own in schemas.schemas().items():
        entries = [F.struct(F.lit(f).alias("field"), F.lit(need).alias("required")) for f, need, _ in sorted(own, key=lambda x: not x[1])]
        by_type += [F.lit(t), F.array(*entries)]
    return F.try_element_at(F.create_map(*by_type), kind)


def verdicts(kind: Column, values: Column) -> Column:
    """array<struct<field, required, value, v>> of a record: its expected fields and their verdicts.

    The rules are a literal and the record is one row, so nothing is shuffled.
    The record is bound once, and so is each value: inside a function over the
    rules they would be made again for every rule.
    """

    def one(r: Column, record: Column) -> Column:
        said = lambda value: F.struct(r["field"].alias("field"), r["required"].alias("required"), value.alias("value"), verdict(r["field"], value, r["required"]).alias("v"))
        return let(text_or_empty(F.try_element_at(record, r["field"])), said)

    return let(values, lambda record: F.transform(expected(kind), lambda r: one(r, record)))


def validate(records: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """A row for each field that the rules of a record's type expect, in rule order.

    ``records`` has ``keys``, type and values (map of field to text). Fields
    without rules are dropped, missing ones are empty. Records of unknown type
    give no rows.
    """
    # outer: else Spark asks for the size of all verdicts first, and so makes them three times
    rows = records.select(*keys, "type", F.posexplode_outer(verdicts(F.col("type"), F.col(values))).alias("rule_ord", "r")).where("rule_ord is not null")
    return rows.select(*keys, "type", "r.field", "r.required", "rule_ord", "r.value", "r.v.valid", "r.v.error", "r.v.warning")


def summary(records: DataFrame, values: str = "values") -> DataFrame:
    """``records`` with total_fields, valid_fields, invalid_fields, warnings, ready, review, note.

    Unknown types check nothing and need a review.
    """
    out = records.withColumn("_v", verdicts(F.col("type"), F.col(values)))
    known = F.col("_v").isNotNull()
    count = lambda test: F.when(known, F.size(F.filter("_v", test))).otherwise(0)
    out = out.withColumns({"total_fields": F.when(known, F.size("_v")).otherwise(0), "invalid_fields": count(lambda x: ~x["v"]["valid"]), "warnings": count(lambda x: x["v"]["warning"] != "")})
    out = out.withColumn("valid_fields", F.col("total_fields") - F.col("invalid_fields"))
    out = out.withColumn("ready", known & (F.col("invalid_fields") == 0))
    return out.withColumn("review", ~F.col("ready")).withColumn("note", F.when(known, "").otherwise(NO_SCHEMA)).drop("_v")
