"""Whole evaluations: every engine's reading of a family's files, compared with ground truth, and the reports.

An engine gives a file's text, the pages of a PDF parted by form feeds. A
reading is a row all the way; only pages of one file and engines of one image
are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_file_name, text_or_empty
from ..operators import classify, evaluate, ocr_fields, report, review, spans, validate
from ..sources import files, sinks
from ..sources.files import Engines

SCOPES = ("all", "no_llm", "llm_only")
PAGE_END = "\f"
#: A reading, the row that all of this is about.
READING = "image string, path string, side string, model string, text string, error string, seconds double"

#: For each family: the type that its reader finds, the reader, and the side of files that name none.
READERS = {
    "aadhaar": (ocr_fields.card_side, ocr_fields.card, "unknown"),
    "pan": (lambda text, path: F.lit("pan_card"), lambda text, path: ocr_fields.tax_card(text), "unknown"),
    "passbook": (lambda text, path: F.lit("passbook"), lambda text, path: ocr_fields.passbook(text), "front"),
    "invoice": (lambda text, path: F.lit("invoice"), ocr_fields.receipt, "front"),
}


def chosen(primary: list[str], models: list[str], scope: str = "all") -> list[str]:
    """Engines, then language models, as far as the scope goes."""
    return [*([] if scope == "llm_only" else primary), *([] if scope == "no_llm" else models)]


def only(engines: Engines, scope: str) -> Engines:
    """The engines of a scope; language models are those named llm:."""
    out = Engines()
    out.known = {}
    for kind in engines.known:
        names = engines.policy(kind)
        for name in chosen([n for n in names if not n.startswith("llm:")], [n for n in names if n.startswith("llm:")], scope):
            out.register(kind, name, engines.known[kind][name])
    return out


def understood(readings: DataFrame, family: str) -> DataFrame:
    """``readings`` (text, path) with type, confidence and values, by labels and by the family's own reader.

    The reader replaces passbooks and receipts, unknown types and records
    without any value; else its values that aren't empty go over the labelled
    ones. Where the reader finds nothing, the labelled values stay. Null texts
    count as empty; a text that tells nothing is unknown, without values.
    """
    kind_of, reader, _ = READERS[family]
    rows = spans.with_slices(classify.classify(readings))
    text, path = text_or_empty(F.col("text")), F.col("path")
    rows = rows.withColumn("_read", reader(text, path)).withColumn("_kind", kind_of(text, path))
    none = F.lit(None).cast("map<string,string>")
    mapped = F.coalesce(F.when(F.col("type") == "unknown", none).otherwise(F.col("sliced")), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("_own", mapped)
    bare = ~F.exists(F.map_values("_own"), lambda v: F.trim(v) != "")
    replaced = F.col("_read").isNotNull() & (F.col("_kind").isin("passbook", "invoice") | (F.col("type") == "unknown") | bare)
    over = F.map_filter("_read", lambda k, v: v != "")
    kept = F.map_filter("_own", lambda k, v: ~F.array_contains(F.map_keys(over), k))
    rows = rows.withColumn("_replaced", replaced)
    return rows.withColumns(
        {
            "values": F.when(F.col("_replaced"), F.col("_read")).when(F.col("_read").isNotNull(), F.map_concat(kept, over)).otherwise(F.col("_own")),
            "type": F.when(F.col("_replaced"), F.col("_kind")).otherwise(F.col("type")),
            "confidence_percent": F.when(F.col("_replaced"), 100.0).otherwise(F.col("confidence_percent")),
            "confidence_level": F.when(F.col("_replaced"), "high").otherwise(F.col("confidence_level")),
        }
    ).drop("_read", "_kind", "_own", "_replaced")


def compared(readings: DataFrame, truth: DataFrame, family: str) -> DataFrame:
    """A row for each reading and true field, as ``evaluate.compare`` gives it.

    ``readings``: image, path, model, text, error. ``truth``: image, field,
    expected. A reading that failed has no values, so its fields don't match.
    Images without truth give no rows. An image and model that occur twice in
    ``readings`` are for the caller to tell apart.
    """
    fields = validate.validate(understood(readings.where("error = ''"), family), ["image", "model"]).select("image", "model", "field", F.col("value").alias("extracted"))
    wanted = readings.select("image", "model").join(truth, "image")
    return evaluate.compare(evaluate.against_truth(wanted, fields, ["image", "model"]))


def scored(readings: DataFrame, pairs: DataFrame, family: str) -> DataFrame:
    """A report row for each reading: image, side, quality, model, accuracy, seconds, failed, complete.

    ``pairs`` is ``compared``. Readings of images without truth have an accuracy of 0.
    """
    per = evaluate.accuracy(pairs, ["image", "model"])
    rows = readings.join(per, ["image", "model"], "left")
    failed = F.col("error") != ""
    return rows.select(
        "image",
        F.when(F.col("side") == "unknown", READERS[family][2]).otherwise(F.col("side")).alias("side"),
        evaluate.quality_of(F.col("path")).alias("quality"),
        "model",
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.bround("seconds", 4).alias("seconds"),
        failed.alias("failed"),
        (~failed & F.coalesce("complete", F.lit(False))).alias("complete"),
    )


def readable(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """For each document one row: accuracy, counts, and a map of its fields to what was expected and extracted."""
    said = F.struct("expected", "extracted", "match", F.col("used").alias("used_for_accuracy"), F.col("similarity").alias("similarity_percent"), F.nullif("reason", F.lit("")).alias("reason"))
    fields = pairs.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", said.alias("said"))))).alias("fields"))
    counts = evaluate.accuracy(pairs, keys).select(*keys, F.col("accuracy").alias("accuracy_percent"), "matched_fields", F.col("scored_fields").alias("total_fields"))
    return counts.join(fields, keys)


def _key(path: Column, folder: str) -> Column:
    """A file's path below the folder, without its suffix."""
    below = F.element_at(F.split(path, F.lit("\\Q" + folder.rstrip("/") + "/\\E")), -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) of the JSON files of a folder."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return raw.select(_key(F.col("_metadata.file_path"), folder).alias("key"), "value")


def image_truth(raw: DataFrame) -> DataFrame:
    """(key, field, expected) of flat JSON; what isn't an object gives no rows."""
    return raw.select("key", F.explode(F.from_json("value", "map<string,string>")).alias("field", "expected"))


def page_mapping(raw: DataFrame) -> DataFrame:
    """(key, page, label) of the pages that the truth names."""
    return raw.select("key", F.explode(files.page_labels(F.col("value"))).alias("page", "label")).withColumn("page", F.col("page").try_cast("int")).where("page > 0")


def page_truth(raw: DataFrame) -> DataFrame:
    """(key, page, field, expected): for each page the object that its label names."""
    mapped = raw.select("key", "value", F.explode(files.page_labels(F.col("value"))).alias("page", "label")).withColumn("page", F.col("page").try_cast("int")).where("page > 0")
    own = F.from_json(F.expr("get_json_object(value, concat('$.', label))"), "map<string,string>")
    return mapped.select("key", "page", F.explode(own).alias("field", "expected"))


def paged(candidates: DataFrame, mapping: DataFrame, digital: bool) -> DataFrame:
    """Readings of pages: those the truth names (digital), or those that were read (scanned).

    A page the engine did not reach is empty, and an engine's time is shared by
    the pages it read. A failure counts for every page that the truth names.
    """
    texts = F.split("text", PAGE_END)
    rows = candidates.withColumn("texts", texts).withColumn("seconds", F.col("seconds") / F.greatest(F.size("texts"), F.lit(1)))
    named = rows.join(mapping, "key")
    if digital:
        out = named
    else:
        read = rows.where("error = ''").select("*", F.explode(F.sequence(F.lit(1), F.size("texts"))).alias("page")).join(mapping, ["key", "page"], "left")
        out = read.unionByName(named.where("error <> ''"))
    side = F.when(F.col("label").isin("front", "back"), F.col("label")).otherwise("front")
    return out.select(F.concat("path", F.lit("#page="), F.col("page").cast("string")).alias("image"), "key", "page", "path", side.alias("side"), F.col("engine").alias("model"), text_or_empty(F.try_element_at("texts", F.col("page"))).alias("text"), "error", "seconds")


def run(spark: SparkSession, family: str, source: str, truth: str, engines: Engines, out: str, kind: str = "image", digital: bool = False, scope: str = "all") -> dict[str, DataFrame]:
    """Read, compare and report a folder of a family's images or PDFs.

    Writes under ``out``: readings and comparisons (Parquet), results (a JSON
    record for each image, as lines), the same as a file for each image under
    records/<family>/<kind>, and report.xlsx. Returns the report's tables. The
    engines run once, and so does the understanding of what they read: both
    are written first, and all else starts from that.
    """
    if family == "invoice" and digital:
        raise ValueError("invoice has no batch of digital PDFs")
    types = ("png", "jpg") if kind == "image" else ("pdf",)
    used = only(engines, scope)
    models = list(dict.fromkeys(e for t in types for e in used.policy(t)))
    if not models:
        raise ValueError(f"no engine is registered for {kind} files in the scope {scope}")
    found = files.with_type(files.scan(spark, source, recursive=kind != "image")).where(F.col("file_type").isin(*types))
    read = files.read(found, used, keep_empty=True).withColumn("key", _key(F.col("path"), source))
    raw = truths(spark, truth)
    if kind == "image":
        rows = read.select(F.col("path").alias("image"), "key", F.lit(1).alias("page"), "path", evaluate.side_of(F.col("path")).alias("side"), F.col("engine").alias("model"), "text", "error", "seconds")
        facts = image_truth(raw).withColumn("page", F.lit(1))
    else:
        rows, facts = paged(read, page_mapping(raw), digital), page_truth(raw)
    rows.write.mode("overwrite").parquet(f"{out}/readings")
    rows = spark.read.parquet(f"{out}/readings")
    expected = rows.select("image", "key", "page").distinct().join(facts, ["key", "page"]).select("image", "field", "expected")
    compared(rows, expected, family).write.mode("overwrite").parquet(f"{out}/comparisons")
    pairs = spark.read.parquet(f"{out}/comparisons")
    table = scored(rows, pairs, family)
    results(rows, pairs, table).write.mode("overwrite").json(f"{out}/results")
    made = spark.read.text(f"{out}/results").select(F.get_json_object("value", "$.image").alias("image"), F.col("value").alias("body"))
    sinks.write_record_files(named_records(made, family, kind), f"{out.rstrip('/')}/records")
    sheets = report.sheets(table, pairs, models, "invoice" if family == "invoice" else None)
    sinks.write_workbook(f"{out.rstrip('/')}/report.xlsx", sheets)
    return sheets


def named_records(made: DataFrame, family: str, kind: str) -> DataFrame:
    """``made`` (image, body) with document_name, file_format and name: the image's, without suffix, unique and safe."""
    stem = F.regexp_replace(safe_file_name(F.col("image")), r"\.[^.]*?(?=_page_\d+$)|\.[^.]*$", "")
    rows = review.unique_names(made.withColumn("stem", stem), "stem", ["image"])
    return rows.select(F.lit(family).alias("document_name"), F.lit(kind).alias("file_format"), F.col("unique_name").alias("name"), "body")


def results(readings: DataFrame, pairs: DataFrame, table: DataFrame) -> DataFrame:
    """For each image one row: side, quality, and a map of its models to their outcome. Bounded by the engines."""
    said = readable(pairs, ["image", "model"]).withColumn("comparison", F.struct("accuracy_percent", "matched_fields", "total_fields", "fields")).select("image", "model", "comparison")
    rows = table.join(readings.select("image", "model", "text", "error"), ["image", "model"]).join(said, ["image", "model"], "left")
    outcome = F.struct(F.col("comparison").alias("comparison_with_ground_truth"), F.col("text").alias("raw_text"), F.nullif("error", F.lit("")).alias("error"), F.col("seconds").alias("processing_time_seconds"))
    return rows.groupBy("image", "side", "quality").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.to_json(outcome).alias("outcome"))))).alias("models"))
