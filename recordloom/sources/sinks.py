"""Results on their way out: JSON records, reviewed records, workbooks."""

from __future__ import annotations

import json
from functools import reduce
from itertools import islice, product
from string import ascii_uppercase
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import classify, validate
from ..operators.numbering import dictionary, numbered
from ..staging import staged
from . import writers

# The file format's names and wrappers, its last row, and what XML can't hold.
_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STRINGS = '<?xml version="1.0" encoding="UTF-8"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
_PART = "application/vnd.openxmlformats-officedocument.spreadsheetml"
LAST_ROW = 1 << 20
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def final_json(values: str = "values", verdicts: Column | None = None) -> Column:
    """One JSON text of a validated record: what was extracted, and the verdicts and counts."""
    results = validate.verdicts(F.col("type"), F.col(values)) if verdicts is None else verdicts
    extracted = F.struct("type", "confidence_percent", "confidence_level", F.col(values).alias("fields"))
    counts = F.struct("total_fields", "valid_fields", "invalid_fields", "warnings", "ready", "review", "note")
    return F.to_json(F.struct(extracted.alias("extracted_output"), F.struct(counts.alias("summary"), results.alias("field_results")).alias("validation")))


def response(values: str = "values", attempts: Column | None = None, deleted: Column | None = None, output: Column | None = None) -> Column:
    """One JSON text of a validated reading as a caller of the service gets it: record, verdicts, engine, attempts."""
    counts = F.struct("total_fields", "valid_fields", "invalid_fields", "warnings", "ready", "review", "note")
    results = validate.verdicts(F.col("type"), F.col(values))
    return F.to_json(
        F.struct(
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "file_type",
            F.col("type").alias("document_type"),
            "confidence_percent",
            "confidence_level",
            F.col(values).alias("fields"),
            F.struct(counts.alias("summary"), results.alias("field_results")).alias("validation"),
            F.coalesce("text", F.lit("")).alias("raw_text"),
            F.coalesce("engine", F.lit("unknown")).alias("extraction_engine"),
            F.coalesce("method", F.lit("unknown")).alias("extraction_method"),
            (F.array().cast("array<string>") if attempts is None else attempts).alias("extraction_attempts"),
            (F.lit(False) if deleted is None else deleted).alias("uploaded_file_deleted"),
            (F.lit("") if output is None else output).alias("output_path"),
        )
    )


def reviewed(edits: DataFrame, values: str = "values") -> DataFrame:
    """Corrected records (file_name, type, values) validated again and stamped; unknown types are not sure at all."""
    rows = validate.summary(classify.forced(edits, F.col("type")), values)
    return rows.withColumn("reviewed_at", F.current_timestamp())


def write_records(records: DataFrame, folder: str, by: tuple[str, ...] = ("document_name", "file_format")) -> None:
    """Records as JSON lines in a folder for each document family and file format."""
    records.write.mode("overwrite").partitionBy(*by).json(folder)


def column_name(n: int) -> str:
    """A, B ... Z, AA ... of column n, from 1: of the names of one length, in order of the alphabet, the n-th."""
    width, before = 1, 0
    while n > before + len(ascii_uppercase) ** width:
        before += len(ascii_uppercase) ** width
        width += 1
    return "".join(next(islice(product(ascii_uppercase, repeat=width), n - before - 1, None)))


def _xml(c: Column) -> Column:
    """A text as XML content; characters that XML has no place for become U+FFFD."""
    out = F.regexp_replace(c, NO_XML, "\ufffd")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _sheet_rows(member: str, frame: DataFrame, words: DataFrame) -> DataFrame:
    """(member, n, xml) of a sheet's rows and its heading, texts as ids of ``words`` (value, id)."""
    names = [f"c{i}" for i in range(len(frame.columns))]
    kinds = [f.dataType for f in frame.schema.fields]
    rows = numbered(frame.toDF(*names), names, "n").withColumn("n", F.col("n") + 2)
    heading = frame.sparkSession.createDataFrame([tuple(frame.columns)], ", ".join(f"{x} string" for x in names)).withColumn("n", F.lit(1).cast("long"))
    made = []
    for part, texts in ((heading, [True] * len(names)), (rows, [not _is_number(k) for k in kinds])):
        cells = []
        for i, (x, is_text) in enumerate(zip(names, texts)):
            at = F.concat(F.lit(f'<c r="{column_name(i + 1)}'), F.col("n").cast("string"))
            if is_text:
                part = part.join(words.select(F.col("value").alias(f"v{i}"), F.col("id").alias(f"i{i}")), F.col(x).cast("string") == F.col(f"v{i}"), "left")
                cell = F.concat(at, F.lit('" t="s"><v>'), F.col(f"i{i}").cast("string"), F.lit("</v></c>"))
            else:
                cell = F.concat(at, F.lit('"><v>'), F.col(x).cast("string"), F.lit("</v></c>"))
            cells.append(F.coalesce(cell, F.lit("")))
        xml = F.concat(F.lit('<row r="'), F.col("n").cast("string"), F.lit('">'), *cells, F.lit("</row>"))
        made.append(part.select(F.lit(member).alias("member"), "n", xml.alias("xml")))
    return made[0].unionByName(made[1])


def shared_strings(sheets: list[DataFrame]) -> DataFrame:
    """(value, id): every text and heading of the sheets once, numbered from 0 in their order."""
    values = []
    for frame in sheets:
        texts = [F.col(f"`{f.name}`").cast("string") for f in frame.schema.fields if not _is_number(f.dataType)]
        if texts:
            values.append(frame.select(F.explode(F.array(*texts)).alias("value")))
        values.append(frame.sparkSession.createDataFrame([(c,) for c in frame.columns], "value string"))
    return dictionary(reduce(DataFrame.unionByName, values), "value")


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """A workbook with a sheet for each report: numbers as numbers, texts as ids of one table of strings.

    ``path`` is local or an address that pyarrow knows (hdfs, s3, gs). Rows
    stand in the order of their columns, left to right, and are made, numbered
    and compressed by tasks; the driver only joins their files. A sheet of more
    rows than the format can hold is refused.
    """
    frames = {f"xl/worksheets/sheet{n}.xml": staged(frame, "sheet") for n, frame in enumerate(sheets.values(), 1)}
    for name, frame in zip(sheets, frames.values()):
        if frame.count() >= LAST_ROW:
            raise ValueError(f"sheet {name!r} has more than {LAST_ROW - 1} rows")
    words = staged(shared_strings(list(frames.values())), "strings")
    texts = words.select(F.lit("xl/sharedStrings.xml").alias("member"), F.col("id").alias("n"), F.concat(F.lit('<si><t xml:space="preserve">'), _xml(F.col("value")), F.lit("</t></si>")).alias("xml"))
    rows = reduce(DataFrame.unionByName, [_sheet_rows(m, f, words) for m, f in frames.items()], texts)
    ids = range(1, len(sheets) + 1)
    override = '<Override PartName="/xl/{}" ContentType="' + _PART + '.{}+xml"/>'
    types = "".join(override.format(f"worksheets/sheet{n}.xml", "worksheet") for n in ids) + override.format("sharedStrings.xml", "sharedStrings")
    link = '<Relationship Id="r{}" Type="' + _OFFICE + '/{}" Target="{}"/>'
    links = "".join(link.format(n, "worksheet", f"worksheets/sheet{n}.xml") for n in ids) + link.format(len(sheets) + 1, "sharedStrings", "sharedStrings.xml")
    named = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1))
    members = {
        "[Content_Types].xml": (_TYPES + types + "</Types>", ""),
        "_rels/.rels": (_RELS + link.format(1, "officeDocument", "xl/workbook.xml") + "</Relationships>", ""),
        "xl/_rels/workbook.xml.rels": (_RELS + links + "</Relationships>", ""),
        "xl/workbook.xml": (f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>', ""),
        **{m: (_SHEET, "</sheetData></worksheet>") for m in frames},
        "xl/sharedStrings.xml": (_STRINGS, "</sst>"),
    }
    writers.register(rows.sparkSession)
    rows = rows.repartitionByRange("member", "n").sortWithinPartitions("member", "n")
    rows.write.format("recordloom_workbook").mode("append").option("path", path).option("members", json.dumps(members)).save()


def write_record_files(records: DataFrame, path: str) -> None:
    """Each of ``records`` (document_name, file_format, name, body) as the file document_name/file_format/name.json under ``path``.

    Names are expected to be safe and unique in their folder
    (``review.unique_names``); a file of that name from before is replaced.
    """
    writers.register(records.sparkSession)
    rows = records.select(F.concat_ws("/", "document_name", "file_format").alias("folder"), F.concat("name", F.lit(".json")).alias("name"), F.coalesce("body", F.lit("null")).alias("body"))
    rows.write.format("recordloom_records").mode("append").option("path", path).save()


def reviewed_json(fields: str = "values", attempts: Column | None = None) -> Column:
    """One JSON text of a reviewed record: what was corrected, its verdicts, and how it was read, with all attempts."""
    counts = F.struct("total_fields", "valid_fields", "invalid_fields", "warnings", "ready", "review", "note")
    output = F.struct("file_name", "file_type", F.col("type").alias("document_type"), "confidence_percent", "confidence_level", F.col(fields).alias("fields"))
    read = F.struct("engine", "method", (F.array().cast("array<string>") if attempts is None else attempts).alias("attempts"))
    verdicts = F.struct(counts.alias("summary"), validate.verdicts(F.col("type"), F.col(fields)).alias("field_results"))
    return F.to_json(F.struct(output.alias("reviewed_output"), verdicts.alias("validation"), read.alias("extraction")))
