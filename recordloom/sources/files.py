"""Files as rows: scan, type by content, text by engine."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import schemas

#: An engine reads one file's bytes and gives its text, or raises.
Engine = Callable[[bytes], str]

# What is said of a name that can't be looked up.
NO_NAME, NO_FILE = "Please enter a file name.", "File not found in uploads folder: "

CANDIDATE = "path string, file_type string, engine string, ordinal int, method string, text string, error string, seconds double"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files under ``path``, in no order."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def requested(requests: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """Each row of ``requests`` with the path, length and content of the file it names in ``folder``, or an error.

    Names are trimmed, and looked up right below the folder. A blank or null
    name and one that isn't there are errors of their rows, not of the job.
    """
    asked = requests.withColumn(name, F.trim(F.coalesce(F.col(name), F.lit(""))))
    found = scan(requests.sparkSession, folder, recursive=False).select(F.col("_metadata.file_name").alias("_name"), "path", "length", "content")
    rows = asked.join(found, F.col(name) == F.col("_name"), "left").drop("_name")
    absent = F.concat(F.lit(NO_FILE), F.col(name))
    return rows.withColumn("error", F.when(F.col(name) == "", NO_NAME).when(F.col("path").isNull(), absent).otherwise(""))


def uploaded(spark: SparkSession, folder: str, file_name: str) -> str:
    """The path of one file by its name in ``folder``; ValueError for a blank name, FileNotFoundError for an unknown one."""
    row = requested(spark.createDataFrame([(file_name,)], "file_name string"), folder).select("path", "error").first()
    if row.error:
        raise (FileNotFoundError if file_name.strip() else ValueError)(row.error)
    return row.path


@F.pandas_udf(T.BooleanType())
def _is_docx(content: pd.Series) -> pd.Series:
    def look(raw) -> bool:
        try:
            return "word/document.xml" in zipfile.ZipFile(io.BytesIO(raw)).namelist()
        except (zipfile.BadZipFile, TypeError):
            return False

    return pd.Series([look(raw) for raw in content], dtype=bool)


def magic_type(content: Column) -> Column:
    """The type that the first bytes tell: pdf, png, jpg, zip or unknown."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start == "25504446", "pdf").when(start == "89504E47", "png").when(start.startswith("FFD8"), "jpg").when(start.startswith("504B"), "zip").otherwise("unknown")


def with_type(files: DataFrame) -> DataFrame:
    """``files`` with file_type by content: pdf, png, jpg, docx or unknown. Only archives are opened."""
    typed = files.withColumn("file_type", magic_type(F.col("content")))
    others = typed.where("file_type <> 'zip'")
    archives = typed.where("file_type = 'zip'").withColumn("file_type", F.when(_is_docx("content"), "docx").otherwise("unknown"))
    return others.unionByName(archives)


def docx_text(raw: bytes) -> str:
    """Paragraphs, then each table row as its cells that aren't empty; no text is an error."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    lines = [said(p) for p in body.findall(f"{_W}p")]
    lines += [" ".join(c for c in map(said, row.findall(f"{_W}tc")) if c) for row in body.iter(f"{_W}tr")]
    text = "\n".join(x for x in lines if x)
    if not text:
        raise ValueError("no text in the document")
    return text


class Engines:
    """Named engines by file type, in the order of preference. PDF, OCR and model engines are plugged in here."""

    def __init__(self):
        self.known: dict[str, dict[str, Engine]] = {"docx": {"python-docx": docx_text}}

    def register(self, file_type: str, name: str, engine: Engine) -> None:
        self.known.setdefault(file_type, {})[name] = engine

    def policy(self, file_type: str) -> list[str]:
        """The engines of a type that are registered, listed ones first in their order."""
        order = {"pdf": schemas.DIGITAL_PDF_ENGINES, "png": schemas.IMAGE_ENGINES, "jpg": schemas.IMAGE_ENGINES}.get(file_type, ())
        own = self.known.get(file_type, {})
        return [e for e in order if e in own] + [e for e in own if e not in order]


def read(files: DataFrame, engines: Engines, keep_empty: bool = False) -> DataFrame:
    """A candidate row for each file and engine of its type; failures are data, in error.

    A candidate without text is dropped unless ``keep_empty``.
    """

    def run(frames):
        import time

        for frame in frames:
            rows = []
            for f in frame.itertuples(index=False):
                for n, name in enumerate(engines.policy(f.file_type)):
                    began, text, error = time.perf_counter(), "", ""
                    try:
                        text = engines.known[f.file_type][name](f.content).strip()
                    except Exception as e:  # an engine's failure is a result
                        error = f"{type(e).__name__}: {e}"
                    rows.append((f.path, f.file_type, name, n, f"{f.file_type}_{name}", text, error, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATE.split(", ")])

    out = files.select("path", "file_type", "content").mapInPandas(run, CANDIDATE)
    return out if keep_empty else out.where("text <> ''")


def read_digital_first(files: DataFrame, digital: Engines, scanned: Engines) -> DataFrame:
    """Digital candidates, and scanned ones only for files that have none."""
    first = read(files, digital)
    rest = files.join(first.select("path").distinct(), "path", "left_anti")
    return first.unionByName(read(rest, scanned))


def first_text(candidates: DataFrame) -> DataFrame:
    """For each file the text of the first engine that gave one."""
    return candidates.where("text <> ''").groupBy("path").agg(F.min_by(F.struct("engine", "method", "text"), "ordinal").alias("c")).select("path", "c.*")


def page_labels(truth: Column) -> Column:
    """map<page, label> of a ground-truth JSON; null without one."""
    return F.from_json(F.get_json_object(truth, "$.pages"), "map<string,string>")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(stem, field, expected) of the JSON files under ``path``: flat ones by field, page ones by page and field."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    flat = F.from_json("value", "map<string,string>")
    return raw.select(F.regexp_replace("file", r"\.json$", "").alias("stem"), F.explode(flat).alias("field", "expected"))
