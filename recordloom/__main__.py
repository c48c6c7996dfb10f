"""Command line: process one file, run a family's batch, clear outputs."""

from __future__ import annotations

import argparse
import importlib
import os

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import extract, rank, validate
from .plans import batch
from .session import ship
from .sources import files, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="recordloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("process", help="Read one file and write its record.")
    one.add_argument("file_name")
    many = commands.add_parser("batch", help="Read a folder and compare it with ground truth.")
    many.add_argument("document", choices=sorted(batch.READERS))
    many.add_argument("--files", required=True, help="Folder of the images or PDFs.")
    many.add_argument("--truth", required=True, help="Folder of the JSON files of the same names.")
    many.add_argument("--format", choices=["image", "pdf"], default="image", dest="kind")
    many.add_argument("--pdf-type", choices=["scanned", "digital"], default="scanned")
    many.add_argument("--clear-output", action="store_true", help="Clear the outputs first.")
    scope = many.add_mutually_exclusive_group()
    scope.add_argument("--no-llm", "--ocr-only", action="store_const", const="no_llm", default="all", dest="scope", help="Without language models.")
    scope.add_argument("--llm-only", action="store_const", const="llm_only", dest="scope", help="Language models alone.")
    commands.add_parser("clear-output", help="Delete generated files, keep folders.")
    for command in commands.choices.values():
        command.add_argument("--out", default="outputs", help="Folder of the results.")
    for command in (one, many):
        command.add_argument("--engines", help="module:name of the Engines to use; Word files need none.")
    return out


def engines_of(name: str | None) -> files.Engines:
    if not name:
        return files.Engines()
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute or "ENGINES")


def clear(folder: str) -> int:
    """Delete the files below a folder but .gitkeep, keep the folders; how many went."""
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
    system.create_dir(root, recursive=True)
    gone = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name != ".gitkeep"]
    for path in gone:
        system.delete_file(path)
    return len(gone)


def process(spark: SparkSession, path: str, engines: files.Engines, out: str) -> int:
    """Write the best reading's record of the files at ``path``; how many were read."""
    found = files.read(files.with_type(files.scan(spark, path)), engines).withColumn("doc_id", F.col("path"))
    best = rank.best(rank.scored(validate.summary(extract.extract(found))))
    name = F.element_at(F.split("path", "/"), -1)
    rows = best.select(name.alias("file_name"), "file_type", F.col("type").alias("document_name"), sinks.response().alias("record"))
    rows.write.mode("overwrite").json(f"{out}/records")
    return spark.read.json(f"{out}/records", schema="file_name string").count()


def main(arguments: list[str] | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "clear-output" or getattr(asked, "clear_output", False):
        print(f"{clear(asked.out)} output files cleared.")
        if asked.command == "clear-output":
            return 0
    spark = SparkSession.builder.appName("recordloom").getOrCreate()
    ship(spark)
    try:
        if asked.command == "process":
            n = process(spark, asked.file_name, engines_of(asked.engines), asked.out)
            print(f"{n} file read, record in {asked.out}/records." if n else "No text could be read.")
            return 0 if n else 1
        batch.run(spark, asked.document, asked.files, asked.truth, engines_of(asked.engines), asked.out, asked.kind, asked.kind == "pdf" and asked.pdf_type == "digital", asked.scope)
        print(f"Report in {asked.out}/report.xlsx.")
    except ValueError as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
