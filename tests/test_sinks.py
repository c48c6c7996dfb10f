"""Sinks: JSON records, corrected records, workbooks."""

import json
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recordloom.operators import classify, validate
from recordloom.sources import sinks, writers

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def test_column_names():
    assert [sinks.column_name(n) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_final_json_and_review(spark):
    rows = spark.createDataFrame([("a.png", "invoice", {"company": "X", "date": "1/2/2020", "address": "é", "total": "1.00"}), ("b.png", "other", {"x": "y"})], "file_name string, type string, values map<string,string>")
    done = {r.file_name: r for r in sinks.reviewed(rows).collect()}
    assert done["a.png"].ready and not done["b.png"].ready and done["b.png"].confidence_level == "low" and done["a.png"].reviewed_at
    text = validate.summary(classify.forced(rows, F.col("type"))).where("type = 'invoice'").select(sinks.final_json()).first()[0]
    told = json.loads(text)
    assert told["extracted_output"]["fields"]["address"] == "é" and told["validation"]["summary"]["invalid_fields"] == 0
    assert len(told["validation"]["field_results"]) == 10


def test_records_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", "invoice", "image"), ("b", "pan", "pdf")], "x string, document_name string, file_format string")
    sinks.write_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("document_name = 'pan' and file_format = 'pdf'").first().x == "b"


def test_workbook(spark, tmp_path):
    frame = spark.createDataFrame([("a & <b>", 1.5, None), ("é\x01", 2.0, 3)], "name string, score double, n int")
    path = str(tmp_path / "r.xlsx")
    sinks.write_workbook(path, {"accuracy": frame, 'quality "front"': frame.limit(0)})
    with zipfile.ZipFile(path) as z:
        assert [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")] == ["accuracy", 'quality "front"']
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == 7
        words = ["".join(s.itertext()) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        said = lambda c: words[int("".join(c.itertext()))] if c.get("t") == "s" else "".join(c.itertext())
        sheets = [ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n}.xml")) for n in (1, 2)]
    assert words == sorted(set(words))
    cells = {c.get("r"): said(c) for c in sheets[0].iter(f"{NS}c")}
    assert cells == {"A1": "name", "B1": "score", "C1": "n", "A2": "a & <b>", "B2": "1.5", "A3": "é\ufffd", "B3": "2.0", "C3": "3"}
    assert [said(c) for c in sheets[1].iter(f"{NS}c")] == ["name", "score", "n"]


def test_large_workbook_is_written_by_many_tasks(spark, tmp_path):
    frame = spark.range(20_000).select("id", F.concat(F.lit("name "), (F.col("id") % 700).cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("even"))
    path = str(tmp_path / "large.xlsx")
    sinks.write_workbook(path, {"rows": frame})
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        words = ["".join(s.itertext()) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = list(ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{NS}row"))
    assert [r.get("r") for r in rows] == [str(n) for n in range(1, 20_002)]
    cells = [c.find(f"{NS}v").text for c in rows[1235]]
    assert cells[0] == "1234" and words[int(cells[1])] == f"name {1234 % 700}" and words[int(cells[2])] == "true"
    assert [p.name for p in tmp_path.iterdir()] == ["large.xlsx"]


def test_checksums_combine():
    a, b = b"first part" * 1000, b"second" * 300_000
    assert writers.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert writers.combined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_a_file_for_each_record(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("pan", "image", "a", "{}"), ("pan", "image", "b", None), ("invoice", "pdf", "a", '{"é": 1}')], "document_name string, file_format string, name string, body string")
    sinks.write_record_files(rows.repartition(3), out)
    sinks.write_record_files(rows.where("name = 'b'").withColumn("body", F.lit("new")), out)
    files = {str(p.relative_to(out)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert files == {"pan/image/a.json": "{}", "pan/image/b.json": "new", "invoice/pdf/a.json": '{"é": 1}'}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_task_that_dies_leaves_nothing_visible(spark, tmp_path):
    writer = writers.RecordWriter({"path": str(tmp_path / "out")})
    good = [Row(folder="pan", name=f"{n}.json", body=str(n)) for n in range(3)]

    def dying():
        yield good[0]
        yield Row(folder="pan", name="half.json", body="half")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    assert not (tmp_path / "out").exists()
    writer.commit([writer.write(iter(good)), None])  # the retry, in a place of its own
    assert sorted(p.name for p in (tmp_path / "out/pan").iterdir()) == ["0.json", "1.json", "2.json"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    failed = writers.RecordWriter({"path": str(tmp_path / "out")})
    failed.write(iter([Row(folder="pan", name="never.json", body="")]))
    failed.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and len(list((tmp_path / "out/pan").iterdir())) == 3
    flaky = spark.range(3).select(F.lit("pan").alias("document_name"), F.lit("image").alias("file_format"), F.col("id").cast("string").alias("name"), F.expr("if(id = 2, raise_error('lost'), 'x')").alias("body"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_record_files(flaky, str(tmp_path / "never"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_reviewed_record_tells_its_attempts(spark):
    rows = spark.createDataFrame([("a.png", "png", "invoice", {"company": "X", "date": "1/2/2020", "total": "1.00"}, "doctr", "ocr")], "file_name string, file_type string, type string, values map<string,string>, engine string, method string")
    done = validate.summary(classify.forced(rows, F.col("type")))
    attempts = F.array(F.struct(F.lit("doctr").alias("engine"), F.lit(3).alias("valid_fields")))
    told = json.loads(done.select(sinks.reviewed_json(attempts=attempts)).first()[0])
    assert told["extraction"] == {"engine": "doctr", "method": "ocr", "attempts": [{"engine": "doctr", "valid_fields": 3}]}
    assert told["reviewed_output"]["fields"]["company"] == "X" and told["validation"]["summary"]["total_fields"] == 10
