"""Batches, responses and the command line, on invented files."""

import json

import pytest

from recordloom import __main__ as cli
from recordloom.operators import extract, validate
from recordloom.plans import batch
from recordloom.sources import files, model_json, sinks

TAX = "INCOME TAX DEPARTMENT\nABCDE1234F\nName\nASHA RAO\nFather's Name\nMOHAN RAO\nDate of Birth\n05/06/1990\nSignature"


def engines() -> files.Engines:
    def broken(raw: bytes) -> str:
        raise RuntimeError("no glasses")

    out = files.Engines()
    for kind in ("png", "pdf"):
        out.register(kind, "doctr", lambda raw: raw[4:].decode())
        out.register(kind, "llm:small", broken)
    return out


def test_scope():
    assert batch.chosen(["a", "b"], ["llm:c"]) == ["a", "b", "llm:c"]
    assert batch.chosen(["a"], ["llm:c"], "no_llm") == ["a"] and batch.chosen(["a"], ["llm:c"], "llm_only") == ["llm:c"]
    assert batch.only(engines(), "llm_only").policy("png") == ["llm:small"]


def test_image_batch(spark, tmp_path):
    source, truth, out = (tmp_path / x for x in ("files", "truth", "out"))
    source.mkdir(), truth.mkdir()
    (source / "rao_front_blurred.png").write_bytes(b"\x89PNG" + TAX.encode())
    (source / "rao_front_clean.png").write_bytes(b"\x89PNG")
    (source / "note.txt").write_text("x")
    (truth / "rao_front_blurred.json").write_text(json.dumps({"pan_number": "ABCDE1234F", "name": "Asha Rao", "date_of_birth": "1990-06-05", "hindi_name": ""}))
    batch.run(spark, "pan", str(source), str(truth), engines(), str(out))
    rows = {r.image.rsplit("/", 1)[-1]: r for r in spark.read.json(str(out / "results")).collect()}
    assert set(rows) == {"rao_front_blurred.png", "rao_front_clean.png"}
    blurred = rows["rao_front_blurred.png"]
    assert (blurred.side, blurred.quality) == ("front", "blurred")
    good, bad = json.loads(blurred.models["doctr"]), json.loads(blurred.models["llm:small"])
    said = good["comparison_with_ground_truth"]
    assert (said["accuracy_percent"], said["matched_fields"], said["total_fields"]) == (100.0, 3, 3)
    assert said["fields"]["hindi_name"]["reason"] == "ground truth value not present" and not said["fields"]["hindi_name"]["used_for_accuracy"]
    assert bad["error"] == "RuntimeError: no glasses" and bad["comparison_with_ground_truth"]["matched_fields"] == 0
    assert (out / "report.xlsx").exists()
    told = [json.loads(p.read_text()) for p in (out / "records").rglob("*.json")]
    assert sorted(t["image"] for t in told) == sorted(r.image for r in spark.read.json(str(out / "results")).collect()) and told


@pytest.mark.parametrize(("digital", "pages"), [(True, {"1", "2"}), (False, {"1", "2", "3"})])
def test_pages(spark, digital, pages):
    read = spark.createDataFrame([("k", "a/k.pdf", "doctr", TAX + "\f\fx", "", 3.0), ("k", "a/k.pdf", "llm:small", "", "lost", 1.0)], "key string, path string, engine string, text string, error string, seconds double")
    raw = spark.createDataFrame([("k", json.dumps({"pages": {"1": "front", "2": "inside"}, "front": {"name": "Asha Rao"}})), ("bad", "[]")], "key string, value string")
    got = batch.paged(read, batch.page_mapping(raw), digital).collect()
    assert {r.image.rsplit("=", 1)[1] for r in got if r.model == "doctr"} == pages
    assert {(r.page, r.side) for r in got if r.model == "llm:small"} == {(1, "front"), (2, "front")}
    assert {r.seconds for r in got if r.model == "doctr"} == {1.0}
    assert [tuple(r) for r in batch.page_truth(raw).collect()] == [("k", 1, "name", "Asha Rao")]


def test_nothing_to_compare(spark):
    readings = spark.createDataFrame([("a", "a.png", "front", "doctr", None, "", None), ("b", "b.png", "unknown", "doctr", "", "lost", 1.0)], batch.READING)
    truth = spark.createDataFrame([], "image string, field string, expected string")
    rows = batch.scored(readings, batch.compared(readings, truth, "passbook"), "passbook").orderBy("image").collect()
    assert [(r.side, r.quality, r.accuracy, r.failed, r.complete) for r in rows] == [("front", "unknown", 0.0, False, False), ("front", "unknown", 0.0, True, False)]


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="digital"):
        batch.run(spark, "invoice", str(tmp_path), str(tmp_path), engines(), str(tmp_path / "o"), "pdf", digital=True)
    with pytest.raises(ValueError, match="no engine"):
        batch.run(spark, "pan", str(tmp_path), str(tmp_path), files.Engines(), str(tmp_path / "o"))


def test_model_results(spark):
    rows = spark.createDataFrame([("invoice", "a/x.png", 'Sure: {"company": "Store", "total": "10.00", "other": 1}'), ("invoice", "a/y.png", "none"), ("odd", "a", "{}")], "type string, path string, raw string")
    got = model_json.results(rows).orderBy("path").collect()
    assert got[0]["values"] is None and not got[0].ready
    assert (got[1]["values"]["company"], got[1]["values"]["source_image"], "other" in got[1]["values"]) == ("Store", "x.png", False)
    assert got[2]["values"]["company"] == "" and got[2]["values"]["source_image"] == "y.png"


def test_response(spark):
    rows = spark.createDataFrame([("a/p.png", "png", TAX, "doctr", "png_doctr")], "path string, file_type string, text string, engine string, method string")
    record = json.loads(validate.summary(extract.extract(rows)).select(sinks.response().alias("r")).first().r)
    assert (record["file_name"], record["document_type"], record["extraction_engine"], record["extraction_attempts"]) == ("p.png", "pan_card", "doctr", [])
    assert record["fields"]["pan_number"] == "ABCDE1234F" and record["validation"]["summary"]["total_fields"] > 0 and record["raw_text"] == TAX


def test_command_line(tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("{}")
    (tmp_path / ".gitkeep").write_text("")
    assert cli.main(["clear-output", "--out", str(tmp_path)]) == 0 and "1 output" in capsys.readouterr().out
    assert (tmp_path / ".gitkeep").exists() and (tmp_path / "a").is_dir() and not (tmp_path / "a" / "x.json").exists()
    asked = cli.parser().parse_args(["batch", "pan", "--files", "f", "--truth", "t", "--llm-only"])
    assert (asked.kind, asked.pdf_type, asked.scope, asked.out) == ("image", "scanned", "llm_only", "outputs")
    for wrong in (["batch", "odd"], ["batch", "pan", "--files", "f", "--truth", "t", "--no-llm", "--llm-only"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(wrong)


def test_process(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"\x89PNG" + TAX.encode())
    assert cli.process(spark, str(tmp_path / "p.png"), engines(), str(tmp_path / "o")) == 1
    row = spark.read.json(str(tmp_path / "o" / "records")).first()
    assert row.document_name == "pan_card" and json.loads(row.record)["fields"]["pan_number"] == "ABCDE1234F"
    assert cli.process(spark, str(tmp_path / "p.png"), files.Engines(), str(tmp_path / "o")) == 0
