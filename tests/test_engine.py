"""The record engine: helpers, tolerant search, spans, validation, ranking, reports, intake."""

import random
import sys

import pytest
import regex
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators import classify, evaluate, extract, rank, review, schemas, spans, validate
from recordloom.operators.fuzzy import Labels
from recordloom.sources import files, model_json


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize(
    ("helper", "value", "want"),
    [
        (tx.match_text, "  Date_of--Birth :\n x", "date of birth x"),
        (tx.clean_value, " : | Rahul   Verma - ", "Rahul Verma"),
        (tx.fold_digits, "१२-३", "12-3"),
        (tx.iso_date_repair, "i९९ 1-03-/8", "1991-03-18"),
        (tx.iso_date_repair, "18/03/1991", "1991-03-18"),
        (tx.iso_date, "on 05-06-2012", "2012-06-05"),
        (tx.slash_date, "05-06-2012", "05/06/2012"),
        (tx.padded_date, "5 / 6 / 2012", "2012-06-05"),
        (tx.date_key, "5 June 12", "20120605"),
        (tx.date_key, "5.6.12", "20120605"),
        (tx.date_key, "2012-6-5", "20120605"),
        (tx.date_key, "n/a", "na"),
        (tx.amount_key, "50.8", "50.00"),
        (tx.amount_key, "327", "3.27"),
        (tx.amount_key, "-3.10", "3.10"),
        (tx.amount_key, "RM 1,234.50", "1234.50"),
        (tx.amount_key, "none", ""),
        (tx.safe_file_name, "a/b/ö  x?.png", "_ x_.png"),
        (tx.safe_file_name, "..", "uploaded_document"),
        (extract.id_number, "x 1234 5678 9012 y", "1234 5678 9012"),
        (extract.id_number, "123456789012", "1234 5678 9012"),
        (extract.virtual_id, "1234567890123456", "1234 5678 9012 3456"),
        (extract.pincode, "400001 and 400002\nP.O. Box 560001", "400002"),
        (extract.gender, "Name\nFemale", "Female"),
        (extract.tax_number, "no abcde१२३४f", "ABCDE1234F"),
    ],
)
def test_scalar_helpers(spark, helper, value, want):
    assert one(spark, helper(F.col("v")), value) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("1800 5678 9012\nLake Road\n400801", "400801"),
        ("1234 1800 5678\nLake Road 400801", "400801"),
        ("Lake Road 400801\n1800 300 1947\n560001", "400801"),
        ("Lake Road 400801 1800\n560001", "400801"),
        ("1001 5678 9012\nVID: 9123 4567 8901 1800\nLake Road 400801", "400801"),
    ],
)
def test_a_number_of_a_card_is_no_footer(spark, text, want):
    assert one(spark, extract.pincode(F.col("v")), text) == want


@pytest.mark.parametrize("call", ["1800 1234", "1800 560002", "1800 1947 560002", "2345 1800", "1800 300 1947", "1947 1800 300 1947"])
def test_a_free_call_is_a_footer_unless_of_three_fours(spark, call):
    assert one(spark, extract.pincode(F.col("v")), f"1001 5678 9012\nLake Road 400801\n{call}\n560001") == "400801"


@pytest.mark.parametrize("number", ["1800 4567 8901 2345", "9123 1800 8901 2345", "9123 4567 1800 2345", "1800 5678 901", "1800 5678\n9012", "9123\t4567  1800"])
def test_fours_of_a_number_are_no_free_call(spark, number):
    assert one(spark, extract.pincode(F.col("v")), f"{number}\nLake Road 400801") == "400801"


def test_lines_split_as_unicode_says(spark):
    assert one(spark, tx.lines_of(F.col("v")), "a\r\nb\x0b c \x85\n: d") == ["a", "b", "c", "d"]


def edits(label, text):
    """The least edits between a label and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(label, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_tolerant_search_equals_edit_distance():
    rng = random.Random(1)
    labels = sorted({(schemas.normal_label(x), schemas.allowed_edits(schemas.normal_label(x))) for own in schemas.schemas().values() for _, _, ls in own for x in ls})
    texts = ["", "x"]
    for _ in range(150):
        label = list(rng.choice(labels)[0])
        for _ in range(rng.randint(0, 3)):
            label[rng.randrange(len(label))] = rng.choice(["", "x", "ab", " "])
        texts.append(rng.choice(["", "zz "]) + "".join(label) + rng.choice(["", " yy"]))
    got = Labels(labels).found(texts)
    for i, t in enumerate(texts):
        for j, (label, k) in enumerate(labels):
            assert got[i, j] == (edits(label, t) <= k), (label, t)


def test_tolerant_search_decides_only_beside_a_part_and_once():
    search = Labels([("date of birth", 1), ("account number", 2), ("dob", 0)])
    texts = [f"customer {i} dale of birth 1 acc0unt numbr {i}" for i in range(100)] + ["nothing here " * 50] * 100
    assert search.found(texts).tolist() == [[True, True, False]] * 100 + [[False] * 3] * 100
    assert len(search.verdicts) <= 2 + 100


def test_spans_need_only_the_labels_that_occur():
    finder = spans.Finder()
    labels, _ = classify._dimension()
    search = Labels(labels)
    text = "Employee Name: Asha\nMoblle  Number - 98\nDate_of Birth: 1/2/1990 Emp1oyee ID 7\nSignature"
    norm = " ".join(regex.sub("[:：|._-]+", " ", text.lower()).split())
    hits = [i for i, x in enumerate(search.found([norm])[0]) if x]
    kinds = list(schemas.schemas())
    assert finder.spans([text] * len(kinds), kinds, [hits] * len(kinds)) == finder.spans([text] * len(kinds), kinds, [None] * len(kinds))


def numbered(seed, n):
    """Texts of damaged labels among numbers, ones that are read as letters and other strange characters."""
    rng = random.Random(seed)
    labels = sorted({x for own in schemas.schemas().values() for _, _, some in own for x in some} | set(schemas.END_MARKS))
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 12)):
            word = list(rng.choice(labels))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "1", "20", " ", "\n", "#", "0000"])
            words += ["".join(word), str(rng.randrange(10 ** rng.randint(0, 11))).replace("1", rng.choice("1l"))]
        out.append(rng.choice([" ", "\n", "", ": "]).join(words))
    return out


def test_pieces_between_numbers_hold_what_the_whole_text_holds():
    labels = sorted({(schemas.normal_label(x), schemas.allowed_edits(schemas.normal_label(x))) for own in schemas.schemas().values() for _, _, ls in own for x in ls})
    texts = [" ".join(regex.sub("[:：|._-]+", " ", t.lower()).split())[:60] for t in numbered(6, 40)]
    search = Labels(labels)
    search.found(texts[::2])  # some pieces are known from before
    for t, row in zip(texts, search.found(texts)):
        assert row.tolist() == [edits(label, t) <= k for label, k in labels], t


def test_spans_by_pieces_are_those_of_the_whole_text():
    by_pieces, whole = spans.Finder(), spans.Finder()
    whole.by_pieces = False
    texts = numbered(7, 400)
    kinds = [k for _, k in zip(texts, list(schemas.schemas()) * len(texts))]
    none = [None] * len(texts)
    assert by_pieces.spans(texts, kinds, none) == whole.spans(texts, kinds, none)
    assert any(at for at, _ in by_pieces._pieces("id 1234567890 name", by_pieces._wanted("passbook", None)))


def test_forms_that_differ_in_numbers_are_searched_once(monkeypatch):
    """No row of automata for a form whose like was searched before; before, each form was searched for itself."""
    searched = []
    monkeypatch.setattr(Labels, "ends", lambda self, texts, wanted, own=Labels.ends: searched.extend(texts) or own(self, texts, wanted))
    monkeypatch.setattr(Labels, "_block", lambda self, texts, out, own=Labels._block: searched.extend(texts) or own(self, texts, out))
    forms = [f"TAX INVOICE\nStore {i % 9}\nDate: {10 + i % 9}/02/1995\nReceipt No. R-{100000 + i}\nSubtotal: {5000 + i}.00\nGrand Total: RM {6000 + 7 * i}.25" for i in range(2000)]
    search, finder = Labels(classify._dimension()[0]), spans.Finder()
    assert len(search.found([" ".join(regex.sub("[:|._-]+", " ", t.lower()).split()) for t in forms])) == 2000
    assert len(finder.spans(forms, ["invoice"] * 2000, [None] * 2000)) == 2000
    assert len(searched) < 100


def test_an_option_is_made_once(spark):
    """Before, every option that counts stood twice in the expression, once to be tested and once as the value."""
    plan = spark.range(1).select(tx.first_of(F.concat(F.lit("mark"), F.col("id").cast("string")), F.lit("x")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(mark") == 1


EMPLOYEE = "Employee Name: Asha Rao\nEmployee ID: E_1\nDate of Birth: 01/02/1990\nDate of Joining: 31-02-2020\nDepartment: IT\nDesignation: Clerk\nMoblle Number: 98765 43210\nEmail: a@b\nAddress: 1 Road\nPincode: 012345\nEmployee Signature"
RECEIPT = "ABC SDN BHD\nCASH SALES\nLot 5 Jalan Besar\n12/03/2018\nReceipt No. 77\nTotal Sales 10.50\nGST 0.60\nRM"
BOTH_SIDES = "Government of India\nनाम: आशा\nAsha Mehta\nDOB: 18-03-1991\nFemale\n1234 5678 9012\nW/O: Ravi Mehta\n4 Lake Road\n400001\nUIDAI"


def test_records_from_text(spark):
    docs = spark.createDataFrame([(1, EMPLOYEE), (2, RECEIPT), (3, BOTH_SIDES), (4, None), (5, ""), (6, "nothing at all")], "doc_id int, text string")
    got = {r.doc_id: r for r in validate.summary(extract.extract(docs)).collect()}
    assert [got[i].type for i in (1, 2, 3, 4, 5, 6)] == ["employee_form", "invoice", "aadhaar_full", "unknown", "unknown", "unknown"]
    e = got[1]["values"]
    assert (e["mobile_number"], e["pincode"], e["employee_name"]) == ("98765 43210", "012345", "Asha Rao")
    assert (got[1].invalid_fields, got[1].ready) == (2, False)  # an impossible date and an email without a dot
    r = got[2]["values"]
    assert (r["company"], r["date"], r["subtotal"], r["tax"], r["currency"], r["address"]) == ("ABC SDN BHD", "12/03/2018", "10.50", "0.60", "RM", "Lot 5 Jalan Besar")
    assert r["total"] == ""  # the heading is the first line with one of its labels
    c = got[3]["values"]
    assert (c["gender"], c["date_of_birth"], c["aadhaar_number"], c["husband_name"], c["address"], c["pincode"]) == ("Female", "1991-03-18", "1234 5678 9012", "Ravi Mehta", "4 Lake Road 400001", "400001")
    assert got[4]["values"] is None and got[4].note == validate.NO_SCHEMA and got[4].review


@pytest.mark.parametrize(
    ("field", "value", "error"),
    [
        ("email", "A B@X.Y", ""),
        ("mobile_number", "(98765) 432-10", ""),
        ("mobile_number", "98a", "Mobile number must contain only digits"),
        ("pincode", "40 00-01", ""),
        ("date_of_birth", "1 / 2 / 1990", ""),
        ("date_of_birth", "31/02/1990", "Invalid date format or value"),
        ("date_of_birth", "1/2/90", "Invalid date format or value"),
        ("employee_id", "E 1", "Employee ID must contain only letters, numbers, hyphens or underscores"),
        ("vid", "1234", "VID must have exactly 16 digits"),
        ("ifsc", "sbin-0-123456", ""),
        ("micr", "1 2 3", "MICR must have exactly 9 digits"),
        ("account_number", "12345678", "Account number must have 9 to 18 digits"),
        ("cif_number", "none", "CIF number must contain digits"),
        ("total", "RM 1,234.50", ""),
        ("total", "1.5", "Total must be a valid amount"),
        ("date", "anything", ""),
        ("name", "", "Required field missing"),
    ],
)
def test_field_checks(spark, field, value, error):
    v = one(spark, validate.verdict(F.lit(field), F.col("v"), F.lit(True)), value)
    assert (v.error, v.valid) == (error, error == "")


def test_flags_and_optional_fields(spark):
    assert one(spark, validate.verdict(F.lit("signature_present"), F.col("v"), F.lit(False)), "False").warning == validate.OPTIONAL
    assert one(spark, validate.verdict(F.lit("signature_present"), F.col("v"), F.lit(False)), "True").warning == ""


def test_classification_ties_and_levels(spark):
    docs = spark.createDataFrame([(1, "1234 5678 9012 dob address"), (2, "ABCDE 1234 F"), (3, "passbook of ifsc")], "doc_id int, text string")
    got = {r.doc_id: r for r in classify.classify(docs).collect()}
    assert got[1].type == "aadhaar_full" and got[2].type == "pan_card" and got[3].type == "passbook"
    assert got[1].matched == [] and len(got[1].missing) == 19 and got[1].confidence_level == "medium"


def test_rank_prefers_ready_then_engine_then_order(spark):
    rows = [(1, "tesseract", 0, "pan_card", True, 8, 0, 0, 50.0), (1, "easyocr", 1, "pan_card", True, 8, 0, 0, 50.0), (2, "easyocr", 0, "invoice", False, 9, 1, 0, 90.0), (2, "doctr", 1, "invoice", True, 1, 0, 9, 10.0), (3, "a", 0, "x", True, 1, 0, 0, 1.0), (3, "b", 1, "x", True, 1, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, engine string, ordinal int, type string, ready boolean, valid_fields int, invalid_fields int, warnings int, confidence_percent double")
    scored = rank.scored(df.withColumn("values", F.create_map(F.lit("signature_present"), F.lit("False"), F.lit("name"), F.lit(" "))))
    assert {r.doc_id: r.engine for r in rank.best(scored).collect()} == {1: "tesseract", 2: "doctr", 3: "a"}
    assert scored.first().score.filled == 1
    assert len(rank.attempts(scored).where("doc_id = 1").first().attempts) == 2


def test_comparison(spark):
    pairs = spark.createDataFrame(
        [("name", "Asha Mehta", "ASHA MEHTA"), ("name", "Rao", "Asha Mehta"), ("address", "12 Lake Road", "12 Lake Road Pune 411001"), ("date", "5.6.12", "2012-06-05"), ("total", "RM 10", "10.00"), ("total", "RM 1234", "12.34"), ("source_image", "a", "a"), ("pan_number", "ab-1", "AB1"), ("vid", "x", ""), ("branch_manager_stamp_present", "True", "True")],
        "field string, extracted string, expected string",
    )
    got = sorted((r.field, r.used, r.match) for r in evaluate.compare(pairs).collect())
    assert got == sorted([("name", True, True), ("name", True, False), ("address", True, True), ("date", True, True), ("total", True, True), ("total", True, True), ("source_image", False, False), ("pan_number", True, True), ("vid", False, False), ("branch_manager_stamp_present", True, True)])
    assert one(spark, evaluate.quality_of(F.col("v")), "/x/me_front_clean_digital.png") == "clean_digital"
    assert one(spark, evaluate.side_of(F.col("v")), "/x/me_front_back.png") == "front"


def test_review(spark):
    names = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b"), (4, "b")], "id int, name string")
    assert [r.unique_name for r in review.unique_names(names, "name", ["id"]).orderBy("id").collect()] == ["a.png", "a_1.png", "b", "b_1"]
    assert one(spark, review.field_group(F.col("v")), "bank_name") == "Identity"
    assert one(spark, review.highlights(F.col("v"), "a.b"), "xA.b a.ba.b") == [2, 6, 9]


def test_model_json(spark):
    get = lambda raw: one(spark, model_json.projected(model_json.json_object(F.col("v")), F.array(F.lit("a"), F.lit("b"))), raw)
    assert get('{"a": "1", "c": 2}') == {"a": "1", "b": ""}
    assert get('Sure: {"a": null, "b": "2"} done') == {"a": "", "b": "2"}
    assert one(spark, model_json.json_object(F.col("v")), "no object") is None
    assert one(spark, model_json.model_list(F.col("v"), ["d"]), " x, llm:y ,") == ["llm:x", "llm:y"]


def test_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.bin", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "b.bin", "w") as z:
        z.writestr("other.xml", "")
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.bin").write_bytes(b"x")
    typed = files.with_type(files.scan(spark, str(tmp_path), "*.bin"))
    assert {r.path[-5:]: r.file_type for r in typed.collect()} == {"a.bin": "docx", "b.bin": "unknown", "c.bin": "pdf", "d.bin": "unknown"}
    engines, ocr = files.Engines(), files.Engines()
    engines.register("pdf", "pypdf", lambda raw: 1 / 0)
    ocr.register("pdf", "easyocr", lambda raw: "scanned")
    got = {r.path[-5:]: (r.engine, r.text) for r in files.first_text(files.read_digital_first(typed, engines, ocr)).collect()}
    assert got == {"a.bin": ("python-docx", "Hello\nx y"), "c.bin": ("easyocr", "scanned")}
    failed = files.read(typed, engines, keep_empty=True).where("error <> ''").collect()
    assert [r.error.split(":")[0] for r in failed] == ["ZeroDivisionError"]


def test_upload_lookup(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "b.png").write_bytes(b"x")
    assert files.uploaded(spark, str(tmp_path), "  a.png ").endswith("/a.png")
    with pytest.raises(ValueError, match="Please enter a file name"):
        files.uploaded(spark, str(tmp_path), "  ")
    with pytest.raises(FileNotFoundError, match="File not found in uploads folder: b.png"):
        files.uploaded(spark, str(tmp_path), "b.png")
    asked = spark.createDataFrame([(1, "a.png"), (2, " a.png"), (3, None), (4, "b.png")], "id int, file_name string")
    assert sorted((r.id, r.length, bool(r.error)) for r in files.requested(asked, str(tmp_path)).collect()) == [(1, 4, False), (2, 4, False), (3, None, True), (4, None, True)]


def test_entry_without_the_training_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(__spark_entry__.queries())
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names


def fuzzy(label):
    """The label as a pattern of a fuzzy pattern engine."""
    words = regex.sub("[:：|._-]+", " ", label).split()
    k, body = schemas.allowed_edits(" ".join(words)), r"[\s:：|._-]+".join(map(regex.escape, words))
    return regex.compile(r"(?<![\p{L}\p{N}])" + (f"({body}){{e<={k}}}" if k else body) + r"\s*[:：|._-]?\s*", regex.IGNORECASE)


@pytest.mark.parametrize("seed", [4, 5])
def test_label_automata_find_what_a_fuzzy_pattern_engine_finds(seed):
    rng, finder = random.Random(seed), spans.Finder()
    labels = sorted({x for own in schemas.schemas().values() for _, _, some in own for x in some} | set(schemas.END_MARKS))
    index, patterns = {x: i for i, x in reversed(list(enumerate(finder.norms)))}, {x: fuzzy(x) for x in labels}
    texts = ["", " ", "Name"]
    for n in range(120):
        words = []
        for _ in range(rng.randint(1, 25)):
            word = list(rng.choice(labels)) if rng.random() < 0.7 else list(rng.choice(["Jalan 12", "xx", "i991", "ress", "-", "\n"]))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "..", "1", "\n", "ſ" if n % 10 == 0 else "l"])
            words.append("".join(word))
        texts.append(rng.choice([" ", "\n", ": ", ""]).join(words))
    wanted = [rng.sample(labels, 25) for _ in texts]
    lows = [spans.folded(t) for t in texts]
    places = finder.starts(lows, [[index[schemas.normal_label(x)] for x in own] for own in wanted])
    for text, low, own, starts in zip(texts, lows, wanted, places):
        for label, at in zip(own, starts):
            last, got = 0, []
            for s in at:
                if s >= last and (end := finder.ways[index[schemas.normal_label(label)]].end(low, s, last)) >= 0:
                    last = spans.past_separator(low, end)
                    got.append((s, last))
            assert got == [m.span() for m in patterns[label].finditer(text)], (label, text)


@pytest.mark.parametrize("letters", ["ab", "abc ", "etaoinshrdlu  "])
def test_sequence_ratio_equals_the_standard_one(spark, letters):
    from difflib import SequenceMatcher

    rng, pairs = random.Random(len(letters)), [("", ""), ("a", ""), ("", "b"), (None, "a"), ("a", None)]
    for size in (5, 30, 150, 320, 450):
        for _ in range(25):
            b = "".join(rng.choice(letters) for _ in range(rng.randint(0, size)))
            a = list(b) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, size))]
            for _ in range(rng.randint(0, 8)):
                p = rng.randint(0, len(a))
                a[p : p + rng.randint(0, 3)] = rng.choice(["", "x", "ab", " e"])
            pairs.append(("".join(a), b))
    pairs.append(("x" * 3000 + "tail", "x" * 3000 + "end"))  # popular letters alone
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in rows.withColumn("ratio", evaluate.sequence_ratio("a", "b")).collect():
        assert r.ratio == (None if r.a is None or r.b is None else SequenceMatcher(None, r.a, r.b).ratio()), (r.a, r.b)


def test_slices_in_sql(spark):
    from recordloom.operators import slicing

    slicing.register(spark)
    docs = spark.createDataFrame([(1, EMPLOYEE, "employee_form"), (2, None, "employee_form"), (3, "Name: x", "other"), (4, "Pincode: 411001\nDepartment - R  D | Signature", "employee_form"), (5, "Pincode:\nDepartment - R  D | Signature", "employee_form")], "doc_id int, text string, type string")
    rows = spark.sql("SELECT doc_id, ord, field, value FROM label_slices(TABLE(SELECT * FROM {docs}))", docs=docs).collect()
    # behind an empty value the next label begins a letter early, and so overlaps and is left out
    assert [r[2:] for r in sorted(rows) if r.doc_id == 4] == [("pincode", "411001"), ("department", "R D")]
    assert [r[2:] for r in sorted(rows) if r.doc_id == 5] == [("pincode", "Department - R D")]
    whole = {r.field: r.value for r in sorted(rows) if r.doc_id == 1}
    sliced = spans.with_slices(classify.forced(classify.with_hits(docs.where("doc_id = 1")), F.lit("employee_form"))).first().sliced
    assert whole == sliced and whole["mobile_number"] == "98765 43210" and {r.doc_id for r in rows} == {1, 4, 5}
    by_key = spark.sql("SELECT doc_id, ord, field, value FROM label_slices(TABLE(SELECT * FROM {docs}) PARTITION BY doc_id)", docs=docs).collect()
    assert sorted(by_key) == sorted(rows)
    for wrong in ("label_slices(1)", "label_slices(TABLE(SELECT doc_id FROM {docs}))", "label_slices(TABLE(SELECT *, 1 AS field FROM {docs}))"):
        with pytest.raises(Exception, match="label_slices"):
            spark.sql(f"SELECT * FROM {wrong}", docs=docs).collect()


def walked(value, lines):
    """The lines of nested output by plain recursion, objects in the order of names."""
    say = lambda x: lines.setdefault(str(x).strip()) if str(x).strip() else None
    if isinstance(value, dict):
        for name in ("rec_texts", "texts", "text"):
            if name in value and value[name] is not None:
                for x in value[name] if isinstance(value[name], list) else [value[name]]:
                    say(x)
        for _, x in sorted(value.items()):
            walked(x, lines)
    elif isinstance(value, list):
        if len(value) > 1 and isinstance(value[1], list) and value[1] and isinstance(value[1][0], str):
            say(value[1][0])
        for x in value:
            walked(x, lines)
    return list(lines)


def test_nested_output(spark):
    import json

    from recordloom.operators import nested

    rng = random.Random(2)

    def made(depth):
        kind = rng.randrange(5 if depth else 1)
        if kind == 0:
            return rng.choice(["a", "b", " c ", "", "long text", 7, 1.5])
        if kind == 1:
            return {rng.choice(["text", "rec_texts", "texts", "x", "y"]): made(depth - 1) if rng.random() < 0.5 else rng.choice(["one", ["two", " ", "three"], ["one"], []]) for _ in range(rng.randint(0, 3))}
        if kind == 2:
            return [made(depth - 1), [rng.choice(["read", "seen", 3]), 0.9]]
        return [made(depth - 1) for _ in range(rng.randint(0, 3))]

    def plain(v):
        """Texts that are objects or lists of lists have no one way to be said; keep to those that do."""
        if isinstance(v, dict):
            return {k: (x if k not in nested.TEXT_FIELDS or isinstance(x, str) or (isinstance(x, list) and all(isinstance(y, str) for y in x)) else "said") for k, x in ((k, plain(x)) for k, x in v.items())}
        return [plain(x) for x in v] if isinstance(v, list) else v

    values = [plain(made(rng.randint(0, 6))) for _ in range(80)]
    raw = [json.dumps(v) for v in values] + [None, "", "{", "null", "7"]
    values += [None] * 5
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = {}
    for r in nested.text_lines(rows, "id", "raw").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got == {i: lines for i, v in enumerate(values) if (lines := walked(v, {}))}


def test_numbers_and_ranks_without_gaps(spark):
    from recordloom.operators import numbering

    rng = random.Random(6)
    rows = [(i, None if i % 50 == 0 else rng.choice(["hot"] * 6 + list("abcde"))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, name string").repartition(7)
    got = numbering.ranked(df, "name", ["id"], partitions=16).collect()
    seen = {}
    for i, name in rows:
        seen[i] = sum(1 for j, n in rows[:i] if n == name)
    assert {r.id: r["rank"] for r in got} == seen and len(got) == 3000
    got = numbering.numbered(df, ["name", "id"], "n", partitions=16).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r[1] is not None, r[1] or "", r[0]))] == [r.id for r in sorted(got, key=lambda r: r[-1])]
    assert sorted(r[-1] for r in got) == list(range(3000))
    assert numbering.dictionary(df, "name", 4).orderBy("id").collect() == [(x, i) for i, x in enumerate(sorted({n for _, n in rows if n}))]
    assert numbering.ranked(df.limit(0), "name", ["id"]).count() == numbering.numbered(df.limit(0), ["id"]).count() == 0


def test_one_name_on_all_rows_is_no_single_task(spark):
    from recordloom.operators import numbering

    df = spark.range(4000).select(F.col("id"), F.lit("same.png").alias("name"))
    out = numbering.ranked(df, "name", ["id"], partitions=8)
    rows = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert out.select(F.max("rank"), F.countDistinct("rank")).first() == (3999, 4000)
    assert max(r["count"] for r in rows) < 4000
    staged = numbering._sorted(df, ["name", "id"], 8).groupBy("_part").count().collect()
    assert len(staged) == 8 and max(r["count"] for r in staged) < 1000


def test_display_shows_listed_fields_and_filled_ones(spark):
    rows = [(1, "aadhaar_front", f, v) for f, v in (("vid", ""), ("address", ""), ("pincode", "411001"), ("bank_name", " "), ("x", None))] + [(2, "pan_card", "bank_name", ""), (3, None, "total", None)]
    fields = spark.createDataFrame(rows, "id int, type string, field string, value string")
    shown = review.projection(fields).collect()
    assert sorted((r.id, r.field, r.field_group, r.group_order) for r in shown) == [(1, "pincode", "Address", 3), (1, "vid", "Review", 6), (2, "bank_name", "Identity", 1), (3, "total", "Invoice", 5)]
    counted = review.shown_counts(review.projection(fields.withColumns({"valid": F.col("field") != "vid", "warning": F.lit(None).cast("string"), "is_edited": F.col("id") == 2})), ["id"])
    assert {r.id: tuple(r)[1:] for r in counted.collect()} == {1: (2, 1, 1, 0, 1), 2: (1, 1, 0, 0, 1), 3: (1, 1, 0, 0, 0)}


def test_policy_keeps_engines_that_read(spark):
    rows = [(1, "pan_card", "easyocr", "x"), (1, "pan_card", "tesseract", " "), (1, "pan_card", "doctr", "y"), (1, "pan_card", "other", "y"), (2, "employee_form", "doctr", "x"), (3, "invoice", "paddleocr", None)]
    got = rank.available(spark.createDataFrame(rows, "doc_id int, type string, engine string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "pan_card", "doctr", 1, 3), (1, "pan_card", "easyocr", 2, 1)]


def test_stream_of_reviews_with_late_rows(spark, tmp_path):
    from recordloom.streaming import ingest

    rng = random.Random(9)
    rows = [(f"f{rng.randrange(6)}.png", i, f"2024-01-{rng.randint(1, 9):02} 00:00:00", f"s{i}") for i in range(60)] + [("null.png", 99, None, "x")]
    table = spark.createDataFrame(rows, "file_name string, review_id long, t string, status string").select("file_name", "review_id", F.col("t").cast("timestamp").alias("reviewed_at"), "status")
    for k in range(3):
        table.where(F.col("review_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    before = spark.conf.get(ingest.state_store.KEY)
    with ingest.state_store(spark):
        ingest.process(ingest.latest_reviews(stream), lambda x: x, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    assert spark.conf.get(ingest.state_store.KEY) == before
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.select("part").distinct().count() == 3
    got = {r.file_name: (r.review_id, r.status) for r in review.latest(parts).collect()}
    want = {}
    for f, i, t, s in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        want[f] = (i, s)
    assert got == want


def test_costly_rows_get_more_parts_with_their_sources(spark, monkeypatch):
    from recordloom import staging
    from recordloom.plans import catalogue, forms

    folder = "/root/testdata/sf0.001"
    assert {catalogue.QUERIES[q](spark, folder).rdd.getNumPartitions() for q in ("sequence_ratio",)} == {4}
    few = forms.candidates(spark, folder).rdd.getNumPartitions()
    monkeypatch.setattr(staging, "SHARE", 1000)
    assert catalogue.QUERIES["sequence_ratio"](spark, folder).rdd.getNumPartitions() > 4
    assert forms.candidates(spark, folder).rdd.getNumPartitions() > 2 * few


def test_scores_test_bits_and_not_arrays(spark):
    from recordloom.operators import classify

    rows = spark.createDataFrame([(1, [0, 59, 60, 61, 123]), (2, []), (3, None)], "k int, hits array<int>")
    labels, fields = classify._dimension()
    for k, hits, got in rows.select("k", "hits", classify.scores(F.col("hits")).alias("s")).collect():
        for s in got:
            own = fields[s.type]
            want = [f for f, ids in own if set(ids) & set(hits or [])]
            assert (s.matched, s.total) == (want, len(own)) and s.missing == ([] if hits is None else [f for f, _ in own if f not in want])
    assert "arrays_overlap" not in str(classify.scores(F.col("hits")))
