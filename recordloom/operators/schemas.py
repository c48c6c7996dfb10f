"""Dimensions of the engine: schemas and their labels, rules, engines, comparison classes."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# For each document type, in the order that decides ties, its fields, whether
# one is required, and the labels printed beside it.
_EMPLOYEE = [
    ("employee_name", True, ["Employee Name:"]),
    ("employee_id", True, ["Employee ID:"]),
    ("date_of_birth", True, ["Date of Birth:"]),
    ("date_of_joining", True, ["Date of Joining:"]),
    ("department", False, ["Department:"]),
    ("designation", False, ["Designation:"]),
    ("mobile_number", True, ["Mobile Number:"]),
    ("email", True, ["Email:"]),
    ("address", False, ["Address:"]),
    ("pincode", False, ["Pincode:"]),
]
_FRONT = [
    ("aadhaar_number", True, ["Aadhaar Number:", "Aadhaar No:", "Aadhaar:", "आधार संख्या:", "आधार नंबर:"]),
    ("vid", False, ["VID:", "VID Number:", "Virtual ID:", "वीआईडी:"]),
    ("name", True, ["Name:", "नाम:"]),
    ("hindi_name", False, ["Hindi Name:", "नाम:", "हिंदी नाम:"]),
    ("date_of_birth", False, ["Date of Birth:", "DOB:", "D.O.B:", "जन्म तिथि:", "जन्म तारीख:"]),
    ("year_of_birth", False, ["Year of Birth:", "YOB:", "जन्म वर्ष:"]),
    ("gender", True, ["Gender:", "लिंग:", "Male", "Female", "पुरुष", "महिला"]),
]
_BACK = [
    ("aadhaar_number", True, ["Aadhaar Number:", "Aadhaar No:", "Aadhaar:", "आधार संख्या:", "आधार नंबर:"]),
    ("vid", False, ["VID:", "VID Number:", "Virtual ID:", "वीआईडी:"]),
    ("relationship_label", False, ["Father:", "S/O:", "C/O:", "W/O:", "Husband:", "पिता:", "पति:", "पत्नी:", "पुत्र:", "मार्फत:"]),
    ("care_of", False, ["C/O:", "Care Of:", "मार्फत:"]),
    ("father_name", False, ["Father:", "Father Name:", "S/O:", "पिता का नाम:", "पिता:", "पुत्र:"]),
    ("husband_name", False, ["Husband:", "Husband Name:", "W/O:", "पति का नाम:", "पति:", "पत्नी:"]),
    ("hindi_relationship_label", False, ["पिता:", "पति:", "पत्नी:", "पुत्र:", "मार्फत:"]),
    ("hindi_care_of", False, ["मार्फत:"]),
    ("hindi_father_name", False, ["पिता:", "पिता का नाम:", "पुत्र:"]),
    ("hindi_husband_name", False, ["पति:", "पति का नाम:", "पत्नी:"]),
    ("address", True, ["Address:", "पता:", "आवासीय पता:"]),
    ("hindi_address", False, ["पता:"]),
    ("hindi_address_lines", False, ["पता:"]),
    ("pincode", True, ["Pincode:", "PIN Code:", "PIN:", "Postal Code:"]),
]
_PAN = [
    ("pan_number", True, ["Permanent Account Number", "PAN", "PAN Number"]),
    ("name", True, ["Name", "नाम"]),
    ("hindi_name", False, ["नाम"]),
    ("father_name", True, ["Father's Name", "Father Name", "पिता का नाम"]),
    ("hindi_father_name", False, ["पिता का नाम"]),
    ("date_of_birth", True, ["Date of Birth", "जन्म की तारीख"]),
    ("signature_present", False, ["Signature", "हस्ताक्षर"]),
    ("card_issue_date_text", False, ["Issue Date", "Card Issue Date"]),
]
_PASSBOOK = [
    ("bank_name", True, ["Bank", "Bank Name"]),
    ("hindi_bank_name", False, ["Bank"]),
    ("branch_name", True, ["Branch"]),
    ("branch_code", False, ["Code", "Branch Code"]),
    ("email", False, ["Email"]),
    ("phone", False, ["Phone No.", "Phone"]),
    ("micr", False, ["MICR"]),
    ("ifsc", True, ["IFSC"]),
    ("account_holder", True, ["Name"]),
    ("relationship_label", False, ["S/D/H/o", "S/O", "D/O", "H/O"]),
    ("father_name", True, ["S/D/H/o", "Father Name"]),
    ("cif_number", True, ["CIF Number"]),
    ("account_number", True, ["Account No.", "Account Number"]),
    ("account_type", True, ["A/c Type", "Account Type"]),
    ("address", True, ["Address"]),
    ("mop", False, ["MOP"]),
    ("account_opened", True, ["A/c Opening Dt", "Account Opening Date"]),
    ("nom_reg_no", False, ["Nom Reg No", "Nomination Registration Number"]),
    ("pan_number", True, ["Customer's PAN", "PAN"]),
    ("date_of_issue", True, ["Date of Issue"]),
    ("continuation", False, ["CONTINUATION"]),
    ("branch_manager_stamp_present", False, ["Branch Manager", "शाखा प्रबंधक"]),
]
_INVOICE = [
    ("company", True, ["Company", "CASH SALES", "INVOICE", "TAX INVOICE", "Receipt"]),
    ("date", True, ["Date", "Daie", "Invoice Date"]),
    ("address", True, ["Address", "Jalan", "Taman", "Lot", "No."]),
    ("receipt_number", False, ["Receipt No.", "Invoice No.", "Doc No.", "Slip No."]),
    ("subtotal", False, ["Subtotal", "Sub-total", "Total Sales"]),
    ("tax", False, ["Tax", "GST", "Total Tax"]),
    ("discount", False, ["Discount", "Disc"]),
    ("total", True, ["Total Sales", "Grand Total", "Amount", "Total", "CASH"]),
    ("currency", False, ["Currency", "RM", "MYR"]),
    ("source_image", False, ["Source Image"]),
]

# Marks that end a form's last value.
END_MARKS = ("Signature", "Applicant Signature", "Employee Signature")

# Engines in order of preference.
DIGITAL_PDF_ENGINES = ("pypdf", "pymupdf", "pdfminer", "pdfplumber")
LISTED_PDF_ENGINES = ("pdfplumber", "pypdf", "pymupdf", "pdfminer")
SCANNED_PDF_ENGINES = ("doctr", "paddleocr", "easyocr")
IMAGE_ENGINES = ("doctr", "tesseract", "paddleocr", "easyocr")
ENGINES_BY_TYPE = {
    "aadhaar_full": ("paddleocr", "easyocr", "doctr"),
    "aadhaar_front": ("paddleocr", "easyocr", "doctr"),
    "aadhaar_back": ("paddleocr", "easyocr", "doctr"),
    "pan_card": ("tesseract", "doctr", "paddleocr", "easyocr"),
    "passbook": ("doctr", "paddleocr", "easyocr"),
    "invoice": ("doctr", "paddleocr", "easyocr"),
}

#: Fields whose values are booleans, and fields that are lists of lines.
FLAGS = ("signature_present", "branch_manager_stamp_present")
LISTS = ("hindi_address_lines",)


def _full() -> list[tuple[str, bool, list[str]]]:
    """Both sides of the card: shared fields once, with the address required too."""
    seen = {f for f, _, _ in _FRONT}
    return _FRONT + [f for f in _BACK if f[0] not in seen]


@cache
def schemas() -> dict[str, list[tuple[str, bool, list[str]]]]:
    """Document type -> (field, required, labels) in order."""
    return {
        "employee_form": _EMPLOYEE,
        "aadhaar_full": _full(),
        "aadhaar_front": _FRONT,
        "aadhaar_back": _BACK,
        "pan_card": _PAN,
        "passbook": _PASSBOOK,
        "invoice": _INVOICE,
    }


def normal_label(label: str) -> str:
    """As labels and texts are compared: lower case, separators and white space as one blank."""
    return " ".join(re.sub("[:：|._-]+", " ", label.lower()).split())


def allowed_edits(label: str) -> int:
    size = len(label.replace(" ", ""))
    return 0 if size <= 4 else 1 if size <= 12 else 2


def labels(spark: SparkSession) -> DataFrame:
    """type, schema_ord, field, field_ord, label_ord, label, norm, edits: one row for each label."""
    rows = [
        (t, i, f, j, k, label, normal_label(label), allowed_edits(normal_label(label)))
        for i, (t, fields) in enumerate(schemas().items())
        for j, (f, _, own) in enumerate(fields)
        for k, label in enumerate(own)
    ]
    return spark.createDataFrame(rows, "type string, schema_ord int, field string, field_ord int, label_ord int, label string, norm string, edits int")


def rules(spark: SparkSession) -> DataFrame:
    """type, field, required, rule_ord: required fields first, as they are reported."""
    rows = []
    for t, fields in schemas().items():
        rows += [(t, f, need, n) for n, (f, need, _) in enumerate(sorted(fields, key=lambda x: not x[1]))]
    return spark.createDataFrame(rows, "type string, field string, required boolean, rule_ord int")


def engine_weights(spark: SparkSession) -> DataFrame:
    """type, engine, weight: the first engine of a type weighs most."""
    rows = [(t, e, len(own) - i) for t, own in ENGINES_BY_TYPE.items() for i, e in enumerate(own)]
    return spark.createDataFrame(rows, "type string, engine string, weight int")
