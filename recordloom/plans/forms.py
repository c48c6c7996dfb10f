"""Labelled forms rendered from the star schema, by one SQL text that Spark and DuckDB both run.

Defects follow from keys: missing fields, short numbers, impossible dates,
misread labels. ``truth`` holds what an undamaged form says; ``CANDIDATES`` are
three readings of each form with defects of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..staging import spread

#: Names and a date of birth by key.
PERSON = "(CASE k % 4 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meena' ELSE 'Arjun' END) || ' ' || (CASE k % 3 WHEN 0 THEN 'Mehta' WHEN 1 THEN 'Nair' ELSE 'Kapoor' END)"
FATHER = "(CASE k % 5 WHEN 0 THEN 'Mohan' WHEN 1 THEN 'Vikram' WHEN 2 THEN 'Suresh' WHEN 3 THEN 'Anil' ELSE 'Rajan' END) || ' ' || (CASE k % 3 WHEN 0 THEN 'Mehta' WHEN 1 THEN 'Nair' ELSE 'Kapoor' END)"
DAY, MONTH, YEAR = "lpad(cast(1 + k % 28 AS STRING), 2, '0')", "lpad(cast(1 + k % 12 AS STRING), 2, '0')", "cast(1960 + k % 40 AS STRING)"
_DATE = "lpad(cast(day(d) as string), 2, '0') || '/' || lpad(cast(month(d) as string), 2, '0') || '/' || cast(year(d) as string)"
_NL = "|| chr(10) ||"

#: One sale for each customer: the sum of its orders and the last order's date.
SALES = """
SELECT c_custkey AS k, c_name AS person, n_name AS place, coalesce(cast(sum(cast(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)), cast(0 AS DECIMAL(18, 2))) AS amount,
  coalesce(cast(max(o_orderdate) AS DATE), DATE '1995-06-17') AS d
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name, n_name
"""

FORMS = f"""
SELECT 'invoice-' || cast(k AS STRING) AS doc_id, 'invoice' AS family, k,
  'TAX INVOICE' {_NL} 'STORE ' || cast(k % 50 AS STRING) || ' SDN BHD' {_NL} 'Lot ' || cast(k % 90 AS STRING) || ' Jalan ' || place
  {_NL} (CASE WHEN k % 13 = 0 THEN 'Dale: ' ELSE 'Date: ' END) || (CASE WHEN k % 17 = 0 THEN '' ELSE {_DATE} END)
  {_NL} 'Receipt No. R-' || cast(100000 + k AS STRING)
  {_NL} 'Subtotal: ' || cast(amount AS STRING) {_NL} 'Tax: ' || cast(cast(amount * 0.06 AS DECIMAL(18, 2)) AS STRING) {_NL} 'Discount: 0.00'
  || (CASE WHEN k % 7 = 0 THEN '' ELSE chr(10) || 'Grand Total: RM ' || cast(cast(amount * 1.06 AS DECIMAL(18, 2)) AS STRING) END) AS text
FROM sales
UNION ALL
SELECT 'employee-' || cast(k AS STRING), 'employee_form', k,
  'Employee Name: ' || replace(replace(person, 'Customer#', 'Asha '), '0', 'a') {_NL} 'Employee ID: EMP-' || cast(k AS STRING) || (CASE WHEN k % 19 = 0 THEN ' / x' ELSE '' END)
  {_NL} 'Date of Birth: ' || (CASE WHEN k % 11 = 0 THEN '31/02/1990' ELSE lpad(cast(1 + k % 28 AS STRING), 2, '0') || '/' || lpad(cast(1 + k % 12 AS STRING), 2, '0') || '/' || cast(1960 + k % 40 AS STRING) END)
  {_NL} 'Date of Joining: ' || {_DATE} {_NL} 'Department: Unit ' || cast(k % 9 AS STRING) {_NL} 'Designation: Clerk'
  {_NL} (CASE WHEN k % 5 = 0 THEN 'Moblle Number: ' ELSE 'Mobile Number: ' END) || (CASE WHEN k % 6 = 0 THEN cast(900000000 + k AS STRING) ELSE cast(9000000000 + k AS STRING) END)
  || (CASE WHEN k % 8 = 0 THEN '' ELSE chr(10) || 'Email: user' || cast(k AS STRING) || (CASE WHEN k % 9 = 0 THEN ' at example.com' ELSE '@example.com' END) END)
  {_NL} 'Address: ' || cast(k % 300 AS STRING) || ' Main Road, ' || place {_NL} 'Pincode: ' || (CASE WHEN k % 10 = 0 THEN '1234' ELSE cast(500001 + k % 90000 AS STRING) END)
  {_NL} 'Employee Signature' AS text
FROM sales
UNION ALL
SELECT 'pan-' || cast(k AS STRING), 'pan_card', k,
  'INCOME TAX DEPARTMENT' {_NL} 'Permanent Account Number' {_NL}
  (CASE WHEN k % 7 = 0 THEN 'ABCD' ELSE 'ABCDE' END) || lpad(cast(k % 10000 AS STRING), 4, '0') || 'F'
  {_NL} 'Name' {_NL} upper({PERSON}) {_NL} 'Father''s Name' {_NL} (CASE WHEN k % 5 = 0 THEN '12345678' || chr(10) ELSE '' END) || upper({FATHER})
  {_NL} 'Date of Birth' {_NL} {_DATE} {_NL} 'Signature' AS text
FROM sales
UNION ALL
SELECT 'passbook-' || cast(k AS STRING), 'passbook', k,
  'State Bank of India' {_NL} 'Branch: ' || place {_NL} 'Branch Code: ' || lpad(cast(k % 100000 AS STRING), 5, '0') {_NL} 'Email: sbi.' || cast(k AS STRING) || '@example.com'
  {_NL} 'IFSC: SBIN' || (CASE WHEN k % 9 = 0 THEN 'O' ELSE '0' END) || lpad(cast(k % 1000000 AS STRING), 6, '0')
  {_NL} 'Name: ' || upper({PERSON}) {_NL} 'S/D/H/o: ' || upper({FATHER}) {_NL} 'CIF Number: ' || cast(8000000 + k AS STRING)
  {_NL} 'Account No.: ' || (CASE WHEN k % 8 = 0 THEN '12345' ELSE cast(30000000000 + k AS STRING) END)
  {_NL} 'A/c Type: ' || (CASE WHEN k % 2 = 0 THEN 'Savings' ELSE 'Current' END) {_NL} 'Address: ' || cast(k % 99 AS STRING) || ' Lake Road ' || place
  {_NL} 'MOP: ' || (CASE WHEN k % 3 = 0 THEN 'JOINT' ELSE 'SINGLE' END) {_NL} 'A/c Opening Dt: ' || {DAY} || '/' || {MONTH} || '/2012' {_NL} 'Nom Reg No: ' || cast(700000 + k AS STRING)
  {_NL} 'Customer''s PAN: ABCDE' || lpad(cast(k % 10000 AS STRING), 4, '0') || 'K' {_NL} 'Date of Issue: ' || {DAY} || '/' || {MONTH} || '/2015'
  || (CASE WHEN k % 4 = 0 THEN '' ELSE chr(10) || 'CONTINUATION' END) || (CASE WHEN k % 5 = 0 THEN '' ELSE chr(10) || 'Branch Manager' END) AS text
FROM (SELECT s_suppkey AS k, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS banks
UNION ALL
SELECT 'card-' || cast(k AS STRING), 'aadhaar_full', k,
  'Government of India' {_NL} (CASE WHEN k % 2 = 0 THEN '' ELSE 'Name: ' END) || {PERSON}
  {_NL} 'DOB: ' || (CASE k % 6 WHEN 0 THEN 'i991 03-/8' WHEN 3 THEN 'l991-03-/8' ELSE {DAY} || '-' || {MONTH} || '-' || {YEAR} END) {_NL} (CASE WHEN k % 5 = 0 THEN 'Male' ELSE 'Female' END)
  {_NL} cast(1000 + k % 9000 AS STRING) || ' 5678 ' || (CASE WHEN k % 7 = 0 THEN '901' ELSE '9012' END)
  {_NL} (CASE k % 3 WHEN 0 THEN 'S/O: ' WHEN 1 THEN 'C/O: ' ELSE 'W/O: ' END) || {FATHER} {_NL} cast(k % 99 AS STRING) || ' Lake Road' {_NL} place {_NL} 'Pincode: ' || cast(400001 + k % 9000 AS STRING) AS text
FROM (SELECT s_suppkey AS k, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS cards
"""

#: Three engines read each form: one well, one that drops the third line, one that misreads digits.
CANDIDATES = """
SELECT doc_id, family, k, 'doctr' AS engine, 0 AS ordinal, text, 0.50 + (k % 7) * 0.25 AS seconds FROM forms
UNION ALL
SELECT doc_id, family, k, 'paddleocr', 1, replace(replace(text, 'Date', 'Dxxe'), 'Total', 'T0tal'), 0.25 + (k % 5) * 0.50 FROM forms
UNION ALL
SELECT doc_id, family, k, 'easyocr', 2, replace(replace(text, '1', 'l'), 'a', 'o'), 1.00 + (k % 3) * 0.25 FROM forms
"""

_TABLES = ("customer", "orders", "nation", "supplier")


def view(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """One of the texts above over the tables of ``sf_dir``, without registering any name.

    ``dealt``: sales and suppliers are dealt out to all cores before forms are
    rendered from them, as a form is many times longer than its source.
    """
    needed = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b{t}\b", sql)}
    made = dict(needed)
    if re.search(r"\bsales\b", sql):
        made["sales"] = view(spark, sf_dir, SALES)
        if dealt:
            made["sales"] = spread(made["sales"], *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")])
            made["supplier"] = spread(made["supplier"])
    if re.search(r"\bforms\b", sql):
        made["forms"] = view(spark, sf_dir, FORMS, dealt)
    text = re.sub(r"\b(customer|orders|nation|supplier|sales|forms)\b(?=\s|$|\))", lambda m: "{" + m[1] + "}", _guard(sql))
    return spark.sql(text, **{k: v for k, v in made.items() if "{" + k + "}" in text})


def _guard(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FORMS, dealt=True)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CANDIDATES, dealt=True)


#: The same as common table expressions for DuckDB.
WITH = f"sales AS ({SALES}), forms AS ({FORMS})"
WITH_CANDIDATES = f"{WITH}, candidates AS ({CANDIDATES})"
