"""All queries over the reference tables, with their DuckDB twins.

A query returns plain columns (no arrays or structs), so that both engines'
values compare. Queries without a twin need the tolerant label search or a
stream; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, evaluate, extract, nested, ocr_fields, rank, report, review, schemas, slicing, spans, validate
from ..sources import files, model_json, sinks
from ..staging import shared_folder, spread
from ..streaming import ingest
from . import batch, forms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work that costs much for each text."""
    return spread(_t(spark, sf_dir, "documents"))


# -- normalisation ------------------------------------------------------------

_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_MATCH = _SQUEEZE.format("regexp_replace(lower({}), '[:：|._-]+', ' ', 'g')")
_CLEAN = r"regexp_replace(" + _SQUEEZE + r", '^[ :\-|]+|[ :\-|]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_MATCH.format('text')}) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(tx.match_text(F.col("text")).cast("binary")).alias("norm_md5"))


@query(f"SELECT conv_id, turn, {_CLEAN.format('text')} AS value, {_SQUEEZE.format(chr(39) + ' x ' + chr(39) + ' || role')} AS role_text FROM conversations")
def clean_value(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_value(F.col("text")).alias("value"), tx.squeeze(F.concat(F.lit(" x "), "role")).alias("role_text"))


@query(f"""SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '')) AS lines_md5
FROM (SELECT doc_id, i, {_CLEAN.format('l')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
GROUP BY doc_id""")
def clean_lines(spark, sf_dir):
    lines = tx.lines_of(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("lines_md5"))


@query("SELECT o_orderkey, translate(cast(o_orderkey AS STRING), '0123456789', '०१२३४५६७८९') AS script, cast(o_orderkey AS STRING) AS folded FROM orders")
def fold_digits(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.col("o_orderkey").cast("string"), "0123456789", tx.DEVANAGARI_DIGITS).alias("script"))
    return rows.withColumn("folded", tx.fold_digits(F.col("script")))


_ORDER_DAY = "SELECT o_orderkey, cast(o_orderdate AS DATE) AS d FROM orders"
_DAY = "lpad(cast(day(d) AS STRING), 2, '0')"
_MONTH = "lpad(cast(month(d) AS STRING), 2, '0')"
_YEAR = "cast(year(d) AS STRING)"


@query(f"""SELECT o_orderkey, {_YEAR} || {_MONTH} || {_DAY} AS key_slash, {_YEAR} || {_MONTH} || {_DAY} AS key_named,
  CASE WHEN year(d) >= 2000 THEN {_YEAR} ELSE '20' || substr({_YEAR}, 3, 2) END || {_MONTH} || {_DAY} AS key_short, 'na' AS key_other,
  {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} AS iso, {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} AS slash, {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} AS repaired FROM ({_ORDER_DAY})""")
def date_keys(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", *[F.date_format(d, p).alias(n) for n, p in (("a", "d/M/yyyy"), ("b", "d MMMM yyyy"), ("c", "dd.MM.yy"), ("e", "dd/MM/yyyy"), ("g", "dd-MM-yyyy"))])
    repaired = tx.iso_date_repair(F.translate(F.concat(F.lit("on "), F.col("g")), "1", "l"))
    return rows.select("o_orderkey", tx.date_key(F.col("a")).alias("key_slash"), tx.date_key(F.col("b")).alias("key_named"), tx.date_key(F.col("c")).alias("key_short"), tx.date_key(F.lit("n/a")).alias("key_other"), tx.iso_date(F.col("e")).alias("iso"), tx.slash_date(F.col("g")).alias("slash"), repaired.alias("repaired"))


@query("""SELECT l_orderkey, l_linenumber, cast(cast(l_extendedprice AS DECIMAL(18, 2)) AS STRING) AS amount,
  cast(cast(cast(floor(l_quantity * 100) AS BIGINT) / 100 AS DECIMAL(18, 2)) AS STRING) AS cents FROM lineitem""")
def amount_keys(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return rows.select("l_orderkey", "l_linenumber", tx.amount_key(F.concat(F.lit("RM "), price)).alias("amount"), tx.amount_key(F.floor(F.col("l_quantity") * 100).cast("string")).alias("cents"))


@query(r"""SELECT doc_id, regexp_extract(text, '(?i)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b', 1) AS email, len(regexp_extract_all(text, '[0-9]+\.[0-9]{2}')) AS n_amounts,
  regexp_extract(text, '\b([0-9]{2}[-/][0-9]{2}[-/][0-9]{2,4})\b', 1) AS first_date FROM documents""")
def extract_patterns(spark, sf_dir):
    c = F.col("text")
    return _texts(spark, sf_dir).select(
        "doc_id",
        tx.group(c, r"(?i)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b").alias("email"),
        F.size(F.regexp_extract_all(c, F.lit(r"[0-9]+\.[0-9]{2}"), F.lit(0))).cast("long").alias("n_amounts"),
        tx.group(c, r"\b([0-9]{2}[-/][0-9]{2}[-/][0-9]{2,4})\b").alias("first_date"),
    )


# -- classification -----------------------------------------------------------

_LABELS = ", ".join(
    "('{}', {}, '{}', '{}', {})".format(t, i, f, schemas.normal_label(x).replace("'", "''"), len(own))
    for i, (t, own) in enumerate(schemas.schemas().items())
    for f, _, labels in own
    for x in labels
)
_EXACT = f"""WITH {forms.WITH}, labels(type, ord, field, norm, total) AS (VALUES {_LABELS}),
texts AS (SELECT doc_id, {_MATCH.format('text')} AS norm FROM forms),
pairs AS (SELECT DISTINCT doc_id, type, ord, total, field FROM texts JOIN labels l ON contains(texts.norm, l.norm)),
every AS (SELECT doc_id, type, ord, total FROM texts, (SELECT DISTINCT type, ord, total FROM labels)),
scored AS (SELECT e.doc_id, e.type, e.ord, e.total, count(p.field) AS matched FROM every e LEFT JOIN pairs p USING (doc_id, type) GROUP BY ALL)"""


@query(f"{_EXACT} SELECT doc_id, type, matched AS matched_fields, total - matched AS missing_fields, round(matched * 100.0 / total, 6) AS confidence FROM scored")
def schema_scores(spark, sf_dir):
    rows = forms.forms(spark, sf_dir).withColumn("hits", classify.exact_hits(F.col("text")))
    each = rows.select("doc_id", F.explode(classify.scores(F.col("hits"))).alias("s"))
    return each.select("doc_id", "s.type", F.size("s.matched").cast("long").alias("matched_fields"), F.size("s.missing").cast("long").alias("missing_fields"), F.round(F.col("s.confidence") * 100, 6).alias("confidence"))


@query(f"""{_EXACT}, ranked AS (SELECT *, matched * 1.0 / total AS c, row_number() OVER w AS r, lead(matched * 1.0 / total) OVER w AS next FROM scored
  WINDOW w AS (PARTITION BY doc_id ORDER BY matched * 1.0 / total DESC, ord))
SELECT doc_id, type, round(c * 100, 6) AS confidence, round((c - next) * 100, 6) AS gap, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM ranked WHERE r = 1""")
def best_schema(spark, sf_dir):
    rows = forms.forms(spark, sf_dir).withColumn("hits", classify.exact_hits(F.col("text")))
    out = rows.select("doc_id", F.array_sort(F.transform(classify.scores(F.col("hits")), lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s["type"].alias("type")))).alias("s"))
    best = -F.col("s")[0]["c"]
    return out.select("doc_id", F.col("s")[0]["type"].alias("type"), F.round(best * 100, 6).alias("confidence"), F.round((best + F.col("s")[1]["c"]) * 100, 6).alias("gap"), classify.confidence_level(best).alias("level"))


@query(rf"""WITH {forms.WITH}, t AS (SELECT doc_id, text, {_MATCH.format('text')} AS norm FROM forms),
m AS (SELECT *, regexp_matches(text, '(^|[^0-9])[0-9]{{4}}[ \t-]*[0-9]{{4}}[ \t-]*[0-9]{{4}}([^0-9]|$)') AS card,
  regexp_matches(norm, '(^|[^a-z0-9_])(sio|s/o|c/o|w/o|address|pincode|uidai)($|[^a-z0-9_])') OR regexp_matches(text, '(^|[^0-9])[1-9][0-9]{{5}}([^0-9]|$)') AS back,
  regexp_matches(norm, '(^|[^a-z0-9_])(dob|date of birth|yob|male|female)($|[^a-z0-9_])') AS front FROM t)
SELECT doc_id, CASE WHEN card AND back AND front THEN 'aadhaar_full' WHEN card AND back THEN 'aadhaar_back' WHEN card THEN 'aadhaar_front'
  WHEN regexp_matches(upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'pan_card'
  WHEN regexp_matches(norm, 'ifsc|account number|passbook|cif number') THEN 'passbook' WHEN regexp_matches(norm, 'invoice|cash sales|receipt|doc no|total sales') THEN 'invoice'
  WHEN contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'employeeid') OR contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'employeename') THEN 'employee_form' END AS guess FROM m""")
def pattern_heuristic(spark, sf_dir):
    return forms.forms(spark, sf_dir).select("doc_id", classify.pattern_guess(F.col("text"))["type"].alias("guess"))


#: Labels hold no digits and allow two edits, so digits are alike, and three of a run stand for more of them.
_SHAPE = r"regexp_replace(regexp_replace(norm, '[0-9]', '#', 'g'), '####*', '###', 'g')"
_EDITS = ", ".join("('{}', {})".format(x.replace("'", "''"), schemas.allowed_edits(x)) for x in sorted({schemas.normal_label(x) for own in schemas.schemas().values() for _, _, labels in own for x in labels}))
#: Tolerant search by brute force: the edit distance of a label and every piece of a text that could be near it.
_TOLERANT = f"""WITH {forms.WITH}, labels(type, ord, field, norm, total) AS (VALUES {_LABELS}), edits(norm, k) AS (VALUES {_EDITS}),
t AS (SELECT doc_id, family, text, {_MATCH.format('text')} AS norm FROM forms), shaped AS (SELECT *, {_SHAPE} AS shape FROM t),
shapes AS (SELECT DISTINCT shape FROM shaped),
hits AS (
  SELECT shape, norm FROM shapes, edits WHERE k = 0 AND contains(shape, norm)
  UNION SELECT DISTINCT shape, norm FROM (SELECT shape, norm, k, unnest(range(1, len(shape) + 1)) AS i FROM shapes, edits WHERE k > 0)
  WHERE list_min([levenshtein(shape[i:i + len(norm) - 1 + e], norm) FOR e IN range(-k, k + 1)]) <= k),
pairs AS (SELECT DISTINCT shape, type, field FROM hits JOIN labels USING (norm)),
types AS (SELECT DISTINCT type, ord, total FROM labels),
counted AS (SELECT s.shape, y.type, y.ord, y.total, count(p.field) AS n FROM shapes s CROSS JOIN types y LEFT JOIN pairs p ON s.shape = p.shape AND y.type = p.type GROUP BY ALL),
ranked AS (SELECT *, n / total AS c, row_number() OVER w AS r, lead(n / total) OVER w AS next FROM counted WINDOW w AS (PARTITION BY shape ORDER BY n / total DESC, ord)),
m AS (SELECT *, regexp_matches(text, '(^|[^0-9])[0-9]{{4}}[ \t-]*[0-9]{{4}}[ \t-]*[0-9]{{4}}([^0-9]|$)') AS card,
  regexp_matches(norm, '(^|[^a-z0-9_])(sio|s/o|c/o|w/o|address|pincode|uidai)($|[^a-z0-9_])') OR regexp_matches(text, '(^|[^0-9])[1-9][0-9]{{5}}([^0-9]|$)') AS back,
  regexp_matches(norm, '(^|[^a-z0-9_])(dob|date of birth|yob|male|female)($|[^a-z0-9_])') AS front FROM shaped),
g AS (SELECT doc_id, family, shape, CASE WHEN card AND back AND front THEN 'aadhaar_full' WHEN card AND back THEN 'aadhaar_back' WHEN card THEN 'aadhaar_front'
  WHEN regexp_matches(upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'pan_card'
  WHEN regexp_matches(norm, 'ifsc|account number|passbook|cif number') THEN 'passbook' WHEN regexp_matches(norm, 'invoice|cash sales|receipt|doc no|total sales') THEN 'invoice'
  WHEN contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'employeeid') OR contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'employeename') THEN 'employee_form' END AS guess FROM m),
sure(guess, gc) AS (VALUES ('aadhaar_full', 0.65), ('aadhaar_back', 0.55), ('aadhaar_front', 0.5), ('pan_card', 0.55), ('passbook', 0.5), ('invoice', 0.5), ('employee_form', 0.5)),
best AS (SELECT g.doc_id, family, guess, gc, r.type, r.n, r.total, r.c, r.next, r.c < {classify.ENOUGH} AS weak, y.total AS all_of_guess
  FROM g JOIN ranked r ON g.shape = r.shape AND r.r = 1 LEFT JOIN sure USING (guess) LEFT JOIN types y ON y.type = guess),
chosen AS (SELECT *, weak AND guess IS NOT NULL AS guessed, NOT weak AND guess = 'aadhaar_full' AND type LIKE 'aadhaar%' AS both_sides FROM best),
final AS (SELECT doc_id, family, CASE WHEN guessed THEN guess WHEN weak THEN 'unknown' WHEN both_sides THEN 'aadhaar_full' ELSE type END AS type,
  CASE WHEN guessed THEN gc WHEN both_sides THEN greatest(c, gc) ELSE c END AS confidence, CASE WHEN guessed THEN 0.0 ELSE round_even((c - next) * 100, 2) END AS score_gap,
  CASE WHEN guessed THEN 0 ELSE n END AS n_matched, CASE WHEN guessed THEN all_of_guess ELSE total - n END AS n_missing FROM chosen)"""


@query(f"""{_TOLERANT} SELECT doc_id, family, type, round_even(confidence * 100, 2) AS confidence_percent, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level,
  score_gap, cast(n_matched AS INT) AS n_matched, cast(n_missing AS INT) AS n_missing FROM final""")
def classify_forms(spark, sf_dir):
    """Tolerant classification of every form, with what decided it."""
    out = classify.classify(forms.forms(spark, sf_dir))
    return out.select("doc_id", "family", "type", "confidence_percent", "confidence_level", "score_gap", F.size("matched").alias("n_matched"), F.size("missing").alias("n_missing"))


@query(f"""SELECT source, quality, count(*) AS n, count(*) FILTER (WHERE amount) AS with_amount, count(*) FILTER (WHERE mail) AS with_email
FROM (SELECT source, quality, regexp_matches(text, '[0-9]+\\.[0-9]{{2}}') AS amount, contains(text, '@') AS mail FROM documents JOIN labels USING (doc_id)) GROUP BY source, quality""")
def label_quality_by_pattern(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").rlike(r"[0-9]+\.[0-9]{2}").alias("amount"), F.col("text").contains("@").alias("mail"))
    rows = d.join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("source", "quality").agg(F.count("*").alias("n"), F.count_if("amount").alias("with_amount"), F.count_if("mail").alias("with_email"))


# -- extraction ---------------------------------------------------------------


def _records(spark, sf_dir, family: str | None = None) -> DataFrame:
    rows = forms.forms(spark, sf_dir)
    if family:
        rows = rows.where(F.col("family") == family)
    return extract.extract(rows)


@query(f"""WITH {forms.WITH} SELECT doc_id, 'Unit ' || cast(k % 9 AS STRING) AS department, 'Clerk' AS designation,
  CASE WHEN k % 6 = 0 THEN cast(900000000 + k AS STRING) ELSE cast(9000000000 + k AS STRING) END AS mobile_number,
  CASE WHEN k % 10 = 0 THEN '1234' ELSE cast(500001 + k % 90000 AS STRING) END AS pincode,
  CASE WHEN k % 8 = 0 THEN '' WHEN k % 9 = 0 THEN 'user' || cast(k AS STRING) || ' at example.com' ELSE 'user' || cast(k AS STRING) || '@example.com' END AS email
FROM forms WHERE family = 'employee_form'""")
def slice_fields(spark, sf_dir):
    """Values between tolerantly found labels; the twin knows what was rendered."""
    out = spans.with_slices(classify.forced(classify.with_hits(forms.forms(spark, sf_dir).where("family = 'employee_form'")), F.lit("employee_form")))
    return out.select("doc_id", *[tx.text_or_empty(F.try_element_at("sliced", F.lit(f))).alias(f) for f in ("department", "designation", "mobile_number", "pincode", "email")])


_OWN_LABELS = ", ".join(f"('{f}', '{schemas.normal_label(x)}', {schemas.allowed_edits(schemas.normal_label(x))})" for f, x in [*((f, x) for f, _, own in schemas.schemas()["employee_form"] for x in own), *(("", x) for x in schemas.END_MARKS)])


@query(f"""WITH {forms.WITH}, labels(field, label, k) AS (VALUES {_OWN_LABELS}), docs AS (SELECT doc_id, text, lower(text) AS low FROM forms WHERE family = 'employee_form'),
places AS (SELECT doc_id, text, low, i FROM (SELECT *, unnest(range(1, len(low) + 1)) AS i FROM docs) WHERE regexp_matches(substr(low, i, 1), '[a-z0-9]') AND (i = 1 OR NOT regexp_matches(substr(low, i - 1, 1), '[a-z0-9]'))),
near AS (SELECT doc_id, text, field, label, i, n, levenshtein(substr(low, i, n), label) AS d FROM (SELECT p.*, l.*, unnest(range(len(label) - k, len(label) + k + 1)) AS n FROM places p, labels l) WHERE i + n - 1 <= len(low) AND levenshtein(substr(low, i, n), label) <= k),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, field, label, i ORDER BY d, n DESC) = 1)
SELECT doc_id, field, label, cast(i - 1 AS INT) AS first, cast(i + n - 1 + len(regexp_extract(substr(text, i + n), '^[ \n]*[:|._-]?[ \n]*')) AS INT) AS after FROM best""")
def label_spans(spark, sf_dir):
    """Where the labels of employee forms, misread ones too, and the end marks stand; the twin goes by edit distance."""
    docs = classify.forced(classify.with_hits(forms.forms(spark, sf_dir).where("family = 'employee_form'")), F.lit("employee_form"))
    rows = spans.add_spans(docs).select("doc_id", F.explode("spans").alias("s"))
    label = tx.match_text(F.col("s.label"))
    return rows.select("doc_id", F.coalesce("s.field", F.lit("")).alias("field"), label.alias("label"), F.col("s.start").alias("first"), F.col("s.end").alias("after"))


@query(f"""WITH s AS ({SQL["slice_fields"]}) SELECT doc_id, field, value FROM s UNPIVOT (value FOR field IN (department, designation, mobile_number, pincode, email)) WHERE value <> '' OR field <> 'email'""")
def slices_by_sql(spark, sf_dir):
    """The values of ``slice_fields`` by the table function, asked for in SQL; a label that isn't there gives no row."""
    slicing.register(spark)
    docs = forms.forms(spark, sf_dir).where("family = 'employee_form'").select("doc_id", "text", F.lit("employee_form").alias("type"))
    return spark.sql("""SELECT doc_id, field, max_by(value, ord) AS value FROM label_slices(TABLE(SELECT * FROM {docs}))
      WHERE field IN ('department', 'designation', 'mobile_number', 'pincode', 'email') GROUP BY doc_id, field""", docs=docs)


@query(f"""WITH {forms.WITH} SELECT doc_id, 'TAX INVOICE' AS company, 'R-' || cast(100000 + k AS STRING) AS receipt_number, regexp_extract(text, 'Lot [^\n]*') AS address,
  regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) AS subtotal, '' AS tax, regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AS date,
  regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) AS total FROM forms WHERE family = 'invoice'""")
def invoice_overlay(spark, sf_dir):
    """Labels count on the first line that holds one: the heading takes the tax, the subtotal the total."""
    rows = forms.forms(spark, sf_dir).where("family = 'invoice'").withColumn("lines", tx.lines_of(F.col("text")))
    out = extract.sale_overlay(F.col("text"), F.col("lines"), lambda f: F.lit(""))
    return rows.select("doc_id", *[out[f].alias(f) for f in ("company", "receipt_number", "address", "subtotal", "tax", "date", "total")])


_PLACE = r"regexp_extract(text, '\n(NATION_[0-9]+|[A-Z ]+)\nPincode', 1)"
_BRANCH = r"regexp_extract(text, 'Branch: ([^\n]*)', 1)"
_DMY = f"{forms.DAY} || '{{0}}' || {forms.MONTH} || '{{0}}'"
_ACCOUNT = """'ABCDE' || lpad(cast(k % 10000 AS STRING), 4, '0') || 'K' AS pan_number, 'sbi.' || cast(k AS STRING) || '@example.com' AS email, cast(8000000 + k AS STRING) AS cif_number,
  lpad(cast(k % 100000 AS STRING), 5, '0') AS branch_code, cast(700000 + k AS STRING) AS nom_reg_no, CASE WHEN k % 8 = 0 THEN '' ELSE cast(30000000000 + k AS STRING) END AS account_number,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'CONTINUATION' END AS continuation, CASE WHEN k % 5 = 0 THEN 'False' ELSE 'True' END AS branch_manager_stamp_present, CASE WHEN k % 3 = 0 THEN 'JOINT' ELSE 'SINGLE' END AS mop,
  '' AS micr, '' AS hindi_bank_name, '' AS phone, """ + f"""{_DMY.format('/')} || '2012' AS account_opened, {_DMY.format('/')} || '2015' AS date_of_issue, upper({forms.PERSON}) AS account_holder"""


def _overlay(spark, sf_dir, family: str, overlay) -> DataFrame:
    """Every field of an overlay, over forms without any sliced value."""
    rows = forms.forms(spark, sf_dir).where(F.col("family") == family).withColumn("lines", tx.lines_of(F.col("text")))
    out = overlay(F.col("text"), F.col("lines"), lambda f: F.lit(""))
    return rows.select("doc_id", *[c.alias(f) for f, c in out.items()])


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 9 = 0 THEN '' ELSE 'SBIN0' || lpad(cast(k % 1000000 AS STRING), 6, '0') END AS ifsc, {_ACCOUNT},
  'Branch: ' || {_BRANCH} AS bank_name, {_BRANCH} AS branch_name, upper({forms.FATHER}) AS father_name, CASE WHEN k % 2 = 0 THEN 'Savings' ELSE 'Current' END AS account_type,
  cast(k % 99 AS STRING) || ' Lake Road ' || {_BRANCH} AS address FROM forms WHERE family = 'passbook'""")
def passbook_overlay(spark, sf_dir):
    """The bank's name is what follows it, on the next line; a code with a letter O is none."""
    return _overlay(spark, sf_dir, "passbook", extract.account_overlay)


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 7 = 0 THEN '' ELSE 'ABCDE' || lpad(cast(k % 10000 AS STRING), 4, '0') || 'F' END AS pan_number, {forms.PERSON} AS name, {forms.FATHER} AS father_name,
  regexp_replace(regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), '(..)/(..)/(....)', '\\3-\\2-\\1') AS date_of_birth, '' AS hindi_name, '' AS hindi_father_name, 'True' AS signature_present,
  CASE WHEN k % 5 = 0 THEN '12345678' ELSE '' END AS card_issue_date_text FROM forms WHERE family = 'pan_card'""")
def tax_overlay(spark, sf_dir):
    """Names are the capital lines after their labels, a bare issue date passed over."""
    return _overlay(spark, sf_dir, "pan_card", extract.tax_overlay)


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 2 = 0 THEN {forms.PERSON} ELSE '' END AS name, CASE WHEN k % 5 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE k % 6 WHEN 0 THEN '' WHEN 3 THEN '1991-03-18' ELSE {forms.YEAR} || '-' || {forms.MONTH} || '-' || {forms.DAY} END AS date_of_birth, cast(400001 + k % 9000 AS STRING) AS pincode,
  CASE WHEN k % 7 = 0 THEN '' ELSE cast(1000 + k % 9000 AS STRING) || ' 5678 9012' END AS aadhaar_number, {forms.FATHER} AS relationship_label, CASE WHEN k % 3 = 0 THEN {forms.FATHER} ELSE '' END AS father_name,
  CASE WHEN k % 3 = 1 THEN {forms.FATHER} ELSE '' END AS care_of, CASE WHEN k % 3 = 2 THEN {forms.FATHER} ELSE '' END AS husband_name,
  cast(k % 99 AS STRING) || ' Lake Road ' || {_PLACE} || ' Pincode: ' || cast(400001 + k % 9000 AS STRING) AS address,
  '' AS vid, '' AS hindi_name, '' AS hindi_address, '' AS hindi_address_lines, '' AS hindi_relationship_label, '' AS hindi_father_name, '' AS hindi_care_of, '' AS hindi_husband_name
FROM forms WHERE family = 'aadhaar_full'""")
def card_overlay(spark, sf_dir):
    """A bare line is a name, a labelled one is left to slicing; a date with two faults is not repaired."""
    return _overlay(spark, sf_dir, "aadhaar_full", extract.card_overlay)


_SCRIPT = """cards AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'आशा' WHEN 1 THEN 'रवि' WHEN 2 THEN 'मीना' ELSE 'अर्जुन' END || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'मेहता' WHEN 1 THEN 'नायर' ELSE 'कपूर' END AS person,
  CASE s_suppkey % 5 WHEN 0 THEN 'मोहन' WHEN 1 THEN 'विक्रम' WHEN 2 THEN 'सुरेश' WHEN 3 THEN 'अनिल' ELSE 'राजन' END || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'मेहता' WHEN 1 THEN 'नायर' ELSE 'कपूर' END AS father,
  '9123 4567 8901 ' || lpad(cast(s_suppkey % 10000 AS STRING), 4, '0') AS vid, cast(s_suppkey % 99 AS STRING) || ' झील मार्ग' AS road, 'पुणे ' || cast(411001 + s_suppkey % 50 AS STRING) AS town FROM supplier)"""


def _script_cards(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    last = F.when(k % 3 == 0, "मेहता").when(k % 3 == 1, "नायर").otherwise("कपूर")
    person = F.concat(F.when(k % 4 == 0, "आशा").when(k % 4 == 1, "रवि").when(k % 4 == 2, "मीना").otherwise("अर्जुन"), F.lit(" "), last)
    father = F.concat(F.when(k % 5 == 0, "मोहन").when(k % 5 == 1, "विक्रम").when(k % 5 == 2, "सुरेश").when(k % 5 == 3, "अनिल").otherwise("राजन"), F.lit(" "), last)
    vid = F.concat(F.lit("9123 4567 8901 "), F.lpad((k % 10000).cast("string"), 4, "0"))
    road, town = F.concat((k % 99).cast("string"), F.lit(" झील मार्ग")), F.concat(F.lit("पुणे "), (411001 + k % 50).cast("string"))
    return _t(spark, sf_dir, "supplier").select(k.alias("k"), person.alias("person"), father.alias("father"), vid.alias("vid"), road.alias("road"), town.alias("town"))


def _card_text():
    word = F.when(F.col("k") % 3 == 0, "पुत्र").when(F.col("k") % 3 == 1, "मार्फत").otherwise("पति")
    return F.concat_ws("\n", F.lit("भारत सरकार"), F.lit("Government of India"), "person", F.lit("Asha Mehta"), F.lit("जन्म तिथि: 02-02-1961"), F.lit("महिला"), F.lit("1001 5678 9012"), F.concat(F.lit("VID: "), "vid"), F.lit("पता:"), F.concat(word, F.lit(": "), "father"), "road", "town")


_WORD = "CASE k % 3 WHEN 0 THEN 'पुत्र' WHEN 1 THEN 'मार्फत' ELSE 'पति' END || ': ' || father"


@query(f"""WITH {_SCRIPT} SELECT k, vid, person AS hindi_name, 'पता:' || chr(10) || {_WORD} || chr(10) || road || chr(10) || town AS hindi_address_lines, CASE WHEN k % 3 = 0 THEN '' ELSE {_WORD} || ' ' END || road || ' ' || town AS hindi_address,
  father AS hindi_relationship_label, CASE WHEN k % 3 = 0 THEN father ELSE '' END AS hindi_father_name, CASE WHEN k % 3 = 1 THEN father ELSE '' END AS hindi_care_of, CASE WHEN k % 3 = 2 THEN father ELSE '' END AS hindi_husband_name,
  CASE WHEN k % 3 = 1 THEN {_WORD} || ' ' ELSE '' END || road || ' ' || town AS address, right(town, 6) AS pincode, '1961-02-02' AS date_of_birth, vid AS vid_read, person AS hindi_name_read FROM cards""")
def script_cards(spark, sf_dir):
    """Cards in Devanagari: names, relations, address lines and the virtual id, by the overlay and by the reader of OCR text."""
    rows = _script_cards(spark, sf_dir).withColumn("text", _card_text()).withColumn("lines", tx.lines_of(F.col("text")))
    out = extract.card_overlay(F.col("text"), F.col("lines"), lambda f: F.lit(""))
    names = "vid hindi_name hindi_address_lines hindi_address hindi_relationship_label hindi_father_name hindi_care_of hindi_husband_name address pincode date_of_birth".split()
    read = ocr_fields.card(F.col("text"), F.lit("card.png"))
    return rows.select("k", *[out[f].alias(f) for f in names], read["vid"].alias("vid_read"), read["hindi_name"].alias("hindi_name_read"))


@query(f"""WITH {_SCRIPT} SELECT k, person AS hindi_name, father AS hindi_father_name, 'True' AS signature_present FROM cards""")
def script_tax_cards(spark, sf_dir):
    """Tax cards in Devanagari: lines that are names, the father's on some in two parts."""
    father = F.when(F.col("k") % 2 == 0, F.replace("father", F.lit(" "), F.lit("\n"))).otherwise(F.col("father"))
    text = F.concat_ws("\n", F.lit("आयकर विभाग"), F.lit("भारत सरकार"), F.lit("स्थायी लेखा संख्या कार्ड"), F.lit("नाम / Name"), "person", F.lit("पिता का नाम / Father's Name"), father, F.lit("हस्ताक्षर"))
    rows = _script_cards(spark, sf_dir).withColumn("text", text).withColumn("lines", tx.lines_of(F.col("text")))
    out = extract.tax_overlay(F.col("text"), F.col("lines"), lambda f: F.lit(""))
    return rows.select("k", *[out[f].alias(f) for f in ("hindi_name", "hindi_father_name", "signature_present")])


def _read(spark, sf_dir, family: str, reader, fields: str) -> DataFrame:
    rows = forms.forms(spark, sf_dir).where(F.col("family") == family).withColumn("values", reader(F.col("text")))
    return rows.select("doc_id", *[F.try_element_at("values", F.lit(f)).alias(f) for f in fields.split()])


_LINE = "split_part(text, chr(10), {})"
_FIVE = r"regexp_matches({}, '(^|[^0-9A-Za-z_])[0-9]{{5}}([^0-9A-Za-z_]|$)')"


@query(rf"""WITH {forms.WITH} SELECT doc_id, 'STORE ' || cast(k % 50 AS STRING) || ' SDN BHD' AS company, regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AS date, 'R-' || cast(100000 + k AS STRING) AS receipt_number,
  regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) AS subtotal, regexp_extract(text, '
Tax: ([0-9.]+)', 1) AS tax, '0.00' AS discount, 'x.png' AS source_image, CASE WHEN k % 7 = 0 THEN '' ELSE 'MYR' END AS currency,
  CASE WHEN k % 7 = 0 THEN regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) ELSE regexp_extract(text, 'RM ([0-9.]+)', 1) END AS total,
  upper(trim(regexp_replace(regexp_replace(concat_ws(' ', {_LINE.format(3)}, {_LINE.format(4)}, {_LINE.format(5)}, {_LINE.format(6)}, CASE WHEN {_FIVE.format(_LINE.format(7))} THEN {_LINE.format(7)} END,
    CASE WHEN {_FIVE.format(_LINE.format(9))} THEN {_LINE.format(9)} END), '[^A-Za-z0-9,./& -]', ' ', 'g'), '\s+', ' ', 'g'))) AS address FROM forms WHERE family = 'invoice'""")
def read_receipts(spark, sf_dir):
    """The receipt reader; the heading is print of the sale, so the store's line is the company."""
    return _read(spark, sf_dir, "invoice", lambda t: ocr_fields.receipt(t, F.lit("x.png")), "company date receipt_number subtotal tax discount source_image currency total address")


@query(f"""WITH {forms.WITH} SELECT doc_id, 'State Bank of India' AS bank_name, 'SBIN0' || lpad(cast(k % 1000000 AS STRING), 6, '0') AS ifsc, {_ACCOUNT}, {forms.FATHER} AS father_name, '' AS relationship_label, '' AS branch_name,
  CASE WHEN k % 2 = 0 THEN 'SAVINGS' ELSE 'CURRENT' END AS account_type, cast(k % 99 AS STRING) || ' Lake Road ' || replace({_BRANCH}, '_', ' ') AS address FROM forms WHERE family = 'passbook'""")
def read_passbooks(spark, sf_dir):
    """The passbook reader reads letter O in a code as zero; a branch with other signs than letters has no name."""
    fields = "bank_name ifsc pan_number email cif_number branch_code nom_reg_no account_number continuation branch_manager_stamp_present mop micr hindi_bank_name phone account_opened date_of_issue account_holder father_name relationship_label branch_name account_type address"
    return _read(spark, sf_dir, "passbook", ocr_fields.passbook, fields)


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 7 = 0 THEN 'R' ELSE '' END || 'ABCD' || CASE WHEN k % 7 = 0 THEN '' ELSE 'E' END || lpad(cast(k % 10000 AS STRING), 4, '0') || 'F' AS pan_number,
  upper({forms.PERSON}) AS name, upper({forms.FATHER}) AS father_name, regexp_replace(regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), '(..)/(..)/(....)', '\\3-\\2-\\1') AS date_of_birth,
  '' AS hindi_name, '' AS hindi_father_name, 'True' AS signature_present, CASE WHEN k % 5 = 0 THEN '12345678' ELSE '' END AS card_issue_date_text FROM forms WHERE family = 'pan_card'""")
def read_tax_cards(spark, sf_dir):
    """The tax card reader; a number that lacks a letter takes it from the word before."""
    return _read(spark, sf_dir, "pan_card", ocr_fields.tax_card, "pan_number name father_name date_of_birth hindi_name hindi_father_name signature_present card_issue_date_text")


_NO_CARD = "CASE WHEN k % 7 = 0 THEN NULL ELSE {} END AS {}"


@query(f"""WITH {forms.WITH} SELECT doc_id, {_NO_CARD.format("cast(1000 + k % 9000 AS STRING) || ' 5678 9012'", 'aadhaar_number')}, {_NO_CARD.format("CASE WHEN k % 5 = 0 THEN 'MALE' ELSE 'FEMALE' END", 'gender')},
  {_NO_CARD.format(f"CASE WHEN k % 3 = 0 THEN '' ELSE {_DMY.format('-')} || {forms.YEAR} END", 'date_of_birth')}, {_NO_CARD.format(f"CASE WHEN k % 2 = 0 THEN '' ELSE 'Name ' END || {forms.PERSON}", 'name')},
  {_NO_CARD.format("''", 'vid')}, {_NO_CARD.format("''", 'hindi_name')}, {_NO_CARD.format("''", 'year_of_birth')} FROM forms WHERE family = 'aadhaar_full'""")
def read_cards(spark, sf_dir):
    """The reader of a card's front; it keeps a label that stands in the name's line, and gives nothing without a number."""
    return _read(spark, sf_dir, "aadhaar_full", ocr_fields.card_front, "aadhaar_number gender date_of_birth name vid hindi_name year_of_birth")


_SIDES = {
    "pincode": "cast(400001 + k % 9000 AS STRING)",
    "address": f"cast(k % 99 AS STRING) || ' Lake Road ' || replace({_PLACE}, '_', ' ') || ' Pincode ' || cast(400001 + k % 9000 AS STRING)",
    "relationship_label": "CASE k % 3 WHEN 0 THEN 'S/O' WHEN 1 THEN 'C/O' ELSE 'W/O' END",
    "father_name": f"CASE WHEN k % 3 = 0 THEN {forms.FATHER} ELSE '' END",
    "care_of": f"CASE WHEN k % 3 = 1 THEN {forms.FATHER} ELSE '' END",
    "husband_name": f"CASE WHEN k % 3 = 2 THEN {forms.FATHER} ELSE '' END",
    "hindi_address": "'Pincode ' || cast(400001 + k % 9000 AS STRING)",
    "hindi_address_lines": "'Pincode ' || cast(400001 + k % 9000 AS STRING)",
} | {f: "''" for f in ("hindi_relationship_label", "hindi_father_name", "hindi_care_of", "hindi_husband_name")}


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'aadhaar_front' ELSE 'aadhaar_back' END AS type, {_NO_CARD.format("cast(1000 + k % 9000 AS STRING) || ' 5678 9012'", 'aadhaar_number')},
  CASE WHEN k % 7 > 0 AND k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN 'MALE' ELSE 'FEMALE' END END AS gender,
  {", ".join(f"CASE WHEN k % 7 > 0 AND k % 2 = 1 THEN {value} END AS {f}" for f, value in _SIDES.items())} FROM forms WHERE family = 'aadhaar_full'""")
def read_card_sides(spark, sf_dir):
    """These cards show both sides alike, so the file's name decides; a line with the pincode counts as script."""
    rows = forms.forms(spark, sf_dir).where("family = 'aadhaar_full'").withColumn("path", F.when(F.col("k") % 2 == 0, "a/x_front.png").otherwise("a/x_back.png"))
    rows = rows.withColumn("values", ocr_fields.card(F.col("text"), F.col("path")))
    fields = ["aadhaar_number", "gender", *_SIDES]
    return rows.select("doc_id", ocr_fields.card_side(F.col("text"), F.col("path")).alias("type"), *[F.try_element_at("values", F.lit(f)).alias(f) for f in fields])


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'aadhaar_front' WHEN 1 THEN 'aadhaar_back' WHEN 2 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'aadhaar_front' ELSE 'aadhaar_back' END WHEN 3 THEN 'aadhaar_front' WHEN 4 THEN 'aadhaar_back' ELSE 'aadhaar_back' END AS side FROM supplier""")
def card_side_by_evidence(spark, sf_dir):
    """The side of a card by what it shows, whatever its file is called; the name decides between equals, front without one."""
    k = F.col("s_suppkey")
    pin = (411001 + k % 50).cast("string")
    text = (
        F.when(k % 6 == 0, "Asha Mehta\nDOB: 02-02-1961\nFemale")  # front
        .when(k % 6 == 1, F.concat(F.lit("Address: 12 Lake Road\nPune "), pin))  # back
        .when(k % 6 == 2, F.concat(F.lit("DOB: 02-02-1961\nAddress: 12 Lake Road\nPune "), pin))  # as much of both
        .when(k % 6 == 3, "nothing at all")
        .when(k % 6 == 4, F.concat(F.lit("02-02-1961\nW/O: Ravi\nPune "), pin))  # a day alone weighs less
        .otherwise(F.concat(F.lit("Pune "), pin))
    )
    path = F.when(k % 6 == 2, F.when(k % 4 == 0, "in/card_front.png").otherwise("in/card_back.png")).when(k % 6 == 3, "in/card.png").when(k % 6 == 0, "in/back.png").otherwise("front/front.png")
    return _t(spark, sf_dir, "supplier").select(k.alias("k"), ocr_fields.card_side(text, path).alias("side"))


@query(f"""WITH {forms.WITH} SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'Mr ' ELSE 'Ms ' END || upper({forms.PERSON}) AS account_holder, {forms.FATHER} AS father_name, 'S/O' AS relationship_label,
  cast(k % 99 AS STRING) || ' Lake Road ' || replace({_BRANCH}, '_', ' ') || CASE WHEN k % 3 = 0 THEN ' 600004' ELSE '' END AS address FROM forms WHERE family = 'passbook'""")
def read_bare_passbooks(spark, sf_dir):
    """Passbooks without the labels of names and address: greetings, relations and places tell them."""
    rows = forms.forms(spark, sf_dir).where("family = 'passbook'")
    text = F.replace(F.replace("text", F.lit("S/D/H/o: "), F.lit("S/O\n")), F.lit("Address: "), F.lit(""))
    text = F.replace(text, F.lit("Name: "), F.when(F.col("k") % 2 == 0, "Mr.\n").otherwise("Ms "))
    text = F.replace(text, F.lit("MOP: "), F.when(F.col("k") % 3 == 0, "600004 MOP: ").otherwise("MOP: "))
    rows = rows.withColumn("values", ocr_fields.passbook(text))
    return rows.select("doc_id", *[F.try_element_at("values", F.lit(f)).alias(f) for f in ("account_holder", "father_name", "relationship_label", "address")])


def _sql_fields(family: str, values: dict[str, str], where: str = "true", kind: str | None = None) -> str:
    """The long fields of a family's forms by what was rendered: an expression over text and k for each field."""
    kinds = {f: "b" if f in schemas.FLAGS else "l" if f in schemas.LISTS else "s" for f in values}
    each = ", ".join(f"{{'field': '{f}', 'kind': '{kinds[f]}', 'value': {v}}}" for f, v in values.items())
    return f"SELECT doc_id, family, '{kind or family}' AS type, f.field, f.value, f.kind FROM forms, unnest([{each}]) AS u(f) WHERE family = '{family}' AND {where}"


def _line(label: str) -> str:
    """What follows a label on its line of the form."""
    return f"trim(regexp_extract(text, '(?m)^{label}: ?(.*)$', 1))"


_SPOKEN_DAY = r"regexp_extract(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}')"
_EMPTY = lambda *names: {f: "''" for f in names}
_CARD = {
    "aadhaar_number": "CASE WHEN k % 7 = 0 THEN '' ELSE cast(1000 + k % 9000 AS STRING) || ' 5678 9012' END",
    "name": forms.PERSON,
    "date_of_birth": f"CASE k % 6 WHEN 0 THEN 'i991 03-/8' WHEN 3 THEN '1991-03-18' ELSE {forms.YEAR} || '-' || {forms.MONTH} || '-' || {forms.DAY} END",
    "gender": "CASE WHEN k % 5 = 0 THEN 'Male' ELSE 'Female' END",
    **_EMPTY("vid", "hindi_name", "year_of_birth"),
}
_EXTRACTED = " UNION ALL ".join(
    [
        _sql_fields(
            "invoice",
            {
                # without a day, what stands between the labels Date and No.
                "company": "'TAX INVOICE'", "date": f"CASE WHEN k % 17 > 0 THEN {_SPOKEN_DAY} WHEN k % 13 = 0 THEN '' ELSE 'Receipt' END", "address": "regexp_extract(text, 'Lot [^\n]*')", "receipt_number": "'R-' || cast(100000 + k AS STRING)",
                "subtotal": _line("Subtotal"), "tax": _line("Tax"), "discount": "'0.00'", "total": _line("Subtotal"), "currency": "CASE WHEN k % 7 = 0 THEN '' ELSE 'RM' END", "source_image": "''",
            },
        ),
        _sql_fields(
            "employee_form",
            {f: _line(x) for f, x in (("employee_name", "Employee Name"), ("employee_id", "Employee ID"), ("date_of_birth", "Date of Birth"), ("date_of_joining", "Date of Joining"), ("department", "Department"), ("designation", "Designation"), ("mobile_number", "Mob[il]le Number"), ("email", "Email"), ("address", "Address"), ("pincode", "Pincode"))},
        ),
        _sql_fields(
            "pan_card",
            {
                "pan_number": "CASE WHEN k % 7 = 0 THEN 'ABCD' ELSE 'ABCDE' END || lpad(cast(k % 10000 AS STRING), 4, '0') || 'F'", "name": forms.PERSON, "father_name": forms.FATHER,
                "date_of_birth": f"regexp_replace({_SPOKEN_DAY}, '(..)/(..)/(....)', '\\3-\\2-\\1')", "signature_present": "'True'", "card_issue_date_text": "CASE WHEN k % 5 = 0 THEN '12345678' ELSE '' END", **_EMPTY("hindi_name", "hindi_father_name"),
            },
        ),
        _sql_fields(
            "passbook",
            {
                "bank_name": "'Branch: ' || " + _line("Branch"), "branch_name": _line("Branch"), "branch_code": _line("Branch Code"), "email": _line("Email"), "ifsc": _line("IFSC"), "account_holder": _line("Name"), "relationship_label": _line("S/D/H/o"), "father_name": _line("S/D/H/o"),
                "cif_number": _line("CIF Number"), "account_number": _line("Account No."), "account_type": _line("A/c Type"), "address": _line("Address"), "mop": _line("MOP"), "account_opened": _line("A/c Opening Dt"), "nom_reg_no": _line("Nom Reg No"), "pan_number": _line("Customer.s PAN"), "date_of_issue": _line("Date of Issue"),
                "continuation": "CASE WHEN k % 4 = 0 THEN '' ELSE 'CONTINUATION' END", "branch_manager_stamp_present": "CASE WHEN k % 5 = 0 THEN 'False' ELSE 'True' END", "name": "CASE WHEN k % 4 = 0 THEN '' ELSE 'Continuation' END",
                "date_of_birth": f"'2012-' || {forms.MONTH} || '-' || {forms.DAY}", "signature_present": "'False'", **_EMPTY("hindi_bank_name", "phone", "micr", "hindi_name", "hindi_father_name", "card_issue_date_text"),
            },
        ),
        _sql_fields("aadhaar_full", _CARD, "k % 7 = 0 AND k % 2 = 1", "aadhaar_front"),
        _sql_fields(
            "aadhaar_full",
            _CARD | {
                "relationship_label": forms.FATHER, "father_name": f"CASE WHEN k % 3 = 0 THEN {forms.FATHER} ELSE '' END", "care_of": f"CASE WHEN k % 3 = 1 THEN {forms.FATHER} ELSE '' END", "husband_name": f"CASE WHEN k % 3 = 2 THEN {forms.FATHER} ELSE '' END",
                "address": "replace(regexp_extract(text, '[0-9]+ Lake Road\n[^\n]*\nPincode: [0-9]+'), chr(10), ' ')", "pincode": _line("Pincode"),
                **_EMPTY("hindi_relationship_label", "hindi_care_of", "hindi_father_name", "hindi_husband_name", "hindi_address", "hindi_address_lines"),
            },
            "k % 7 > 0",
        ),
    ]
)


@query(f"WITH {forms.WITH} {_EXTRACTED}")
def extract_fields(spark, sf_dir):
    """Every field of every form: classified, sliced and overlaid, in long form; the twin goes by what was rendered."""
    return extract.long_fields(_records(spark, sf_dir), ["doc_id", "family"])


# -- validation ---------------------------------------------------------------

_VALUES = f"""SELECT doc_id, k, f.field, f.value FROM forms, unnest([
  {{'field': 'mobile_number', 'value': CASE WHEN k % 6 = 0 THEN cast(900000000 + k AS STRING) WHEN k % 7 = 0 THEN 'abc' ELSE cast(9000000000 + k AS STRING) END}},
  {{'field': 'pincode', 'value': CASE WHEN k % 10 = 0 THEN '1234' ELSE cast(500001 + k % 90000 AS STRING) END}},
  {{'field': 'date_of_birth', 'value': CASE WHEN k % 11 = 0 THEN '31/02/1990' WHEN k % 5 = 0 THEN '1/2/1990' ELSE '1990-02-28' END}},
  {{'field': 'email', 'value': CASE WHEN k % 9 = 0 THEN 'user at example.com' ELSE 'user @ example.com' END}},
  {{'field': 'ifsc', 'value': CASE WHEN k % 4 = 0 THEN 'sbin 0 123456' ELSE 'SBINO123456' END}},
  {{'field': 'total', 'value': CASE WHEN k % 3 = 0 THEN 'RM 1,234.50' WHEN k % 5 = 0 THEN '12.5' ELSE '' END}}]) AS u(f)"""


@query(f"""WITH {forms.WITH}, v AS ({_VALUES}) SELECT doc_id, field, value, error = '' AS valid, error FROM (SELECT *, CASE
  WHEN value = '' THEN 'Required field missing'
  WHEN field = 'mobile_number' AND NOT regexp_matches(value, '^[0-9]+$') THEN 'Mobile number must contain only digits'
  WHEN field = 'mobile_number' AND length(value) <> 10 THEN 'Mobile number must have exactly 10 digits'
  WHEN field = 'pincode' AND NOT regexp_matches(value, '^[0-9]{{6}}$') THEN 'Pincode must be exactly 6 digits'
  WHEN field = 'date_of_birth' AND try_strptime(value, ['%d/%m/%Y', '%Y-%m-%d']) IS NULL THEN 'Invalid date format or value'
  WHEN field = 'email' AND NOT contains(value, '@') THEN 'Invalid email format'
  WHEN field = 'ifsc' AND NOT regexp_matches(upper(replace(value, ' ', '')), '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') THEN 'IFSC must match format AAAA0999999'
  WHEN field = 'total' AND NOT regexp_matches(trim(regexp_replace(replace(value, ',', ''), '^[A-Za-z$]+', '')), '^[0-9]+(\\.[0-9]{{2}})?$') THEN 'Total must be a valid amount'
  ELSE '' END AS error FROM v)""")
def validate_formats(spark, sf_dir):
    k = F.col("k")
    number = lambda n: (F.lit(n) + k).cast("string")
    values = {
        "mobile_number": F.when(k % 6 == 0, number(900000000)).when(k % 7 == 0, "abc").otherwise(number(9000000000)),
        "pincode": F.when(k % 10 == 0, "1234").otherwise((500001 + k % 90000).cast("string")),
        "date_of_birth": F.when(k % 11 == 0, "31/02/1990").when(k % 5 == 0, "1/2/1990").otherwise("1990-02-28"),
        "email": F.when(k % 9 == 0, "user at example.com").otherwise("user @ example.com"),
        "ifsc": F.when(k % 4 == 0, "sbin 0 123456").otherwise("SBINO123456"),
        "total": F.when(k % 3 == 0, "RM 1,234.50").when(k % 5 == 0, "12.5").otherwise(""),
    }
    rows = forms.forms(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])).alias("f"))
    return rows.select("doc_id", "f.field", "f.value", validate.verdict(F.col("f.field"), F.col("f.value"), F.lit(True)).alias("v")).select("doc_id", "field", "value", "v.valid", "v.error")


_NUMBERS = """SELECT c_custkey AS k, f.field, f.value, f.ok FROM customer, unnest([
  {'field': 'aadhaar_number', 'value': CASE c_custkey % 3 WHEN 0 THEN '1234 5678 ' || lpad(cast(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '1234-5678-9012' ELSE '1234 5678 901' END, 'ok': c_custkey % 3 < 2},
  {'field': 'vid', 'value': CASE c_custkey % 3 WHEN 0 THEN '1234 5678 9012 3456' WHEN 1 THEN '' ELSE '1234 5678 9012 345x' END, 'ok': c_custkey % 3 = 0},
  {'field': 'micr', 'value': CASE c_custkey % 4 WHEN 0 THEN '411 002 003' WHEN 1 THEN 'no. 411002003' WHEN 2 THEN '41100200' ELSE 'none' END, 'ok': c_custkey % 4 < 2},
  {'field': 'account_number', 'value': repeat('7', cast(7 + c_custkey % 14 AS INT)), 'ok': c_custkey % 14 BETWEEN 2 AND 11},
  {'field': 'cif_number', 'value': CASE WHEN c_custkey % 2 = 0 THEN 'CIF ' || cast(c_custkey AS STRING) ELSE 'unknown' END, 'ok': c_custkey % 2 = 0},
  {'field': 'branch_code', 'value': CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '०' || 'x' END, 'ok': c_custkey % 5 > 0},
  {'field': 'nom_reg_no', 'value': CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE '7' END, 'ok': c_custkey % 7 > 0},
  {'field': 'branch_manager_stamp_present', 'value': CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'seen' ELSE 'False' END, 'ok': c_custkey % 4 < 2}]) AS u(f)"""
_SAID = " ".join(f"WHEN '{f}' THEN '{validate.CHECKS[f][1]}'" for f in ("aadhaar_number", "vid", "micr", "account_number", "cif_number", "branch_code", "nom_reg_no", "branch_manager_stamp_present"))


@query(f"""SELECT k, field, ok AS valid, CASE WHEN ok THEN '' WHEN value = '' OR (field = 'branch_manager_stamp_present' AND value = 'False') THEN '{validate.MISSING}' ELSE CASE field {_SAID} END END AS error FROM ({_NUMBERS})""")
def validate_numbers(spark, sf_dir):
    """The rules of identity, account and registration numbers, and of the stamp, which is a flag."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    values = {
        "aadhaar_number": F.when(k % 3 == 0, F.concat(F.lit("1234 5678 "), F.lpad(text(k % 10000), 4, "0"))).when(k % 3 == 1, "1234-5678-9012").otherwise("1234 5678 901"),
        "vid": F.when(k % 3 == 0, "1234 5678 9012 3456").when(k % 3 == 1, "").otherwise("1234 5678 9012 345x"),
        "micr": F.when(k % 4 == 0, "411 002 003").when(k % 4 == 1, "no. 411002003").when(k % 4 == 2, "41100200").otherwise("none"),
        "account_number": F.repeat(F.lit("7"), (7 + k % 14).cast("int")),
        "cif_number": F.when(k % 2 == 0, F.concat(F.lit("CIF "), text(k))).otherwise("unknown"),
        "branch_code": F.when(k % 5 == 0, "x").otherwise("०x"),
        "nom_reg_no": F.when(k % 7 == 0, "-").otherwise("7"),
        "branch_manager_stamp_present": F.when(k % 4 == 0, "True").when(k % 4 == 1, "MISSING").when(k % 4 == 2, "seen").otherwise("False"),
    }
    rows = _t(spark, sf_dir, "customer").select(k.alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])).alias("f"))
    return rows.select("k", "f.field", validate.verdict(F.col("f.field"), F.col("f.value"), F.lit(True)).alias("v")).select("k", "field", "v.valid", "v.error")


@query(f"""WITH {forms.WITH} SELECT doc_id, 10 AS total_fields, cast((k % 8 = 0 OR k % 9 = 0) AS INT) + cast(k % 11 = 0 AS INT) + cast(k % 6 = 0 AS INT) + cast(k % 10 = 0 AS INT) + cast(k % 19 = 0 AS INT) AS invalid_fields,
  NOT (k % 8 = 0 OR k % 9 = 0 OR k % 11 = 0 OR k % 6 = 0 OR k % 10 = 0 OR k % 19 = 0) AS ready FROM forms WHERE family = 'employee_form'""")
def validation_summary(spark, sf_dir):
    """Employee forms through slicing and all their rules; the twin knows the planted defects."""
    docs = classify.forced(classify.with_hits(forms.forms(spark, sf_dir).where("family = 'employee_form'")), F.lit("employee_form"))
    out = validate.summary(extract.overlaid(spans.with_slices(docs), types=["employee_form"]))
    return out.select("doc_id", "total_fields", "invalid_fields", "ready")


_NEEDED = ", ".join(f"('{t}', '{f}', {'true' if need else 'false'})" for t, own in schemas.schemas().items() for f, need, _ in own)
_RULE_ERRORS = "CASE " + " ".join(
    f"WHEN field = '{f}' AND NOT coalesce({test}, false) THEN '{validate.CHECKS[f][1]}'"
    for f, test in {
        "email": "regexp_full_match(value, '[^@ ]+@[^@ ]+[.][^@ ]+')", "pincode": "regexp_full_match(value, '[0-9]{6}')", "employee_id": "regexp_full_match(value, '[A-Za-z0-9_-]+')", "aadhaar_number": "regexp_full_match(replace(value, ' ', ''), '[0-9]{12}')",
        "pan_number": "regexp_full_match(value, '[A-Z]{5}[0-9]{4}[A-Z]')", "ifsc": "regexp_full_match(value, '[A-Z]{4}0[A-Z0-9]{6}')", "account_number": "regexp_full_match(value, '[0-9]{9,18}')", "total": "regexp_full_match(value, '[0-9]+[.][0-9]{2}')",
        **{f: "coalesce(try_strptime(value, '%d/%m/%Y'), try_strptime(value, '%Y-%m-%d')) IS NOT NULL" for f in ("date_of_birth", "date_of_joining", "account_opened", "date_of_issue")},
        **{f: "regexp_matches(value, '[0-9]')" for f in ("cif_number", "nom_reg_no", "branch_code")}, "branch_manager_stamp_present": "value IN ('True', 'False')",
    }.items()
) + " WHEN field = 'mobile_number' AND NOT regexp_full_match(value, '[0-9]{10}') THEN 'Mobile number must have exactly 10 digits' END"


@query(f"""WITH {forms.WITH}, x AS ({_EXTRACTED}), rules(type, field, required) AS (VALUES {_NEEDED}),
v AS (SELECT family, type, field, required, CASE WHEN kind = 'b' AND value = 'False' THEN '' ELSE value END AS value FROM x JOIN rules USING (type, field)),
e AS (SELECT family, type, field, CASE WHEN value = '' THEN CASE WHEN required THEN '{validate.MISSING}' END ELSE {_RULE_ERRORS} END AS error FROM v)
SELECT family, type, field, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL""")
def invalid_by_rule(spark, sf_dir):
    rows = validate.validate(_records(spark, sf_dir), ["doc_id", "family"])
    return rows.where("not valid").groupBy("family", "type", "field", "error").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms classified, extracted, validated and counted by type and readiness."""
    out = validate.summary(_records(spark, sf_dir))
    return out.groupBy("family", "type", "ready").agg(F.count("*").alias("documents"), F.sum("invalid_fields").alias("invalid_fields"), F.sum("warnings").alias("warnings"))




# -- ranking ------------------------------------------------------------------


_POLICY = ", ".join(f"('{t}', '{e}', {i}, {len(own) + 1 - i})" for t, own in schemas.ENGINES_BY_TYPE.items() for i, e in enumerate(own, 1))


@query(f"""WITH {forms.WITH_CANDIDATES}, policy(type, engine, place, weight) AS (VALUES {_POLICY})
SELECT doc_id, type, engine, cast(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS place, weight
FROM (SELECT DISTINCT doc_id, family AS type, engine FROM candidates WHERE NOT (k % 4 = 1 AND ordinal = 0)) JOIN policy USING (type, engine)""")
def engine_preference(spark, sf_dir):
    """The engines that really read a form, in the order of its type's policy; one of them found some forms blank."""
    rows = forms.candidates(spark, sf_dir).withColumn("text", F.when((F.col("k") % 4 == 1) & (F.col("ordinal") == 0), " ").otherwise(F.col("text")))
    return rank.available(rows.withColumnRenamed("family", "type"))


#: Whether the third reading, which makes letters of ones, has something like a tax number; and how many digits it leaves a tax card.
_TAXED = "regexp_matches(upper(regexp_replace(replace(replace(text, '1', 'l'), 'a', 'o'), '[^A-Za-z0-9]', '', 'g')), '[A-Z][A-Z][A-Z][A-Z][A-Z][0-9][0-9][0-9][0-9][A-Z]')"
_LEFT = "len(regexp_replace(text, '[^02-9]', '', 'g'))"
#: What the winning reading of each form is like. The second engine reads cards as well as the first and is preferred. A tax card with
#: a short number passes for a passbook in the third reading, more of whose fields are valid; a card of no known type may pass for a tax card.
def _judged(third: bool) -> str:
    """Each form's reading and how it is judged: the winning one, or, without the ``third``, the first."""
    odd, taxed = (f"k % 7 = 0 AND NOT {_TAXED}", _TAXED) if third else ("false", "false")
    return f"""SELECT doc_id, family, CASE WHEN type = 'unknown' OR family <> 'aadhaar_full' AND NOT odd THEN 'doctr' WHEN odd THEN 'easyocr' ELSE 'paddleocr' END AS engine, type, type <> 'unknown' AND bad = 0 AS ready,
  total - bad AS valid_fields, bad AS invalid_fields, warnings, round_even(100.0 * known / labels, 2) AS confidence_percent, filled FROM (
  SELECT doc_id, family, false AS odd, 'invoice' AS type, 10 AS total, (k % 17 = 0 AND k % 13 = 0)::INT AS bad, 1 + (k % 7 = 0)::INT AS warnings, 9 - (k % 7 = 0)::INT - (k % 13 = 0)::INT AS known, 10 AS labels, 9 - (k % 7 = 0)::INT - (k % 17 = 0 AND k % 13 = 0)::INT AS filled FROM forms WHERE family = 'invoice'
  UNION ALL SELECT doc_id, family, false, 'employee_form', 10, (k % 8 = 0 OR k % 9 = 0)::INT + (k % 11 = 0)::INT + (k % 6 = 0)::INT + (k % 10 = 0)::INT + (k % 19 = 0)::INT, 0, 10 - (k % 8 = 0)::INT, 10, 10 - (k % 8 = 0)::INT FROM forms WHERE family = 'employee_form'
  UNION ALL SELECT doc_id, family, false, 'passbook', 22, (k % 8 = 0)::INT + (k % 9 = 0)::INT, 3 + (k % 4 = 0)::INT + (k % 5 = 0)::INT, 20 - (k % 4 = 0)::INT - (k % 5 = 0)::INT, 22, 22 - 2 * (k % 4 = 0)::INT FROM forms WHERE family = 'passbook'
  UNION ALL SELECT doc_id, family, odd, CASE WHEN odd THEN 'passbook' ELSE 'pan_card' END, CASE WHEN odd THEN 22 ELSE 8 END, CASE WHEN odd THEN 10 + ({_LEFT} NOT BETWEEN 9 AND 18)::INT ELSE (k % 7 = 0)::INT END, CASE WHEN odd THEN 10 ELSE 3 - (k % 5 = 0)::INT END, CASE WHEN odd THEN 4 ELSE 5 END, 8,
    5 + CASE WHEN odd THEN NOT contains({_SPOKEN_DAY}, '1') ELSE k % 5 = 0 END::INT FROM (SELECT *, {odd} AS odd FROM forms WHERE family = 'pan_card')
  UNION ALL SELECT doc_id, family, false, 'aadhaar_full', 19, (k % 6 = 0)::INT, 11, 65, 100, 8 FROM forms WHERE family = 'aadhaar_full' AND k % 7 > 0
  UNION ALL SELECT doc_id, family, false, 'aadhaar_front', 7, 1, 3, 3, 7, 3 FROM forms WHERE family = 'aadhaar_full' AND k % 7 = 0 AND k % 2 = 1
  UNION ALL SELECT doc_id, family, taxed, CASE WHEN taxed THEN 'pan_card' ELSE 'unknown' END, CASE WHEN taxed THEN 8 ELSE 0 END, CASE WHEN taxed THEN 4 ELSE 0 END, CASE WHEN taxed THEN 4 ELSE 0 END, CASE WHEN taxed THEN 55 ELSE 200 / 7 END, 100, taxed::INT
    FROM (SELECT *, {taxed} AS taxed FROM forms WHERE family = 'aadhaar_full' AND k % 7 = 0 AND k % 2 = 0))"""


@query(f"WITH {forms.WITH} SELECT * EXCLUDE (family) FROM ({_judged(True)})")
def rank_candidates(spark, sf_dir):
    """Three readings of each form, the best kept by the eight keys."""
    readings = forms.candidates(spark, sf_dir).select("doc_id", "engine", "ordinal", "text")
    records = extract.extract(readings, keep=["doc_id", "engine", "ordinal", "confidence_percent"])
    out = rank.best(rank.scored(validate.summary(records)))
    return out.select("doc_id", "engine", "type", "ready", "valid_fields", "invalid_fields", "warnings", "confidence_percent", F.col("score.filled").alias("filled"))


# -- evaluation ---------------------------------------------------------------

_PAIRS = """SELECT o_orderkey AS image, m.model, f.field, f.expected, f.extracted FROM (SELECT o_orderkey, cast(cast(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS p, cast(o_orderdate AS DATE) AS d, o_orderpriority AS q FROM orders),
 (VALUES ('doctr', 0), ('easyocr', 1), ('paddleocr', 2)) AS m(model, n),
 unnest([{'field': 'total', 'expected': p, 'extracted': CASE WHEN (o_orderkey + n) % 5 = 0 THEN '' ELSE 'RM ' || p END},
  {'field': 'date', 'expected': strftime(d, '%d/%m/%Y'), 'extracted': CASE WHEN (o_orderkey + n) % 4 = 0 THEN strftime(d, '%m/%Y') ELSE strftime(d, '%Y-%m-%d') END},
  {'field': 'receipt_number', 'expected': CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'R-' || cast(o_orderkey AS STRING) END, 'extracted': 'r ' || cast(o_orderkey AS STRING)},
  {'field': 'company', 'expected': 'Store ' || cast(o_orderkey % 50 AS STRING) || ' Trading Sdn Bhd',
   'extracted': CASE (o_orderkey + n) % 4 WHEN 0 THEN 'STORE ' || cast(o_orderkey % 50 AS STRING) || ', TRADING SDN. BHD' WHEN 1 THEN 'Store ' || cast(o_orderkey % 50 AS STRING) || ' Trading' WHEN 2 THEN '---' ELSE 'bhd sdn trading store ' || cast(o_orderkey % 50 AS STRING) END},
  {'field': 'address', 'expected': 'Lot ' || cast(o_orderkey % 90 AS STRING) || ' Jalan Raya 50450 Kuala Lumpur', 'extracted': left('Lot ' || cast(o_orderkey % 90 AS STRING) || ' Jalan Raya 50450 Kuala Lumpur', cast(4 + (o_orderkey + n) % 29 AS INT))},
  {'field': 'source_image', 'expected': 'x.png', 'extracted': 'y.png'}]) AS u(f)"""
_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9ऀ-ॿ ]+', ' ', 'g')), ' '), lambda x: x <> ''))"
#: The sequence ratio of a text and a beginning of it is known: twice the shorter over both.
_SIMILAR = """CASE WHEN len(a) = 0 THEN 0 ELSE round_even(100 * greatest(len(list_intersect(a, b)) / len(b), CASE WHEN starts_with(y, x) THEN 2 * len(x) / (len(x) + len(y)) ELSE 0 END), 2) END"""
_COMPARED = f"""pairs AS ({_PAIRS}),
fuzzy AS (SELECT *, field IN ('company', 'address') AS near, {_TOKENS.format('extracted').replace('list_distinct', '')} AS ta, {_TOKENS.format('expected').replace('list_distinct', '')} AS tb FROM pairs),
sides AS (SELECT *, list_distinct(ta) AS a, list_distinct(tb) AS b, array_to_string(ta, ' ') AS x, array_to_string(tb, ' ') AS y FROM fuzzy),
scored AS (SELECT *, field <> 'source_image' AND expected <> '' AS used, CASE WHEN near THEN {_SIMILAR} END AS s FROM sides),
compared AS (SELECT image, model, field, used, used AND CASE field
  WHEN 'total' THEN regexp_extract(extracted, '[0-9.]+') = expected
  WHEN 'date' THEN extracted LIKE '____-__-__'
  WHEN 'company' THEN s >= 80
  WHEN 'address' THEN s >= 65
  ELSE true END AS match, CASE WHEN used THEN coalesce(s, CASE WHEN match THEN 100.0 ELSE 0.0 END) END AS similarity FROM scored)"""


@query(f"""WITH {forms.WITH}, said AS (SELECT doc_id, k, k % 17 > 0 AS dated, CASE WHEN k % 7 = 0 THEN regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) ELSE regexp_extract(text, 'RM ([0-9.]+)', 1) END
    = cast(cast(amount * 1.06 AS DECIMAL(18, 2)) AS STRING) AS whole FROM forms JOIN sales USING (k) WHERE family = 'invoice'),
  counted AS (SELECT doc_id AS image, 3 + cast(dated AS INT) AS total, 2 + cast(dated AS INT) + cast(whole AS INT) AS matched, k FROM said)
SELECT image, 'doctr' AS model, 'front' AS side, 'shadow' AS quality, round_even(CASE WHEN k % 11 = 0 THEN 0 ELSE matched * 100.0 / total END, 2) AS accuracy, k % 11 = 0 AS failed, k % 11 > 0 AND matched = total AS complete FROM counted""")
def batch_receipts(spark, sf_dir):
    """A batch over receipts as one engine read them, every eleventh failed; the total of some has no label."""
    rows = forms.forms(spark, sf_dir).where("family = 'invoice'")
    path = F.concat("doc_id", F.lit("_shadow.png"))
    readings = rows.select(F.col("doc_id").alias("image"), path.alias("path"), F.lit("unknown").alias("side"), F.lit("doctr").alias("model"), "text", F.when(F.col("k") % 11 == 0, "lost").otherwise("").alias("error"), F.lit(1.0).alias("seconds"))
    sums = forms.view(spark, sf_dir, "SELECT 'invoice-' || cast(k AS STRING) AS image, k, cast(cast(amount * 1.06 AS DECIMAL(18, 2)) AS STRING) AS total, d FROM sales")
    said = {"total": F.col("total"), "date": F.when(F.col("k") % 17 > 0, F.date_format("d", "yyyy-MM-dd")), "receipt_number": F.concat(F.lit("r-"), (100000 + F.col("k")).cast("string")), "company": F.concat(F.lit("Store "), (F.col("k") % 50).cast("string"), F.lit(" Sdn Bhd")), "source_image": F.lit("y.png")}
    truth = sums.select("image", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("expected")) for f, c in said.items()])).alias("t")).select("image", "t.*")
    return batch.scored(readings, batch.compared(readings, truth, "invoice"), "invoice").drop("seconds")


def _pairs(spark, sf_dir) -> DataFrame:
    o = spread(_t(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("image"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"), F.col("o_orderdate").cast("date").alias("d"))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("n")) for i, m in enumerate(("doctr", "easyocr", "paddleocr"))])).alias("m")
    rows = o.select("*", models).select("image", "p", "d", "m.model", "m.n")
    k, n = F.col("image"), F.col("n")
    day = lambda p: F.date_format("d", p)
    entry = lambda f, e, x: F.struct(F.lit(f).alias("field"), e.alias("expected"), x.alias("extracted"))
    store, place = F.concat(F.lit("Store "), (k % 50).cast("string")), F.concat(F.lit("Lot "), (k % 90).cast("string"), F.lit(" Jalan Raya 50450 Kuala Lumpur"))
    kinds = F.when((k + n) % 4 == 0, F.concat(F.upper(store), F.lit(", TRADING SDN. BHD"))).when((k + n) % 4 == 1, F.concat(store, F.lit(" Trading")))
    company = kinds.when((k + n) % 4 == 2, "---").otherwise(F.concat(F.lit("bhd sdn trading "), F.lower(store)))
    each = F.array(
        entry("total", F.col("p"), F.when((k + n) % 5 == 0, "").otherwise(F.concat(F.lit("RM "), "p"))),
        entry("date", day("dd/MM/yyyy"), F.when((k + n) % 4 == 0, day("MM/yyyy")).otherwise(day("yyyy-MM-dd"))),
        entry("receipt_number", F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("R-"), k.cast("string"))), F.concat(F.lit("r "), k.cast("string"))),
        entry("company", F.concat(store, F.lit(" Trading Sdn Bhd")), company),
        entry("address", place, place.substr(F.lit(1), (4 + (k + n) % 29).cast("int"))),
        entry("source_image", F.lit("x.png"), F.lit("y.png")),
    )
    return rows.select("image", "model", F.explode(each).alias("f")).select("image", "model", "f.field", "f.expected", "f.extracted")


@query(f"""WITH {_COMPARED} SELECT image, model, field, used, match, CASE WHEN field = 'source_image' THEN 'metadata field' WHEN NOT used THEN 'ground truth value not present' ELSE '' END AS reason,
  similarity FROM compared""")
def compare_fields(spark, sf_dir):
    return evaluate.compare(_pairs(spark, sf_dir)).select("image", "model", "field", "used", "match", "reason", "similarity")


@query(f"""WITH {_COMPARED} SELECT image, model, matched_fields, scored_fields, round(matched_fields * 100.0 / scored_fields, 2) AS accuracy, matched_fields = scored_fields AS complete
FROM (SELECT image, model, count(*) FILTER (WHERE match) AS matched_fields, count(*) FILTER (WHERE used) AS scored_fields FROM compared GROUP BY image, model)""")
def document_accuracy(spark, sf_dir):
    return evaluate.accuracy(evaluate.compare(_pairs(spark, sf_dir)), ["image", "model"]).select("image", "model", "matched_fields", "scored_fields", F.round("accuracy", 2).alias("accuracy"), "complete")


@query(f"""WITH {_COMPARED}, per AS (SELECT field, model, round(avg(match::INT) * 100, 2) AS accuracy, round(avg(similarity), 2) AS similarity, count(*) AS n FROM compared WHERE used GROUP BY field, model)
SELECT field, model, accuracy, similarity, max(n) OVER (PARTITION BY field) AS evaluated FROM per""")
def field_accuracy(spark, sf_dir):
    return report.field_summary(evaluate.compare(_pairs(spark, sf_dir)))


@query(f"""WITH {forms.WITH_CANDIDATES}, t AS (SELECT c.doc_id, c.engine, {_TOKENS.format('c.text')} AS a, {_TOKENS.format('f.text')} AS b FROM candidates c JOIN forms f USING (doc_id))
SELECT doc_id, engine, round(len(list_intersect(a, b)) * 1.0 / len(b), 6) AS recall FROM t""")
def token_recall(spark, sf_dir):
    c, f = forms.candidates(spark, sf_dir), forms.forms(spark, sf_dir).select("doc_id", F.col("text").alias("truth"))
    return c.join(f, "doc_id").select("doc_id", "engine", F.round(evaluate.token_recall(F.col("text"), F.col("truth")), 6).alias("recall"))


_TEXTS = """texts AS (SELECT p_partkey AS k, p_name || ' ' || p_brand || ' ' || p_type || ' ' || cast(p_size AS STRING) AS t FROM part),
long AS (SELECT k // 8 AS k, string_agg(t, ', ' ORDER BY k) AS t FROM texts GROUP BY k // 8),
pairs AS (SELECT 'part' AS kind, a.k, a.t AS a, b.t AS b FROM texts a JOIN texts b ON b.k = a.k + 1
  UNION ALL SELECT 'page', a.k, a.t, b.t FROM long a JOIN long b ON b.k = a.k + 1),
known AS (SELECT *, row_number() OVER () AS id FROM pairs)"""
#: The blocks one after another: runs of equal letters on diagonals, the longest without popular ones, with what joins it.
_RATIO = f"""WITH RECURSIVE {_TEXTS},
la AS (SELECT id, i, a[i] AS c FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM known)),
lb AS (SELECT id, j, b[j] AS c, len(b) AS n FROM (SELECT id, b, unnest(range(1, len(b) + 1)) AS j FROM known)),
often AS (SELECT id, c FROM lb WHERE n >= 200 GROUP BY id, c, n HAVING count(*) > n // 100 + 1),
eq AS MATERIALIZED (SELECT la.id, i, j, i - j AS d, o.c IS NULL AS good FROM la JOIN lb ON la.id = lb.id AND la.c = lb.c LEFT JOIN often o ON o.id = la.id AND o.c = la.c),
work AS (
  SELECT id, 1 AS a0, len(a) + 1 AS a1, 1 AS b0, len(b) + 1 AS b1, 0 AS got FROM known
  UNION ALL
  SELECT id, u.p.a0, u.p.a1, u.p.b0, u.p.b1, u.p.got FROM (
    SELECT id, unnest([{{'a0': a0, 'a1': i, 'b0': b0, 'b1': j, 'got': n}}, {{'a0': i + n, 'a1': a1, 'b0': j + n, 'b1': b1, 'got': 0}}]) AS p FROM (
      SELECT id, a0, a1, b0, b1, x['i'] AS i, x['j'] AS j, x['n'] AS n FROM (SELECT id, a0, a1, b0, b1, arg_min({{'i': i, 'j': j, 'n': n}}, {{'m': -coalesce(m, 0), 's': s, 't': t}}) AS x FROM (
        SELECT id, a0, a1, b0, b1, d, min(i) AS i, min(j) AS j, count(*) AS n, max(m) AS m, coalesce(min(s) FILTER (WHERE m = top), min(i)) AS s, coalesce(min(t) FILTER (WHERE m = top), min(j)) AS t FROM (
          SELECT *, max(m) OVER (PARTITION BY id, a0, b0, d, run) AS top FROM (
            SELECT *, CASE WHEN good THEN count(*) OVER g END AS m, CASE WHEN good THEN min(i) OVER g END AS s, CASE WHEN good THEN min(j) OVER g END AS t FROM (
              SELECT *, i - row_number() OVER (PARTITION BY id, a0, b0, d, good ORDER BY i) AS inner_run FROM (
                SELECT w.*, e.i, e.j, e.d, e.good, e.i - row_number() OVER (PARTITION BY w.id, w.a0, w.b0, e.d ORDER BY e.i) AS run
                FROM work w JOIN eq e ON e.id = w.id AND e.i >= w.a0 AND e.i < w.a1 AND e.j >= w.b0 AND e.j < w.b1))
            WINDOW g AS (PARTITION BY id, a0, b0, d, run, good, inner_run)))
        GROUP BY id, a0, a1, b0, b1, d, run HAVING max(m) IS NOT NULL OR (min(i) = a0 AND min(j) = b0))
      GROUP BY id, a0, a1, b0, b1))) AS u(id, p) WHERE u.p.a0 < u.p.a1 AND u.p.b0 < u.p.b1 OR u.p.got > 0)
SELECT kind, k, round_even(2.0 * got / (len(a) + len(b)), 6) AS ratio FROM known JOIN (SELECT id, sum(got) AS got FROM work GROUP BY id) USING (id)"""


@query(_RATIO)
def sequence_ratio(spark, sf_dir):
    """How alike neighbouring descriptions are, short ones and, joined by eight, long ones with popular letters."""
    texts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ", ").alias("t")
    long = texts.groupBy(F.expr("k div 8").alias("g")).agg(joined).withColumnRenamed("g", "k")
    pairs = []
    for kind, rows in (("part", texts), ("page", long)):
        after = rows.select((F.col("k") - 1).alias("k"), F.col("t").alias("b"))
        pairs.append(rows.select("k", F.col("t").alias("a")).join(after, "k").withColumn("kind", F.lit(kind)))
    rows = spread(pairs[0].unionByName(pairs[1]), _t(spark, sf_dir, "part"))
    return rows.select("kind", "k", F.bround(evaluate.sequence_ratio("a", "b"), 6).alias("ratio"))


# -- reports ------------------------------------------------------------------

_RUNS = """runs AS (SELECT o_orderkey AS image, CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, o_orderpriority AS quality, m.model,
  CASE WHEN (o_orderkey + n) % 13 = 0 THEN NULL ELSE cast((o_orderkey * (n + 3)) % 101 AS DOUBLE) END AS accuracy, CASE WHEN (o_orderkey + n) % 17 = 0 THEN NULL ELSE ((o_orderkey + n) % 8) * 0.25 END AS seconds,
  (o_orderkey + n) % 13 = 0 AS failed, (o_orderkey * (n + 3)) % 101 = 100 AS complete FROM orders, (VALUES ('doctr', 0), ('easyocr', 1), ('paddleocr', 2)) AS m(model, n))"""


def _runs(spark, sf_dir) -> DataFrame:
    k, n = F.col("image"), F.col("m.n")
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("n")) for i, m in enumerate(("doctr", "easyocr", "paddleocr"))])).alias("m")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("quality"), models)
    failed, mark = (k + n) % 13 == 0, (k * (n + 3)) % 101
    return rows.select(
        "image", F.when(k % 2 == 0, "front").otherwise("back").alias("side"), "quality", "m.model",
        F.when(~failed, mark.cast("double")).alias("accuracy"), F.when((k + n) % 17 != 0, ((k + n) % 8) * 0.25).alias("seconds"),
        failed.alias("failed"), (mark == 100).alias("complete"),
    )


_AVERAGE = "count(DISTINCT image) AS images, round_even(avg(coalesce(accuracy, 0)), 2) AS accuracy, round_even(coalesce(avg(seconds), 0), 4) AS seconds"


@query(f"""WITH {_RUNS}, per AS (SELECT quality, model, {_AVERAGE} FROM runs GROUP BY quality, model)
SELECT quality, max(images) AS images, first(model ORDER BY accuracy DESC, model) AS best_model, max(accuracy) AS best_accuracy, last(model ORDER BY accuracy DESC, model) AS worst_model, min(accuracy) AS worst_accuracy,
  first(model ORDER BY seconds, model) AS fastest_model, min(seconds) AS fastest_seconds, last(model ORDER BY seconds, model) AS slowest_model, max(seconds) AS slowest_seconds, round(max(accuracy) - min(accuracy), 2) AS accuracy_difference
FROM per GROUP BY quality""")
def quality_summary(spark, sf_dir):
    return report.quality_summary(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS} SELECT CASE WHEN grouping(side) = 0 THEN 'document side' ELSE 'image quality category' END AS group_name, coalesce(side, quality) AS value, model, {_AVERAGE}
FROM runs GROUP BY GROUPING SETS ((side, model), (quality, model))""")
def accuracy_summary(spark, sf_dir):
    return report.accuracy_summary(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS} SELECT model, count(*) AS images, round_even(avg(accuracy), 2) AS accuracy, round_even(avg(seconds), 4) AS seconds, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE complete) AS complete,
  round_even(count(*) FILTER (WHERE complete) * 100.0 / count(*), 2) AS complete_rate FROM runs GROUP BY model""")
def model_summary(spark, sf_dir):
    return report.model_summary(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT image, max(accuracy) FILTER (WHERE model = 'doctr') AS doctr, max(accuracy) FILTER (WHERE model = 'easyocr') AS easyocr, max(accuracy) FILTER (WHERE model = 'paddleocr') AS paddleocr FROM runs GROUP BY image")
def accuracy_pivot(spark, sf_dir):
    return report.pivoted(_runs(spark, sf_dir), ["doctr", "easyocr", "paddleocr"])


# -- files, JSON, review ------------------------------------------------------


@query("SELECT page_id, 'unknown' AS of_html, 'pdf' AS of_pdf, 'png' AS of_png, 'jpg' AS of_jpg FROM pages")
def sniff_file_type(spark, sf_dir):
    raw = lambda head: F.concat(F.unhex(F.lit(head)), F.col("html").cast("binary"))
    return _t(spark, sf_dir, "pages").select(
        "page_id", files.magic_type(F.col("html").cast("binary")).alias("of_html"), files.magic_type(raw("255044462D")).alias("of_pdf"),
        files.magic_type(raw("89504E470D0A")).alias("of_png"), files.magic_type(raw("FFD8FFE0")).alias("of_jpg"),
    )


_SAFE = r"(SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN 'uploaded_document' ELSE n END AS safe_name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._ -]+', '_', 'g'), '\s+', ' ', 'g')) AS n FROM pages))"


@query(f"""SELECT page_id, safe_name, CASE WHEN n = 0 THEN safe_name ELSE regexp_extract(safe_name, '^(.+?)(\\.[^.]*)?$', 1) || '_' || cast(n AS STRING) || regexp_extract(safe_name, '^(.+?)(\\.[^.]*)?$', 2) END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY safe_name ORDER BY page_id) - 1 AS n FROM {_SAFE})""")
def unique_file_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", tx.safe_file_name(F.col("url")).alias("safe_name"))
    return review.unique_names(rows, "safe_name", ["page_id"])


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing, coalesce(json_extract_string(props, '$.k'), '') AS wrapped FROM events")
def json_object_parse(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    keys = F.array(F.lit("k"), F.lit("missing"))
    plain = model_json.projected(model_json.json_object(F.col("props")), keys)
    talk = model_json.projected(model_json.json_object(F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Anything else?"))), keys)
    return rows.select("event_id", plain["k"].alias("k"), plain["missing"].alias("missing"), talk["k"].alias("wrapped"))


_KEY = "coalesce(json_extract_string(props, '$.k'), '')"


@query(f"""SELECT event_id, cast(i AS INT) AS place, line FROM (SELECT event_id, unnest(['row ' || {_KEY}, 'total', 'cell ' || cast(event_id AS STRING), '7', 'x', 'leaf ' || {_KEY}]) AS line, unnest(range(0, 6)) AS i FROM events WHERE event_id % 10 > 0)""")
def nested_lines(spark, sf_dir):
    """Lines of nested engine output built around the events' properties; every tenth is not JSON."""
    rows = spread(_t(spark, sf_dir, "events"))
    said = tx.text_or_empty(F.get_json_object("props", "$.k"))
    raw = F.concat(
        F.when(F.col("event_id") % 10 == 0, "{").otherwise(""), F.lit('{"rec_texts": ["row '), said, F.lit('", " ", "total"], "page": {"texts": "row '), said, F.lit('", "inner": [[[0, 1], ["cell '), F.col("event_id").cast("string"),
        F.lit(' ", 0.9]], {"text": 7}]}, "extra": "ignored", "z": [["deep", ["x", ["leaf '), said, F.lit('", 1]]]]}'),
    )
    return nested.text_lines(rows.select("event_id", raw.alias("raw")), "event_id", "raw")


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT unnest(['name', 'segment', 'balance', 'nation']) AS value UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT n_name FROM nation)")
def shared_strings(spark, sf_dir):
    """The texts and headings of two sheets, each once, with the numbers by which a workbook refers to them."""
    customers = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return sinks.shared_strings([customers, _t(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))])


@query(f"WITH {forms.WITH} SELECT family || '/' || CASE WHEN k % 2 = 0 THEN 'image' ELSE 'pdf' END || '/' || family || CASE WHEN n = 0 THEN '' ELSE '_' || cast(n AS STRING) END || '.json' AS file, doc_id, cast(len(text) AS INT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY family, k % 2 = 0 ORDER BY doc_id) - 1 AS n FROM forms WHERE k < 20)")
def record_files(spark, sf_dir):
    """A file for each record of the first customers and suppliers, written by tasks, and read back."""
    rows = forms.forms(spark, sf_dir).where("k < 20").withColumn("file_format", F.when(F.col("k") % 2 == 0, "image").otherwise("pdf"))
    rows = rows.withColumn("name", F.concat_ws("/", "family", "file_format", "family"))
    named = review.unique_names(rows, "name", ["doc_id"])
    body = F.to_json(F.struct("doc_id", F.length("text").alias("n_chars")))
    folder = shared_folder(spark, "records")
    sinks.write_record_files(named.select(F.col("family").alias("document_name"), "file_format", F.element_at(F.split("unique_name", "/"), -1).alias("name"), body.alias("body")), folder)
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    file = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3), "/")
    return read.select(file.alias("file"), F.from_json("value", "doc_id string, n_chars int").alias("x")).select("file", "x.*")


_FIELDS = "fields AS (SELECT c_custkey AS id, f.field, f.value FROM customer, unnest([{'field': 'employee_name', 'value': c_name}, {'field': 'bank_name', 'value': c_mktsegment}, {'field': 'total', 'value': cast(c_custkey AS STRING)}]) AS u(f))"
_CHANGES = "edits AS (SELECT c_custkey AS id, 'bank_name' AS field, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE upper(c_name) END AS edited FROM customer WHERE c_custkey % 3 = 0)"


@query(f"""WITH {_FIELDS}, {_CHANGES} SELECT id, field, value AS original, coalesce(edited, value) AS value, coalesce(edited, value) <> value AS is_edited, CASE field WHEN 'total' THEN 'Invoice' ELSE 'Identity' END AS field_group
FROM fields LEFT JOIN edits USING (id, field)""")
def review_overlay(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    entry = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    each = F.array(entry("employee_name", F.col("c_name")), entry("bank_name", F.col("c_mktsegment")), entry("total", F.col("id").cast("string")))
    rows = c.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.value")
    edits = c.where("id % 3 = 0").select("id", F.lit("bank_name").alias("field"), F.when(F.col("id") % 6 == 0, F.col("c_mktsegment")).otherwise(F.upper("c_name")).alias("edited"))
    return review.overlay(rows, edits, ["id"]).withColumn("field_group", review.field_group(F.col("field")))


_SHOWN = ", ".join(f"('{t}', '{f}')" for t, own in review.DISPLAYED.items() for f in own)
_PAGE = f"""listed(type, field) AS (VALUES {_SHOWN}),
fields AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'aadhaar_front' WHEN 1 THEN 'aadhaar_back' WHEN 2 THEN 'aadhaar_full' ELSE 'employee_form' END AS type, f.field, f.value, f.valid, f.warning, f.edited FROM customer, unnest([
  {{'field': 'name', 'value': c_name, 'valid': true, 'warning': '', 'edited': c_custkey % 6 = 0}},
  {{'field': 'pincode', 'value': CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '411001' END, 'valid': c_custkey % 3 <> 0, 'warning': '', 'edited': false}},
  {{'field': 'hindi_address', 'value': '', 'valid': true, 'warning': 'Optional field missing', 'edited': false}},
  {{'field': 'bank_name', 'value': CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END, 'valid': true, 'warning': '', 'edited': false}},
  {{'field': 'total', 'value': NULL, 'valid': NULL, 'warning': NULL, 'edited': false}}]) AS u(f)),
shown AS (SELECT f.* FROM fields f LEFT JOIN listed l ON l.type = f.type AND l.field = f.field WHERE l.field IS NOT NULL OR f.type NOT IN (SELECT type FROM listed) OR trim(coalesce(f.value, '')) <> '')"""


def _page(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    entry = lambda f, v, ok=F.lit(True), w=F.lit(""), e=F.lit(False): F.struct(F.lit(f).alias("field"), v.alias("value"), ok.alias("valid"), w.alias("warning"), e.alias("is_edited"))
    none = F.lit(None)
    each = F.array(
        entry("name", F.col("c_name"), e=k % 6 == 0),
        entry("pincode", F.when(k % 3 == 0, "").otherwise("411001"), k % 3 != 0),
        entry("hindi_address", F.lit(""), w=F.lit(validate.OPTIONAL)),
        entry("bank_name", F.when(k % 5 == 0, " ").otherwise(F.col("c_mktsegment"))),
        entry("total", none.cast("string"), none.cast("boolean"), none.cast("string")),
    )
    kind = F.when(k % 4 == 0, "aadhaar_front").when(k % 4 == 1, "aadhaar_back").when(k % 4 == 2, "aadhaar_full").otherwise("employee_form")
    return review.projection(_t(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("type"), F.explode(each).alias("f")).select("id", "type", "f.*"))


@query(f"""WITH {_PAGE} SELECT id, type, field, CASE field WHEN 'total' THEN 'Invoice' WHEN 'pincode' THEN 'Address' WHEN 'hindi_address' THEN 'Address' ELSE 'Identity' END AS field_group,
  CASE field WHEN 'total' THEN 5 WHEN 'pincode' THEN 3 WHEN 'hindi_address' THEN 3 ELSE 1 END AS group_order, CASE field WHEN 'bank_name' THEN 'Bank Name' WHEN 'hindi_address' THEN 'Hindi Address' ELSE upper(field[1]) || field[2:] END AS label FROM shown""")
def display_fields(spark, sf_dir):
    """The fields that each type's page shows, in groups: listed ones always, others if they have a value."""
    return _page(spark, sf_dir).select("id", "type", "field", "field_group", "group_order", "label")


@query(f"""WITH {_PAGE} SELECT id, type, count(*) AS checked, count(*) FILTER (WHERE coalesce(valid, false)) AS ready_fields, count(*) FILTER (WHERE NOT coalesce(valid, true)) AS invalid_fields, count(*) FILTER (WHERE warning <> '') AS warnings,
  count(*) FILTER (WHERE edited OR NOT coalesce(valid, true) OR coalesce(warning, '') <> '') AS to_review FROM shown GROUP BY id, type""")
def display_counts(spark, sf_dir):
    """How many of the shown fields of each page are ready, invalid, warned about, and need a look."""
    return review.shown_counts(_page(spark, sf_dir), ["id", "type"])


_GROUP = "CASE " + " ".join(f"WHEN regexp_matches(field, '{'|'.join(parts)}') THEN '{g}'" for g, parts in review.GROUPS.items()) + " ELSE 'Other' END"
_PLACE_OF = "CASE " + " ".join(f"WHEN regexp_matches(field, '{'|'.join(parts)}') THEN {i}" for i, parts in enumerate(review.GROUPS.values(), 1)) + f" ELSE {len(review.GROUPS) + 1} END"


@query(f"""WITH {forms.WITH}, x AS ({_EXTRACTED}), listed(type, field) AS (VALUES {_SHOWN})
SELECT doc_id, type, field, value, {_GROUP} AS field_group, {_PLACE_OF} AS group_order FROM x
WHERE (type, field) IN (SELECT (type, field) FROM listed) OR type NOT IN (SELECT type FROM listed) OR trim(value) <> ''""")
def display_records(spark, sf_dir):
    """What the pages of all forms show of the fields that extraction gave."""
    shown = review.projection(extract.long_fields(_records(spark, sf_dir), ["doc_id"]))
    return shown.select("doc_id", "type", "field", "value", "field_group", "group_order")


@query("SELECT user_id AS file_name, event_id AS review_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_review(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file_name"), F.col("event_id").alias("review_id"), F.col("event_type").alias("status"), F.col("ts").alias("reviewed_at"))
    return review.latest(rows).select("file_name", "review_id", "status")


@query("SELECT doc_id, cast((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits, cast(instr(lower(text), 'the') AS INT) AS first_at FROM documents")
def highlight_text(spark, sf_dir):
    at = review.highlights(F.col("text"), "the")
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(at).cast("long").alias("hits"), F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(0)).alias("first_at"))


QUERIES["record_flow"] = flagship
SQL["record_flow"] = f"WITH {forms.WITH} SELECT family, type, ready, count(*) AS documents, cast(sum(invalid_fields) AS BIGINT) AS invalid_fields, cast(sum(warnings) AS BIGINT) AS warnings FROM ({_judged(False)}) GROUP BY family, type, ready"


# -- streaming ----------------------------------------------------------------


def _as_stream(table: DataFrame, name: str, files: int) -> tuple[DataFrame, str]:
    """A table as a stream of ``files`` micro-batches, dealt out by a hash, and the folder of its run."""
    base = shared_folder(table.sparkSession, name)
    table.repartition(files, F.xxhash64(*table.columns)).write.parquet(f"{base}/in")
    return table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


@query(SQL["latest_review"])
def stream_latest_review(spark, sf_dir):
    """The rows of ``latest_review`` from a stream of five parts in no order, so that most reviews come late."""
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file_name"), F.col("event_id").alias("review_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("reviewed_at"))
    stream, base = _as_stream(rows, "reviews", 5)
    with ingest.state_store(spark):
        run = ingest.process(ingest.latest_reviews(stream), lambda changed: changed, f"{base}/out", f"{base}/state", "update")
        run.awaitTermination()
    return review.latest(spark.read.parquet(f"{base}/out")).select("file_name", "review_id", "status")


@query("SELECT event_type, cast(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    """The events as a stream that ends, counted by type and hour."""
    # a stream reads a folder of files, which the table may not be
    stream, base = _as_stream(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "events", 1)
    counts = ingest.windowed_events(stream)
    run = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out"))
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")
