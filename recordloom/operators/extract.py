"""Field values: slices between labels, overlaid by what patterns find in the text.

Every overlay is an expression over the text, its cleaned lines and the slices;
the order of what counts first is written out in each field's line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_value, first_of, fold_digits, group, has_script, iso_date, iso_date_repair, item, let, lines_of, slash_date, text_or_empty
from . import schemas
from .classify import classify
from .spans import with_slices

# Phrases of cards and their footers. Last, first or middle of three fours of digits, 1800 is of an id number
# and no free call; after 1800 and a four the third may lack a digit.
_FOUR = r"(?<!\d)\d{4}[^\S\n]{1,9}"
_FREE_CALL = (
    rf"1800(?<!{_FOUR}{_FOUR}1800)"
    r"(?![^\S\n]+\d{4}(?:[^\S\n]+\d{3,4}|\s+\d{4})(?!\d))"
    rf"(?!(?<={_FOUR}1800)[^\S\n]+\d{{4}}(?!\d))"
)
_FOOTER = rf"(?iU)\b(?:P\.?\s*O\.?\s*Box|help@|www\.|Bengaluru|{_FREE_CALL})\b"
_ADDRESS_END = rf"(?iU)\b(?:P\.?\s*O\.?\s*Box|help@|www\.|Bengaluru|{_FREE_CALL}|UIDAI|UNIQUE IDENTIFICATION)\b"
_SCRIPT_END = rf"(?iU)\b(?:UNIQUE IDENTIFICATION|GOVERNMENT OF INDIA|help@|www\.|P\.?\s*O\.?\s*Box|Bengaluru|{_FREE_CALL})\b"
_PIN = r"(?U)(?<!\d)([1-9]\d{5})(?!\d)"
_PIN_LINE = r"(?U)^[1-9]\d{5}$"
_NAME = r"[A-Z][A-Za-z]+(?:(?U:\s)+[A-Z][A-Za-z]+){1,3}"
_CAPITALS = r"^[A-Z][A-Z ]{3,}$"
_STATE_NAMES = ("भारत सरकार", "भारतीय विशिष्ट पहचान प्राधिकरण")


def id_number(c: Column) -> Column:
    """The first 4-4-4 group of digits, else the first run of 12, in fours."""
    grouped, run = r"(?U)(?<!\d)(\d{4}\s+\d{4}\s+\d{4})(?!\d)", r"(?U)(?<!\d)(\d{12})(?!\d)"
    return let(c, lambda c: _fours(c, grouped, run, 3))


def _fours(c: Column, grouped: str, run: str, n: int) -> Column:
    digits = group(c, run)
    fours = F.concat_ws(" ", *[F.substring(digits, 1 + 4 * k, 4) for k in range(n)])
    return F.when(c.rlike(grouped), group(c, grouped)).when(c.rlike(run), fours).otherwise("")


def virtual_id(c: Column) -> Column:
    grouped, run = r"(?U)(?<!\d)(\d{4}\s+\d{4}\s+\d{4}\s+\d{4})(?!\d)", r"(?U)(?<!\d)(\d{16})(?!\d)"
    return let(c, lambda c: _fours(c, grouped, run, 4))


def pincode(c: Column) -> Column:
    """The last six-digit number before the footer, the id number aside."""
    without = lambda area: let(id_number(area), lambda n: F.when(n != "", F.replace(area, n, F.lit(" "))).otherwise(area))
    area = let(F.regexp_replace(c, "(?s)" + _FOOTER + ".*", ""), without)
    return item(F.regexp_extract_all(area, F.lit(_PIN), F.lit(1)), -1)


def first_line(lines: Column, test: Callable[[Column], Column]) -> Column:
    return item(F.filter(lines, test), 1)


def after_label(lines: Column, labels: list[str]) -> Column:
    """What follows a label on the first line that has one, or the next line if nothing does.

    Labels are tried in their order on each line, whatever their case.
    """

    def in_order(line: Column, low: Column, i: Column) -> Column:
        out = None
        for label in (x.lower() for x in labels):
            rest = clean_value(line.substr(F.instr(low, label) + len(label), F.length(line)))
            value = first_of(rest, item(lines, i + 2))
            out = F.when(low.contains(label), value) if out is None else out.when(low.contains(label), value)
        return out

    def on_line(line: Column, i: Column) -> Column:
        return let(F.lower(line), lambda low: in_order(line, low, i))

    return item(F.array_compact(F.transform(lines, on_line)), 1)


def _until(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """The lines before the first that stops."""
    cut = lambda x: let(F.array_position(F.transform(x, stop), F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(x, F.lit(1), at - 1)).otherwise(x))
    return let(lines, cut)


def _from_first(lines: Column, test: Callable[[Column], Column], skip: int) -> Column:
    """Lines from the first that passes, without ``skip`` of them; empty if none does."""
    none = F.array().cast("array<string>")
    cut = lambda x: let(F.array_position(F.transform(x, test), F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(x, at + skip, F.size(x) + 1)).otherwise(none))
    return let(lines, cut)


def _through(lines: Column, last: Callable[[Column], Column]) -> Column:
    """The lines up to and with the first that is the last."""
    cut = lambda x: let(F.array_position(F.transform(x, last), F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(x, F.lit(1), at)).otherwise(x))
    return let(lines, cut)


def english_address(lines: Column) -> Column:
    """Lines after that of the relation, up to the id number, the footer or a bare pincode."""
    relation = r"(?iU)\b(?:S/O|C/O|W/O)\s*[:：]"
    rest = _from_first(lines, lambda x: x.rlike(relation), 1)
    rest = _until(rest, lambda x: (id_number(x) != "") | x.rlike(_ADDRESS_END))

    def cleaned(line: Column) -> Column:
        line = F.regexp_replace(line, r"\p{IsDevanagari}+", " ")
        line = F.regexp_replace(line, r"(?iU)\b(?:S/O|C/O|W/O)\s*[:：]\s*[A-Za-z .]+$", " ")
        return clean_value(line)

    rest = F.filter(F.transform(rest, cleaned), lambda x: (x != "") & (x.rlike("[A-Za-z]") | x.rlike(_PIN_LINE)))
    return clean_value(F.array_join(_through(rest, lambda x: x.rlike(_PIN_LINE)), " "))


def address_block(text: Column) -> Column:
    """The address after its label, relations and id number taken out, with the pincode."""
    block = group(text, rf"(?isU)(?:पता|Address)\s*[:：]\s*(.+?)(?=\bP\.?\s*O\.?\s*Box\b|help@|www\.|Bengaluru|{_FREE_CALL}|$(?![\s\S]))")
    before = lambda b: let(id_number(b), lambda n: F.when(n != "", F.call_function("substring_index", b, n, F.lit(1))).otherwise(b))
    block = let(block, before)
    block = F.regexp_replace(block, r"(?iU)\b(?:S/O|C/O|W/O)\s*[:：]\s*[A-Za-z ]+", " ")
    block = F.regexp_replace(block, r"(?U)(?:पुत्र|पिता|पति)\s*[:：]\s*[\p{IsDevanagari}\s]+(?=\d|[A-Za-z])", " ")
    joined = lambda b: let(pincode(text), lambda p: F.when((p != "") & ~b.contains(p), F.trim(F.concat_ws(" ", b, p))).otherwise(b))
    labelled = text.rlike(r"(?isU)(?:पता|Address)\s*[:：]\s*.")
    return F.when(labelled, let(clean_value(block), joined)).otherwise("")


def script_address_lines(lines: Column) -> Column:
    """Lines from that which begins with the address word, itself cut to the word."""
    word = "पता"
    rest = _from_first(lines, lambda x: x.startswith(word), 1)
    rest = _until(rest, lambda x: x.rlike(r"(?iU)\b(?:S/O|C/O|W/O)\b") | x.rlike(_SCRIPT_END) | (id_number(x) != ""))
    rest = _through(rest, lambda x: x.rlike(_PIN_LINE))
    return F.when(F.exists(lines, lambda x: x.startswith(word)), F.concat(F.array(F.lit(word + ":")), rest)).otherwise(F.array().cast("array<string>"))


def script_address(lines: Column) -> Column:
    own = F.filter(script_address_lines(lines), lambda x: ~x.rlike("^(पता|पुत्र|पिता)"))
    own = F.transform(own, lambda x: clean_value(F.regexp_replace(x, "[A-Za-z]+(?:[ ,.-]+[A-Za-z]+)*", " ")))

    def add(acc: Column, x: Column) -> Column:
        again = (x == "") | (x.rlike(_PIN_LINE) & F.exists(acc, lambda y: y.contains(x)))
        return F.when(again, acc).otherwise(F.concat(acc, F.array(x)))

    return clean_value(F.array_join(F.aggregate(own, F.array().cast("array<string>"), add), " "))


def card_name(lines: Column) -> Column:
    ignored = ("भारत सरकार", "government of india", "sample photo")
    return first_line(lines, lambda x: ~F.lower(x).isin(*ignored) & x.rlike(f"^{_NAME}$"))


def script_name(lines: Column) -> Column:
    """The nearest earlier line in script before a line with a capitalised name."""
    good = lambda x: has_script(x) & ~x.isin(*_STATE_NAMES) & ~x.rlike("जन्म|पुरुष|महिला|आधार")
    before = lambda x, i: F.when(x.rlike(_NAME), F.try_element_at(F.filter(F.slice(lines, F.lit(1), i), good), F.lit(-1)))
    return item(F.array_compact(F.transform(lines, before)), 1)


def noisy_script_name(v: Column) -> Column:
    return (v == "") | v.isin(*_STATE_NAMES, "आधार") | v.rlike("जन्म|पुरुष|महिला|आम आदमी|अधिकार") | (F.size(F.split(v, r"(?U)\s+")) > 4)


def noisy_relation(v: Column) -> Column:
    return (F.size(F.filter(F.split(v, r"(?U)\s+"), lambda x: x != "")) > 6) | F.lower(v).rlike(r"uidai|help@|www\.|p\.o\.|box no|bengaluru|1947")


def card_date(text: Column) -> Column:
    """The repaired date after a birth label, else the first in the whole text."""
    labelled = group(text, r"(?iU)(?:DOB|D\.O\.B|Date\s+of\s+Birth|जन्म\s*(?:तिथि|तारीख))\s*[:：/]?\s*([^\n]+)")
    return first_of(iso_date_repair(labelled), iso_date_repair(text))


def gender(text: Column) -> Column:
    return F.when(text.rlike(r"(?iU)\bFemale\b|महिला"), "Female").when(text.rlike(r"(?iU)\bMale\b|पुरुष"), "Male").otherwise("")


def card_overlay(text: Column, lines: Column, v: Callable[[str], Column]) -> dict[str, Column]:
    english = english_address(lines)
    p = r"(?iU)\b(S/O|C/O|W/O)\s*[:：]\s*([A-Za-z][A-Za-z .]+)"
    relation, person = F.upper(group(text, p, 1)), clean_value(group(text, p, 2))
    q = r"(?U)(पुत्र|पिता|पति|पत्नी|मार्फत)\s*[:：]\s*([\p{IsDevanagari}\s]+?)(?=\s*\d|[A-Za-z]|$(?![\s\S]))"
    word, named = group(text, q, 1), clean_value(group(text, q, 2))
    footer = lambda x: x.contains("help@") | F.lower(x).contains("uidai") | x.contains("Bengaluru")

    def related(field: str, own: str) -> Column:
        return F.when((person != "") & (relation == own) & ((v(field) == "") | noisy_relation(v(field))), person).otherwise(v(field))

    def script_related(field: str, own: tuple[str, ...]) -> Column:
        x = F.when((named != "") & word.isin(*own), named).otherwise(v(field))
        return F.when(footer(x), named).otherwise(x)

    script_label = F.when(named != "", named).otherwise(v("hindi_relationship_label"))
    return {
        "aadhaar_number": first_of(v("aadhaar_number"), id_number(text)),
        "vid": first_of(virtual_id(v("vid")), virtual_id(text), v("vid")),
        "pincode": first_of(v("pincode"), pincode(text)),
        "address": first_of(english, v("address"), address_block(text)),
        "hindi_address_lines": first_of(v("hindi_address_lines"), F.array_join(script_address_lines(lines), "\n")),
        "hindi_address": first_of(v("hindi_address"), script_address(lines)),
        "name": first_of(v("name"), card_name(lines)),
        "hindi_name": F.when(noisy_script_name(v("hindi_name")), script_name(lines)).otherwise(v("hindi_name")),
        "date_of_birth": first_of(iso_date_repair(v("date_of_birth")), card_date(text), v("date_of_birth")),
        "gender": first_of(gender(text), v("gender")),
        "relationship_label": first_of(person, v("relationship_label")),
        "father_name": related("father_name", "S/O"),
        "care_of": related("care_of", "C/O"),
        "husband_name": related("husband_name", "W/O"),
        "hindi_relationship_label": F.when(footer(script_label), named).otherwise(script_label),
        "hindi_father_name": script_related("hindi_father_name", ("पुत्र", "पिता")),
        "hindi_care_of": script_related("hindi_care_of", ("मार्फत",)),
        "hindi_husband_name": script_related("hindi_husband_name", ("पति", "पत्नी")),
    }


def tax_number(text: Column) -> Column:
    return F.regexp_extract(F.upper(fold_digits(text)), r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b", 0)


def tax_names(lines: Column) -> tuple[Column, Column]:
    """The person's and the father's name: after their labels, else the first capital lines."""
    capitals = F.filter(lines, lambda x: x.rlike(_CAPITALS) & ~x.isin("INCOME TAX DEPARTMENT", "GOVT OF INDIA", "GOVT. OF INDIA"))
    title = lambda x: F.initcap(F.lower(x))
    shaped = lambda x: F.when(x.rlike(_CAPITALS), title(x))
    names = F.array_compact(F.transform(lines, lambda x, i: F.when(F.lower(x) == "name", shaped(item(lines, i + 2)))))

    def father(x: Column, i: Column) -> Column:
        after = item(lines, i + 2)
        return F.when(F.lower(x).contains("father"), shaped(F.when(after.rlike(r"(?U)^\d{6,8}$"), item(lines, i + 3)).otherwise(after)))

    fathers = F.array_compact(F.transform(lines, father))
    words = lambda x: F.size(F.split(x, " +"))
    most = F.aggregate(fathers, F.lit(""), lambda a, x: F.when((a == "") | (words(x) > words(a)), x).otherwise(a))
    return first_of(item(names, -1), title(item(capitals, 1))), first_of(most, title(item(capitals, 2)))


def tax_script_names(lines: Column) -> Column:
    """Lines in script alone that aren't print of the card; single words pair up."""
    exact = ("वभाग", "आयकर", "भारत सरकार", "रत सरकार", "स्थायी", "लेखा", "संख्या", "कार्ड", "नाम", "पिता", "का", "जन्म", "तारीखा/", "तारीख/", "हस्ताक्षर")
    parts = "आयकर|भारत सरकार|स्थायी|लेखा|संख्या|कार्ड|जन्म|तारीख|हस्ताक्षर|सत्पमेत|सत्यमेव"
    own = F.filter(lines, lambda x: x.rlike(r"\p{IsDevanagari}") & ~x.rlike("[A-Za-z]") & ~x.isin(*exact) & ~x.rlike(parts) & (F.length(x) > 2))
    single = lambda x: F.size(F.split(x, " +")) == 1
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        pair = F.struct(F.concat(acc["out"], F.array(F.concat_ws(" ", acc["held"], x))).alias("out"), F.lit(None).cast("string").alias("held"))
        flushed = F.when(acc["held"].isNotNull(), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])
        hold = F.struct(flushed.alias("out"), x.alias("held"))
        whole = F.struct(F.concat(flushed, F.array(x)).alias("out"), F.lit(None).cast("string").alias("held"))
        return F.when(single(x) & acc["held"].isNotNull(), pair).when(single(x), hold).otherwise(whole)

    done = lambda acc: F.when(acc["held"].isNotNull(), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])
    return F.aggregate(own, start, step, done)


def tax_overlay(text: Column, lines: Column, v: Callable[[str], Column]) -> dict[str, Column]:
    folded = fold_digits(text)
    name, father = tax_names(lines)
    script = tax_script_names(lines)
    return {
        "pan_number": first_of(tax_number(text), v("pan_number")),
        "name": first_of(name, v("name")),
        "father_name": first_of(father, v("father_name")),
        "date_of_birth": first_of(iso_date(folded), v("date_of_birth")),
        "hindi_name": first_of(item(script, 1), v("hindi_name")),
        "hindi_father_name": first_of(item(script, 2), v("hindi_father_name")),
        "signature_present": F.when(text.rlike("(?iU)signature|हस्ताक्षर"), "True").otherwise("False"),
        "card_issue_date_text": first_of(F.regexp_extract(folded, r"(?U)\b\d{8}\b", 0), v("card_issue_date_text")),
    }


def account_overlay(text: Column, lines: Column, v: Callable[[str], Column]) -> dict[str, Column]:
    labelled = lambda *names: after_label(lines, list(names))
    number = lambda c, low, high: group(c, rf"(?U)\b(\d{{{low},{high}}})\b")
    out = {
        "ifsc": first_of(group(text, r"(?iU)\b([A-Z]{4}0[A-Z0-9]{6})\b"), v("ifsc")),
        "micr": first_of(group(text, r"(?U)\b(\d{9})\b"), v("micr")),
        "pan_number": first_of(tax_number(text), v("pan_number")),
        "email": first_of(group(text, r"(?iU)\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"), v("email")),
        "account_number": first_of(number(labelled("Account No.", "Account Number", "A/c No", "Account No"), 10, 18), number(text, 10, 18), v("account_number")),
        "cif_number": first_of(number(labelled("CIF Number", "CIF"), 6, 12), v("cif_number")),
        "branch_code": first_of(number(labelled("Branch Code", "Code"), 3, 8), v("branch_code")),
        "nom_reg_no": first_of(number(labelled("Nom Reg No", "Nomination Registration Number"), 5, 14), v("nom_reg_no")),
        "account_opened": first_of(slash_date(labelled("A/c Opening Dt", "Account Opening Date")), v("account_opened")),
        "date_of_issue": first_of(slash_date(labelled("Date of Issue")), v("date_of_issue")),
        "continuation": F.when(text.rlike(r"(?iU)\bCONTINUATION\b"), "CONTINUATION").otherwise(v("continuation")),
        "branch_manager_stamp_present": F.when(text.rlike("(?iU)Branch Manager|शाखा प्रबंधक"), "True").otherwise("False"),
    }
    # Labels whose line gives the value as it is.
    plain = {
        "bank_name": ("Bank Name", "State Bank of India", "Bank"),
        "hindi_bank_name": ("भारतीय स्टेट बैंक",),
        "branch_name": ("Branch",),
        "phone": ("Phone No.", "Phone"),
        "account_holder": ("Name",),
        "father_name": ("S/D/H/o", "Father Name", "S/O"),
        "account_type": ("A/c Type", "Account Type"),
        "mop": ("MOP",),
        "address": ("Address",),
    }
    return out | {f: first_of(labelled(*names), v(f)) for f, names in plain.items()}


def sale_overlay(text: Column, lines: Column, v: Callable[[str], Column]) -> dict[str, Column]:
    joined = F.array_join(lines, "\n")
    business = r"(?iU)MR\.?\s*D\.?I\.?Y|SDN\s+BHD|INVOICE|CASH SALES"
    amount = lambda *names: group(after_label(lines, list(names)), r"(\d+\.\d{2})")
    place = r"(?iU)\b(?:LOT|JALAN|TAMAN|NO\.|KAWASAN|SELANGOR|KEMBANGAN)\b"
    return {
        "company": first_of(first_line(F.slice(lines, 1, 8), lambda x: x.rlike(business)), v("company")),
        "date": first_of(group(joined, r"(?U)\b(\d{2}[-/]\d{2}[-/]\d{2,4})\b"), v("date")),
        "receipt_number": first_of(after_label(lines, ["Receipt No.", "Invoice No.", "Doc No.", "Slip No."]), v("receipt_number")),
        "address": first_of(clean_value(F.array_join(F.filter(lines, lambda x: x.rlike(place)), " ")), v("address")),
        "subtotal": first_of(amount("Subtotal", "Sub-total", "Total Sales"), v("subtotal")),
        "tax": first_of(amount("GST", "Tax", "Total Tax"), v("tax")),
        "discount": first_of(amount("Discount", "Disc"), v("discount")),
        "total": first_of(amount("Grand Total", "Total Sales", "Total", "CASH", "Amount"), v("total")),
        "currency": F.when(joined.rlike(r"(?iU)\b(?:RM|MYR)\b"), "RM").otherwise(v("currency")),
    }


def overlaid(docs: DataFrame, text: str = "text", types: list[str] | None = None) -> DataFrame:
    """``docs`` (with type and sliced) with values: map of field to text.

    A record has its schema's fields and those that an overlay adds. The tax
    overlay also runs on passbooks, before their own. Rows of unknown type
    have null values. ``types`` limits the plan to types that are known to
    occur.
    """
    key = (docs.sparkSession.sparkContext.applicationId, text, tuple(types or ()))
    if key not in _BUILT:
        _BUILT[key] = _records(text, types)
    return docs.withColumn("lines", lines_of(text_or_empty(F.col(text)))).withColumn("values", _BUILT[key]).drop("lines")


#: Overlay expressions of a session; they take seconds to build, and hold for every table.
_BUILT: dict[tuple, Column] = {}


def _records(text: str, types: list[str] | None) -> Column:
    body, lines, branches = text_or_empty(F.col(text)), F.col("lines"), None
    sliced = lambda f: text_or_empty(F.try_element_at(F.col("sliced"), F.lit(f)))
    # one set of expressions for all sides of a card: a field that a side lacks isn't sliced there
    card = card_overlay(body, lines, sliced) if types is None or any(t.startswith("aadhaar") for t in types) else {}
    for t, own in schemas.schemas().items():
        if types is not None and t not in types:
            continue
        made: dict[str, Column] = {f: sliced(f) for f, _, _ in own}
        names = {f for f, _, _ in own}

        def value(f: str, made=made) -> Column:
            return made.get(f, F.lit(""))

        if "aadhaar_number" in names:
            made |= {f: c for f, c in card.items() if f in names}
        if "pan_number" in names:
            made |= tax_overlay(body, lines, value)
        if "bank_name" in names:
            made |= account_overlay(body, lines, value)
        if "company" in names:
            made |= sale_overlay(body, lines, value)
        record = F.map_from_arrays(F.array(*[F.lit(f) for f in made]), F.array(*made.values()))
        branches = F.when(F.col("type") == t, record) if branches is None else branches.when(F.col("type") == t, record)
    return branches


def extract(docs: DataFrame, text: str = "text", types: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` classified, with spans, slices and values.

    ``keep`` names what is used later of the columns before the slices, beside
    text, type and hits: Spark can't leave out what an Arrow step is given, so
    all others are else made, and sent to Python and back.
    """
    known = classify(docs, text)
    if keep is not None:
        known = known.select(*dict.fromkeys([*keep, text, "type", "hits"]))
    return overlaid(with_slices(known, text), text, types)


def long_fields(records: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """A row for each field of each record: keys, type, field, kind (s, b or l), value."""
    # outer: else Spark asks for the size of the whole record first, and so makes it three times
    rows = records.select(*keys, "type", F.explode_outer(values).alias("field", "value")).where("field is not null")
    return rows.withColumn("kind", F.when(F.col("field").isin(*schemas.FLAGS), "b").when(F.col("field").isin(*schemas.LISTS), "l").otherwise("s"))
