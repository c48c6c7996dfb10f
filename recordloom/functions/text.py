"""Text, digit, date and amount helpers, Column to Column, built-ins only.

The patterns carry (?U) where Unicode white space or digits may occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI_DIGITS = "०१२३४५६७८९"
#: Line ends as Python and Unicode know them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
SEPARATORS = "[:：|._-]+"
SCRIPT = r"[ऀ-ॿ]"


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once and named, however often f uses it."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed to one blank and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def match_text(c: Column) -> Column:
    """Lower case with separators and white space as one blank: what labels are looked up in."""
    return squeeze(F.regexp_replace(F.lower(c), SEPARATORS, " "))


def label_text(c: Column) -> Column:
    """As ``match_text``, with the case kept."""
    return squeeze(F.regexp_replace(c, SEPARATORS, " "))


def clean_value(c: Column) -> Column:
    """White space collapsed; blanks, colons, bars and dashes trimmed."""
    return F.regexp_replace(squeeze(c), r"^[ :\-|]+|[ :\-|]+$", "")


def lines_of(c: Column, clean=clean_value) -> Column:
    """The cleaned lines of a text that are not empty."""
    return F.filter(F.transform(F.split(c, LINE_END), clean), lambda x: x != "")


def fold_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def has_script(c: Column) -> Column:
    return c.rlike(SCRIPT)


def first_of(*options: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    # bound: nullif would make each option twice, in the test and as its result
    return F.coalesce(*[let(o, lambda x: F.nullif(x, F.lit(""))) for o in options], F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, empty if there is none."""
    return text_or_empty(F.regexp_extract(c, pattern, n))


def item(a: Column, i) -> Column:
    """Element i (from 1, or from the end if negative), empty if there is none."""
    return F.coalesce(F.try_element_at(a, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def iso_date_repair(c: Column) -> Column:
    """A date read badly: script digits, i, l and bars for 1, stray blanks and slashes; ISO or empty."""
    t = F.regexp_replace(fold_digits(text_or_empty(c)), "(?i)[il|]", "1")
    t = F.regexp_replace(t, r"(?U)\s+", "")
    t = F.replace(F.replace(t, F.lit("-/"), F.lit("-1")), F.lit("./"), F.lit(".1"))
    t = F.regexp_replace(t, r"(?U)(?<=\d)/(?!\d{2,4}\b)", "1")
    ymd, dmy = r"(\d{4})[-/.](\d{2})[-/.](\d{2})", r"(\d{2})[-/.](\d{2})[-/.](\d{4})"
    return let(t, lambda t: _dates(t, ymd, dmy))


def iso_date(c: Column) -> Column:
    """The first day/month/year as ISO, else the first year/month/day, else empty."""
    dmy, ymd = r"(\d{2})[/-](\d{2})[/-](\d{4})", r"(\d{4})[/-](\d{2})[/-](\d{2})"
    out = lambda c: F.when(c.rlike(dmy), F.concat_ws("-", *[group(c, dmy, k) for k in (3, 2, 1)])).when(c.rlike(ymd), F.concat_ws("-", *[group(c, ymd, k) for k in (1, 2, 3)])).otherwise("")
    return let(c, out)


def _dates(t: Column, ymd: str, dmy: str) -> Column:
    return F.when(t.rlike(ymd), F.concat_ws("-", *[group(t, ymd, k) for k in (1, 2, 3)])).when(t.rlike(dmy), F.concat_ws("-", *[group(t, dmy, k) for k in (3, 2, 1)])).otherwise("")


def slash_date(c: Column) -> Column:
    p = r"(\d{2})[/-](\d{2})[/-](\d{4})"
    return let(c, lambda c: F.when(c.rlike(p), F.concat_ws("/", *[group(c, p, k) for k in (1, 2, 3)])).otherwise(""))


def padded_date(c: Column) -> Column:
    """Separators tightened; a date of the years 1900 to 2099 as padded ISO, other text unchanged."""
    t = F.regexp_replace(c, r"(?U)\s*([/.-])\s*", "$1")
    dmy, ymd = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-]((?:19|20)\d{2})(?!\d)", r"(?<!\d)((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})(?!\d)"
    two = lambda p, k: F.lpad(group(t, p, k), 2, "0")
    return F.when(t.rlike(dmy), F.concat_ws("-", group(t, dmy, 3), two(dmy, 2), two(dmy, 1))).when(
        t.rlike(ymd), F.concat_ws("-", group(t, ymd, 1), two(ymd, 2), two(ymd, 3))
    ).otherwise(c)


def plain_key(c: Column) -> Column:
    """Comparison key: lower case without white space and - : / . , |."""
    return F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)[\s\-:/.,|]+", "")


def date_key(c: Column) -> Column:
    """Comparison key of a date, YYYYMMDD; two-digit years are of this century; others as ``plain_key``."""
    return let(F.trim(text_or_empty(c)), _date_key)


def _date_key(t: Column) -> Column:
    named, ymd, dmy = r"^(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{2,4})$", r"^((?:19|20)\d{2})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.]((?:19|20)?\d{2})$"
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    month = F.array_position(F.array(*[F.lit(m) for m in months]), F.lower(F.substring(group(t, named, 2), 1, 3)))
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    two = lambda x: F.lpad(x, 2, "0")
    return (
        F.when(t.rlike(named) & (month > 0), F.concat(year(group(t, named, 3)), two(month.cast("string")), two(group(t, named, 1))))
        .when(t.rlike(ymd), F.concat(group(t, ymd, 1), two(group(t, ymd, 2)), two(group(t, ymd, 3))))
        .when(t.rlike(dmy), F.concat(year(group(t, dmy, 3)), two(group(t, dmy, 2)), two(group(t, dmy, 1))))
        .otherwise(plain_key(t))
    )


def amount_key(c: Column) -> Column:
    """Comparison key of an amount: commas dropped; without a point the last two digits are cents."""
    t = F.replace(F.regexp_extract(F.replace(text_or_empty(c), F.lit(","), F.lit("")), r"\d+(?:[ .]\d{2})?", 0), F.lit(" "), F.lit("."))
    return let(t, _amount_key)


def _amount_key(t: Column) -> Column:
    t = F.when((F.instr(t, ".") == 0) & (F.length(t) > 2), F.concat(t.substr(F.lit(1), F.length(t) - 2), F.lit("."), F.substring(t, -2, 2))).otherwise(t)
    return F.when(t == "", "").otherwise(F.format_string("%.2f", F.try_to_number(t, F.lit("999999999999999999.99")).cast("double")))


def tokens(c: Column) -> Column:
    """Words of ASCII letters, digits and Devanagari, in lower case."""
    t = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9ऀ-ॿ ]+", " ")
    return F.filter(F.split(t, " +"), lambda x: x != "")


def safe_file_name(c: Column, default: str = "uploaded_document") -> Column:
    """The base name with other characters than letters, digits and ._- and blank as underscores."""
    base = F.element_at(F.split(c, "/"), -1)
    base = F.trim(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._ -]+", "_"), r"\s+", " "))
    return F.when(base.isin("", ".", ".."), default).otherwise(base)


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
