"""Document type by the labels that occur in a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, match_text, text_or_empty
from . import schemas
from .fuzzy import add_hits

#: Share of a schema's fields that must be labelled for its type to be chosen.
ENOUGH = 0.4
#: Types of which a text may show both sides.
CARDS = ("aadhaar_front", "aadhaar_back", "aadhaar_full")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def pattern_guess(text: Column) -> Column:
    """struct<type, confidence> from patterns, in a fixed order; nulls where none applies.

    A 12-digit group is an identity card, of which side words tell the side;
    then a tax id, account words, sales words, and employee labels run together.
    """
    norm = match_text(text)
    compact = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    card = text.rlike(r"(?U)(?<!\d)\d{4}[ \t-]*\d{4}[ \t-]*\d{4}(?!\d)")
    back = norm.rlike(r"(?U)\b(sio|s/o|c/o|w/o|address|pincode|uidai)\b") | text.rlike(r"(?U)(?<!\d)[1-9]\d{5}(?!\d)") | text.rlike("पता|मार्फत|पिता")
    front = norm.rlike(r"(?U)\b(dob|date of birth|yob|male|female)\b") | text.rlike("जन्म|पुरुष|महिला")
    tax = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")).rlike(r"[A-Z]{5}\d{4}[A-Z]")
    guess = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    return (
        F.when(card & back & front, guess("aadhaar_full", 0.65))
        .when(card & back, guess("aadhaar_back", 0.55))
        .when(card, guess("aadhaar_front", 0.5))
        .when(tax, guess("pan_card", 0.55))
        .when(norm.rlike("ifsc|account number|passbook|cif number"), guess("passbook", 0.5))
        .when(norm.rlike("invoice|cash sales|receipt|doc no|total sales"), guess("invoice", 0.5))
        .when(compact.contains("employeeid") | compact.contains("employeename"), guess("employee_form", 0.5))
    )


def _dimension() -> tuple[list[tuple[str, int]], dict[str, list[tuple[str, list[int]]]]]:
    """Distinct labels with their edits, and for each type its fields with label indexes."""
    index: dict[str, int] = {}
    fields = {}
    for t, own in schemas.schemas().items():
        fields[t] = [(f, [index.setdefault(schemas.normal_label(x), len(index)) for x in labels]) for f, _, labels in own]
    return [(x, schemas.allowed_edits(x)) for x in index], fields


#: Labels for which one word of bits stands.
_BITS = 60


def _words(hits: Column, n: int) -> Column:
    """The label indexes below ``n`` as words of _BITS bits, array<long>."""
    one = F.lit(1).cast("long")

    def word(low: int) -> Column:
        return F.aggregate(hits, F.lit(0).cast("long"), lambda w, x: F.when((x >= low) & (x < low + _BITS), w.bitwiseOR(F.call_function("shiftleft", one, x - low))).otherwise(w))

    return F.array(*[word(low) for low in range(0, n, _BITS)])


def _hit(words: Column, ids: list[int]) -> Column:
    """Whether one of some labels is among those that ``words`` tell."""
    masks: dict[int, int] = {}
    for i in ids:
        masks[i // _BITS] = masks.get(i // _BITS, 0) | 1 << i % _BITS
    return reduce(Column.__or__, [words[w].bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in masks.items()])


def confidences(words: Column) -> Column:
    """array<double>: the share of each schema's fields that have a label, in schema order."""
    share = lambda own: reduce(Column.__add__, [_hit(words, ids).cast("int") for _, ids in own]) / F.lit(float(len(own)))
    return F.array(*[share(own) for own in _dimension()[1].values()])


def scores(hits: Column) -> Column:
    """array<struct<type, total, matched, missing, confidence>> in schema order, from label hits."""
    labels, fields = _dimension()

    def said(words: Column) -> Column:
        out = []
        for t, own in fields.items():
            flags = [(f, _hit(words, ids)) for f, ids in own]
            matched = F.array_compact(F.array(*[F.when(h, F.lit(f)) for f, h in flags]))
            missing = F.array_compact(F.array(*[F.when(~h, F.lit(f)) for f, h in flags]))
            entry = lambda yes, no, t=t, n=len(own): F.struct(F.lit(t).alias("type"), F.lit(n).alias("total"), yes.alias("matched"), no.alias("missing"), (F.size(yes) / F.lit(float(n))).alias("confidence"))
            out.append(let(matched, lambda yes, no=missing, entry=entry: entry(yes, no)))
        return F.array(*out)

    return let(_words(hits, len(labels)), said)


def exact_hits(text: Column) -> Column:
    """As the tolerant search, with exact labels only and no Python."""
    labels, _ = _dimension()
    hits = lambda norm: F.array_compact(F.array(*[F.when(norm.contains(x), F.lit(i)) for i, (x, _) in enumerate(labels)]))
    return let(match_text(text_or_empty(text)), hits)


def with_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with hits: the labels (by index) that occur in the text, tolerantly."""
    labels, _ = _dimension()
    return add_hits(docs, match_text(text_or_empty(F.col(text))), labels)


def choose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with hits) with the chosen type and how sure it is.

    New columns: scores, type, confidence, confidence_percent,
    confidence_level, matched, missing, total, score_gap. Ties go to the
    schema declared first. Below ENOUGH a pattern may still tell the type; if
    none does, it is unknown, with the best score's figures. A card that shows
    both sides becomes aadhaar_full with the lists of the side it was taken for.
    """
    sizes = {t: len(f) for t, f in _dimension()[1].items()}
    # the scores are lists of fields; which type is best, their counts tell
    out = docs.withColumn("scores", scores(F.col("hits"))).withColumn("_words", _words(F.col("hits"), len(_dimension()[0])))
    out = out.withColumn("_sure", confidences(F.col("_words")))
    # the first of the highest: the position in the schema list breaks ties
    out = out.withColumn("_at", F.array_position("_sure", F.array_max("_sure")).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in sizes]), F.col("_at"))
    out = out.withColumn("best", F.struct(kind.alias("type"), F.element_at("_sure", F.col("_at")).alias("confidence")))
    best = F.element_at("scores", F.col("_at"))
    # patterns are looked for only where they may tell something: in weak rows and cards
    asked = (F.col("best.confidence") < ENOUGH) | F.col("best.type").isin(*CARDS)
    out = out.withColumn("guess", F.when(asked, pattern_guess(text_or_empty(F.col(text)))))
    gap = F.bround((F.col("best.confidence") - F.sort_array("_sure", False)[1]) * 100, 2)
    weak = F.col("best.confidence") < ENOUGH
    guessed = weak & F.col("guess.type").isNotNull()
    full = ~weak & (F.col("guess.type") == "aadhaar_full") & F.col("best.type").isin(*CARDS)
    kind = F.when(guessed, F.col("guess.type")).when(weak, "unknown").when(full, "aadhaar_full").otherwise(F.col("best.type"))
    sure = F.when(guessed, F.col("guess.confidence")).when(full, F.greatest("best.confidence", "guess.confidence")).otherwise(F.col("best.confidence"))
    all_fields = F.create_map(*[x for t, own in schemas.schemas().items() for x in (F.lit(t), F.array(*[F.lit(f) for f, _, _ in own]))])
    out = out.withColumn("type", kind).withColumn("confidence", sure)
    size = F.create_map(*[x for t, n in sizes.items() for x in (F.lit(t), F.lit(n))])
    out = out.withColumns(
        {
            "confidence_percent": F.bround(F.col("confidence") * 100, 2),
            "confidence_level": confidence_level(F.col("confidence")),
            "matched": F.when(guessed, F.array().cast("array<string>")).otherwise(best["matched"]),
            "missing": F.when(guessed, F.try_element_at(all_fields, F.col("type"))).otherwise(best["missing"]),
            "total": F.when(guessed | full, F.try_element_at(size, F.col("type"))).otherwise(best["total"]),
            "score_gap": F.when(guessed, 0.0).otherwise(gap),
        }
    )
    return out.drop("_words", "_sure", "_at", "best", "guess")


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with type and confidence; null texts count as empty."""
    return choose(with_hits(docs, text), text)


def forced(docs: DataFrame, kind: Column, confidence: float = 1.0, level: str = "high") -> DataFrame:
    """``docs`` with a type that the caller knows: all fields matched; unknown types are not sure at all."""
    all_fields = F.create_map(*[x for t, own in schemas.schemas().items() for x in (F.lit(t), F.array(*[F.lit(f) for f, _, _ in own]))])
    out = docs.withColumn("type", kind).withColumn("matched", F.try_element_at(all_fields, F.col("type")))
    known = F.col("matched").isNotNull()
    return out.withColumns(
        {
            "confidence": F.when(known, F.lit(confidence)).otherwise(0.0),
            "confidence_percent": F.when(known, F.lit(100.0 * confidence)).otherwise(0.0),
            "confidence_level": F.when(known, level).otherwise("low"),
            "matched": F.coalesce("matched", F.array().cast("array<string>")),
            "missing": F.array().cast("array<string>"),
            "total": F.coalesce(F.size("matched"), F.lit(0)),
            "score_gap": F.lit(0.0),
        }
    )
