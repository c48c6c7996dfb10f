"""Where labels stand in a text, and the values between them."""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_value, let, text_or_empty
from . import classify, schemas
from .fuzzy import Labels

SPANS = "array<struct<field: string, label: string, start: int, end: int>>"
#: Texts whose labels are looked for together.
BLOCK = 256
# White space, the marks that part words beside it, and letters that are others regardless of case.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = ":：|._-"
ODD_CASE = {"ſ": "s", "\u212a": "k"}
_GAPS = frozenset(WHITE + MARKS)
#: Digits, which no label holds, are alike. A label with two edits holds at most two of them, so none reaches over the
#: place between two that stand together and have another within three letters on either side.
_ALIKE = {c: c for c in range(128)} | {ord(c): ord("0") for c in "0123456789"}
_PARTING = re.compile("(?s)0.{0,3}?0+(?=0.{0,3}0)")
#: Letters between those two others.
_BETWEEN = 6
#: Letters of pieces whose spans are kept.
HELD = 1 << 22


def folded(text: str) -> str:
    """A text in lower case, letter by letter, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_ODD) if not low.isascii() else low


_ODD = str.maketrans(ODD_CASE)


@cache
def in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


class Alignment:
    """A label against a text from one place on.

    Letters that agree are taken as they are. Where they don't, up to
    ``edits`` times a letter is replaced, else skipped in the text (not the one
    where the search set out), else skipped in the label. A gap between words is one or more
    separators. The first way that comes through says where the label ends.
    """

    def __init__(self, label: str, edits: int):
        self.items, self.edits = label, edits

    def end(self, low: str, start: int, origin: int) -> int:
        """Where the label ends if it begins at ``start``, in a search from ``origin`` on, else -1."""
        items, n = self.items, len(low)
        dead: set[tuple[int, int, int, bool]] = set()

        def ways(i: int, p: int, left: int, again: bool):
            """What may follow: item ``i`` (a gap already begun if ``again``) at ``p`` with ``left`` edits."""
            gap = items[i] == " "
            at = low[p] if p < n else ""
            after = (i, True) if gap else (i + 1, False)
            if at and (at in _GAPS if gap else at == items[i]):
                yield (after[0], p + 1, left, after[1])
            elif left:
                if at:
                    yield (after[0], p + 1, left - 1, after[1])
                    if p != origin:
                        yield (i, p + 1, left - 1, again)
                yield (after[0], p, left - 1, after[1])
            if gap and again:
                yield (i + 1, p, left, False)

        stack = [iter([(0, start, self.edits, False)])]
        while stack:
            state = next(stack[-1], None)
            if state is None:
                stack.pop()
            elif state[0] == len(items):
                return state[1]
            elif state not in dead:
                dead.add(state)
                stack.append(ways(*state))
        return -1


def past_separator(low: str, at: int) -> int:
    """The place after white space, one mark if there is one, and white space."""
    n = len(low)
    while at < n and low[at] in WHITE:
        at += 1
    if at < n and low[at] in MARKS:
        at += 1
        while at < n and low[at] in WHITE:
            at += 1
    return at


class Finder:
    """Where the labels of a type, and the end marks, stand in texts.

    The forward search has told which labels occur. The same automata, over
    labels and texts turned round, tell where they may begin; from each such
    place, first to last, the alignment says how far the label goes.
    Occurrences of one label don't overlap, and none begins inside a word. Texts
    are searched by pieces that no label reaches out of, with all digits alike, and
    what stands in a piece is kept.
    """

    def __init__(self):
        index, fields = classify._dimension()
        self.norms = [x for x, _ in index] + [schemas.normal_label(x) for x in schemas.END_MARKS]
        self.labels = {t: [(f, x, i) for (f, _, own), (_, ids) in zip(schemas.schemas()[t], fields[t]) for x, i in zip(own, ids)] for t in fields}
        self.marks = [(None, x, len(index) + i) for i, x in enumerate(schemas.END_MARKS)]
        self.ways = [Alignment(x, schemas.allowed_edits(x)) for x in self.norms]
        self.back = Labels([(x[::-1], schemas.allowed_edits(x)) for x in self.norms])
        self.codes = self.back.table.copy()
        for c in WHITE + MARKS:
            self.codes[ord(c)] = self.back.codes[ord(" ")]
        sizes = [(len(x.replace(" ", "")), schemas.allowed_edits(x)) for x in self.norms]
        self.by_pieces = not any(c.isdigit() for x in self.norms for c in x) and all(k < 2 or k == 2 and n - k > _BETWEEN for n, k in sizes)
        self.pairs = list(dict.fromkeys((f, x) for own in [*self.labels.values(), self.marks] for f, x, _ in own))
        self.place = {pair: i for i, pair in enumerate(self.pairs)}
        self.sets: list[tuple] = [()]
        self.wanted: dict[tuple, int] = {}
        self.known: dict[tuple[str, int], tuple[list[int], list[int], list[int]]] = {}
        self.held = 0

    def starts(self, lows: list[str], wanted: list[list[int]]) -> list[list[list[int]]]:
        """For each text and each label wanted in it, the places where it may begin, in order."""
        turned = [self.codes[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)][::-1] for low in lows]
        out = []
        for low, own in zip(lows, self.back.ends(turned, wanted)):
            n = len(low)
            out.append([[s for s in (n - 1 - ends[::-1]).tolist() if s == 0 or not in_word(low[s - 1])] for ends in own])
        return out

    def spans(self, texts: list[str], kinds: list[str], hits: list) -> list[list[dict]]:
        """All spans of each text's own labels and of the end marks, in order of start, longer first.

        ``hits`` are the labels that the forward search has found in a text, or
        None: then all labels of its type are searched.
        """
        return [[{"field": self.pairs[p][0], "label": self.pairs[p][1], "start": s, "end": e} for p, s, e in zip(*own)] for own in self.found(texts, kinds, hits)]

    def found(self, texts: list[str], kinds: list[str], hits: list) -> list[tuple[list[int], list[int], list[int]]]:
        """As ``spans``, for each text the places in ``pairs``, the starts and the ends."""
        if self.held > HELD:
            self.sets, self.held = [()], 0
            self.wanted.clear()
            self.known.clear()
        parts = [self._pieces(folded(t), self._wanted(kind, some)) for t, kind, some in zip(texts, kinds, hits)]
        open_ = [x for x in dict.fromkeys(x for own in parts for _, x in own) if x not in self.known]
        self.known.update(zip(open_, self._search(open_)))
        self.held += sum(len(low) for low, _ in open_)
        out = []
        for own in parts:
            places, starts, ends = [], [], []
            for at, x in own:
                p, s, e = self.known[x]
                places += p
                starts += [at + i for i in s] if at else s
                ends += [at + i for i in e] if at else e
            out.append((places, starts, ends))
        return out

    def _wanted(self, kind: str, some: list[int] | None) -> int:
        """The place in ``sets`` of the labels of a type that are looked for, as (field, label, index), and the end marks."""
        key = kind, None if some is None else tuple(some)
        if key not in self.wanted:
            own = self.labels.get(kind, [])
            made = (*[x for x in own if some is None or x[2] in some], *self.marks) if own else ()
            if made not in self.sets:
                self.sets.append(made)
            self.wanted[key] = self.sets.index(made)
            self.held += len(made)
        return self.wanted[key]

    def _pieces(self, low: str, wanted: int) -> list[tuple[int, tuple[str, int]]]:
        """(place, (piece, wanted)): all but the first begin with the last digit of the one before, as a start looks at the letter before it."""
        if not wanted:
            return []
        if not self.by_pieces:
            return [(0, (low, wanted))]
        low, out, at = low.translate(_ALIKE), [], 0
        for m in _PARTING.finditer(low):
            out.append((at, (low[at : m.end()], wanted)))
            at = m.end() - 1
        return [*out, (at, (low[at:], wanted))]

    def _search(self, parts: list[tuple[str, int]]) -> list[tuple[list[int], list[int], list[int]]]:
        out = []
        for begin in range(0, len(parts), BLOCK):
            lows, wanted = [low for low, _ in parts[begin : begin + BLOCK]], [self.sets[n] for _, n in parts[begin : begin + BLOCK]]
            for low, own, places in zip(lows, wanted, self.starts(lows, [[i for _, _, i in own] for own in wanted])):
                found = []
                for (field, label, i), starts in zip(own, places):
                    last = 0
                    for s in starts:
                        if s >= last and (end := self.ways[i].end(low, s, last)) >= 0:
                            last = past_separator(low, end)
                            found.append((self.place[field, label], s, last))
                found.sort(key=lambda x: (x[1], x[1] - x[2]))
                out.append(tuple(map(list, zip(*found))) if found else ([], [], []))
        return out


@cache
def shared_finder() -> Finder:
    """One finder for all tasks of a worker, so that what is known of pieces stays."""
    return Finder()


def add_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with type and hits) with the spans of the type's labels and of the end marks."""
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"spans {SPANS}").fields])

    def run(batches):
        finder = shared_finder()
        fields, labels = (pa.array(x, pa.string()) for x in zip(*finder.pairs))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                made = finder.found(texts, batch.column("type").to_pylist(), batch.column("hits").to_pylist())
                places, starts, ends = (pa.array([i for own in made for i in own[n]], pa.int32()) for n in range(3))
                entries = pa.StructArray.from_arrays([fields.take(places), labels.take(places), starts, ends], names=["field", "label", "start", "end"])
                offsets = pa.array([0, *accumulate(len(own[0]) for own in made)], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, entries)], names=schema.names)

    return docs.mapInArrow(run, schema)


def exact_spans(text: Column, labels: list[tuple[str, str]]) -> Column:
    """The first place of each of (field, label) in a text, without tolerance and without Python."""
    at = [F.struct(F.lit(f).alias("field"), F.lit(x).alias("label"), (F.locate(x, text) - 1).alias("start"), (F.locate(x, text) - 1 + len(x)).alias("end")) for f, x in labels]
    return F.array_sort(F.filter(F.array(*at), lambda s: s["start"] >= 0), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))


def without_overlaps(spans: Column) -> Column:
    """Spans of labels in order, each kept if it begins at or after the end of the last kept one."""
    empty = F.struct(F.array().cast(SPANS).alias("kept"), F.lit(-1).alias("last"))
    step = lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), s["end"].alias("last"))).otherwise(acc)
    return F.aggregate(spans, empty, step)["kept"]


def slices(text: Column, spans: Column) -> Column:
    """array<struct<field, value>>: for each label, the text up to the next label or end mark.

    Labels are freed of overlaps first; end marks are not, and stop a value
    wherever they stand.
    """
    labels = without_overlaps(F.filter(spans, lambda s: s["field"].isNotNull()))
    marks = F.filter(spans, lambda s: s["field"].isNull())
    both = F.concat(F.transform(labels, lambda s, i: F.struct(s["start"].alias("start"), i.alias("o"), s["end"].alias("end"), s["field"].alias("field"))), F.transform(marks, lambda s, i: F.struct(s["start"].alias("start"), (i + 1_000_000).alias("o"), s["end"].alias("end"), s["field"].alias("field"))))

    def cut(spans: Column) -> Column:
        stop = lambda i: F.coalesce(F.try_element_at(spans, i + 2)["start"], F.length(text))
        value = lambda s, i: clean_value(text.substr(s["end"] + 1, F.greatest(stop(i) - s["end"], F.lit(0))))
        return F.transform(spans, lambda s, i: F.struct(s["field"].alias("field"), value(s, i).alias("value")))

    return F.filter(let(F.array_sort(both), cut), lambda x: x["field"].isNotNull())


def with_slices(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with type and hits) with spans and sliced: field to value, the last label of a field wins."""
    out = add_spans(docs, text)
    out = out.withColumn("_s", slices(text_or_empty(F.col(text)), F.col("spans")))
    last = lambda x, i: ~F.exists(F.slice("_s", i + 2, F.size("_s")), lambda y: y["field"] == x["field"])
    return out.withColumn("sliced", F.map_from_entries(F.filter("_s", last))).drop("_s")
