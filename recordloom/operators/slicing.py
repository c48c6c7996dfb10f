"""Label slices as a table function of SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import spans

_OUT = T.StructType([T.StructField(n, T.IntegerType() if n in ("ord", "start", "end") else T.StringType()) for n in ("ord", "field", "label", "start", "end", "value")])
_ENDS = " :-|"


def cleaned(value: str) -> str:
    return re.sub(r"\s+", " ", value).strip(" ").strip(_ENDS)


def cut(text: str, found: list[dict]) -> Iterator[tuple[str, str, int, int, str]]:
    """(field, label, start, end, value) of the labels in a text, each value up to the next label or end mark."""
    labels, last = [], 0
    for s in found:
        if s["field"] is not None and s["start"] >= last:
            labels.append(s)
            last = s["end"]
    both = sorted(labels + [s for s in found if s["field"] is None], key=lambda s: s["start"])
    for s, after in zip(both, [*both[1:], None]):
        if s["field"] is not None:
            yield s["field"], s["label"], s["start"], s["end"], cleaned(text[s["end"] : after["start"] if after else len(text)])


@dataclass
class Sliced(AnalyzeResult):
    keys: tuple[str, ...] = ()


class LabelSlices:
    """``SELECT * FROM label_slices(TABLE(docs))``: a row for each label found in the text of a row of ``docs``.

    ``docs`` has text and type, and may have hits (the labels that occur);
    its other columns are handed on. With PARTITION BY the rows of a key are
    looked at together, without it those of a task; either way texts advance in
    blocks. Null texts and unknown types give no rows.
    """

    def __init__(self, result: Sliced):
        self.keys = result.keys
        self.finder = spans.Finder()
        self.held: list[Row] = []

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> Sliced:
        if not docs.isTable:
            raise ValueError("label_slices takes a table: label_slices(TABLE(docs))")
        kinds = {f.name: f.dataType for f in docs.dataType.fields}
        for name in ("text", "type"):
            if not isinstance(kinds.get(name), T.StringType):
                raise ValueError(f"label_slices needs a column {name} of strings")
        keys = [f for f in docs.dataType.fields if f.name not in ("text", "type", "hits")]
        if taken := {f.name for f in keys} & set(_OUT.names):
            raise ValueError(f"label_slices gives columns of its own for {sorted(taken)}")
        return Sliced(schema=T.StructType([*keys, *_OUT.fields]), keys=tuple(f.name for f in keys))

    def eval(self, row: Row):
        self.held.append(row)
        if len(self.held) == spans.BLOCK:
            yield from self._flush()

    def terminate(self):
        yield from self._flush()

    def _flush(self):
        rows, self.held = self.held, []
        texts = [r["text"] or "" for r in rows]
        hits = [r["hits"] if "hits" in r else None for r in rows]
        for row, text, found in zip(rows, texts, self.finder.spans(texts, [r["type"] for r in rows], hits)):
            for i, made in enumerate(cut(text, found)):
                yield (*[row[k] for k in self.keys], i, *made)


def register(spark: SparkSession) -> None:
    """Make label_slices known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("label_slices", udtf(LabelSlices))
