"""Approximate label search: which labels occur in a text with at most k edits.

A label cut into one part more than its edits keeps one part whole, so only
places beside a part that stands in a text can hold it. Shift-and automata
with errors, one 64-bit word for each label and error count, decide there. All
places of a block of texts advance together, one character a step.

A character of no label costs an edit wherever it stands, so no occurrence holds
more of them than a label may have edits. Texts are therefore decided by pieces
that hold no more, with all such characters alike: forms that differ in their
numbers share their pieces, and each piece is decided once.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Texts that advance together.
BLOCK = 512
#: Places whose verdicts are kept, as forms say the same again and again.
KEPT = 1 << 16
#: Letters of pieces whose labels are kept.
HELD = 1 << 22
#: Stands for all characters of no label.
STRANGE = "\0"


class _Plain(dict):
    """Characters of labels as they are, all others as STRANGE."""

    def __missing__(self, c: int) -> int:
        return 0


def _union(known: dict[str, int], pieces: list[str], bits: int) -> int:
    for p in pieces:
        bits |= known[p]
    return bits


class Labels:
    """Search masks of normalised labels of up to 63 characters, with their allowed edits."""

    def __init__(self, labels: list[tuple[str, int]]):
        self.labels = labels
        alphabet = sorted(set("".join(x for x, _ in labels)))
        self.codes = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.masks = np.zeros((len(alphabet) + 1, len(labels)), np.uint64)
        for j, (label, _) in enumerate(labels):
            if not 0 < len(label) < 64:
                raise ValueError(f"a label must have 1 to 63 characters: {label!r}")
            for i, c in enumerate(label):
                self.masks[self.codes[ord(c)], j] |= np.uint64(1 << i)
        self.last = np.array([1 << (len(x) - 1) for x, _ in labels], np.uint64)
        self.edits = np.array([k for _, k in labels])
        self.top = int(self.edits.max()) if len(labels) else 0
        table = np.zeros(0x110000, np.uint8)
        for c, i in self.codes.items():
            table[c] = i
        self.table = table
        self.parts: dict[str, list[tuple[int, int]]] = {}
        for j, (label, k) in enumerate(labels):
            cuts = [len(label) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if k and len(label) > k:
                    self.parts.setdefault(label[a:b], []).append((j, a))
        self.verdicts: dict[tuple[int, str], bool] = {}
        self.plain = _Plain({c: 0 for c in range(128)} | {c: c for c in self.codes})
        self.parting = re.compile(f"{STRANGE}{{{self.top + 1},}}")
        self.known: dict[str, int] = {}
        self.held = 0
        # deletions alone may already make a label
        self.always = sum(1 << j for j, (label, k) in enumerate(labels) if len(label) <= k)

    def found(self, texts: list[str]) -> np.ndarray:
        """(texts, labels): whether a label occurs within its edits."""
        out = np.zeros((len(texts), len(self.labels)), bool)
        for row, bits in zip(out, self.bits(texts)):
            row[[j for j in range(len(self.labels)) if bits >> j & 1]] = True
        return out

    def bits(self, texts: list[str]) -> list[int]:
        """For each text the labels that occur within their edits, a bit for each."""
        out = []
        for at in range(0, len(texts), BLOCK):
            out += self._by_pieces([self.parting.split(t.translate(self.plain)) for t in texts[at : at + BLOCK]])
        return out

    def _by_pieces(self, texts: list[list[str]]) -> list[int]:
        if self.held > HELD:
            self.known.clear()
            self.held = 0
        known = self.known
        new = {s: self._pieces(s) for s in dict.fromkeys(s for own in texts for s in own) if s not in known}
        open_ = [p for p in dict.fromkeys(p for own in new.values() for p in own) if p not in known]
        for at in range(0, len(open_), BLOCK):
            part = open_[at : at + BLOCK]
            rows = np.zeros((len(part), len(self.labels)), bool)
            self._block(part, rows)
            known.update(zip(part, (sum(1 << j for j in np.flatnonzero(row).tolist()) for row in rows)))
        for s, own in new.items():
            known[s] = _union(known, own, 0)
        self.held += sum(map(len, new)) + sum(map(len, open_))
        return [_union(known, own, self.always) for own in texts]

    def _pieces(self, text: str) -> list[str]:
        """The parts of a text that hold as many strange characters as there may be edits."""
        gaps, n = text.split(STRANGE), self.top + 1
        return [STRANGE.join(gaps[i : i + n]) for i in range(max(1, len(gaps) - n + 1))]

    def _block(self, texts: list[str], out: np.ndarray) -> None:
        if len(self.verdicts) > KEPT:
            self.verdicts.clear()
        open_: dict[tuple[int, str], list[int]] = {}
        for r, text in enumerate(texts):
            hit = {j for j, (label, _) in enumerate(self.labels) if label in text}
            for part, uses in self.parts.items():
                at = text.find(part)
                while at >= 0:
                    for j, before in uses:
                        if j not in hit:
                            label, k = self.labels[j]
                            start = at - before
                            place = (j, text[max(0, start - k) : start + len(label) + k])
                            said = self.verdicts.get(place)
                            if said:
                                hit.add(j)
                            elif said is None:
                                open_.setdefault(place, []).append(r)
                    at = text.find(part, at + 1)
            out[r, list(hit)] = True
        places = list(open_)
        for i, said in enumerate(self._decided(places)):
            self.verdicts[places[i]] = said
            if said:
                out[open_[places[i]], places[i][0]] = True

    def _decided(self, places: list[tuple[int, str]]) -> list[bool]:
        """Whether each text, a little longer than its label, holds it."""
        label = np.array([j for j, _ in places], int)
        chars = np.zeros((len(places), max((len(t) for _, t in places), default=0)), np.uint8)
        for i, (_, t) in enumerate(places):
            chars[i, : len(t)] = self.table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        one, last, edits = np.uint64(1), self.last[label], self.edits[label]
        state = [np.full(len(places), (1 << k) - 1, np.uint64) for k in range(self.top + 1)]
        hit = np.zeros(len(places), bool)
        for p in range(chars.shape[1]):
            mask, before = self.masks[chars[:, p], label], None
            for k in range(self.top + 1):
                old = state[k]
                new = ((old << one) | one) & mask
                if k:
                    new |= before | (before << one) | (state[k - 1] << one) | one
                before = old
                state[k] = new
                hit |= ((new & last) != 0) & (edits >= k)
        return hit.tolist()

    def ends(self, texts: list[np.ndarray], wanted: list[list[int]]) -> list[list[np.ndarray]]:
        """For each text (as codes of ``table``) and each label wanted in it, where a tolerant occurrence ends.

        A blank of a label stands for one blank or more. Only the pairs that
        are asked for advance, longer texts first, so the state is a word for
        each pair and error count.
        """
        blank = self.codes.get(ord(" "), 0)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        pairs = [(r, i, n) for r, i in enumerate(order) for n in range(len(wanted[i]))]
        out = [[[] for _ in w] for w in wanted]
        if pairs:
            row = np.array([r for r, _, _ in pairs])
            label = np.array([wanted[i][n] for _, i, n in pairs])
            sizes = np.array([len(texts[i]) for i in order])
            chars = np.zeros((len(order), int(sizes.max())), np.uint8)
            for r, i in enumerate(order):
                chars[r, : len(texts[i])] = texts[i]
            one, last, edits = np.uint64(1), self.last[label], self.edits[label]
            state = [np.full(len(pairs), (1 << k) - 1, np.uint64) for k in range(self.top + 1)]
            for p in range(chars.shape[1]):
                live = int(np.searchsorted(row, np.searchsorted(-sizes, -p, "left"), "left"))
                char = chars[row[:live], p]
                mask = self.masks[char, label[:live]]
                stay = np.where(char == blank, mask, 0)
                hit, before = np.zeros(live, bool), None
                for k in range(self.top + 1):
                    old = state[k][:live]
                    new = ((old << one) | one) & mask | old & stay
                    if k:
                        new |= before | (before << one) | (state[k - 1][:live] << one) | one
                    before = old.copy()
                    state[k][:live] = new
                    hit |= ((new & last[:live]) != 0) & (edits[:live] >= k)
                for j in np.flatnonzero(hit):
                    _, i, n = pairs[j]
                    out[i][n].append(p)
        return [[np.array(x, int) for x in w] for w in out]


@cache
def shared(labels: tuple[tuple[str, int], ...]) -> Labels:
    """One search for all tasks of a worker, so that what is known of pieces stays."""
    return Labels(list(labels))


def add_hits(docs: DataFrame, norm: Column, labels: list[tuple[str, int]], name: str = "hits") -> DataFrame:
    """``docs`` with indexes of ``labels`` that occur in the normalised text; a null text has none.

    A map over Arrow batches keeps this step apart from the expressions above
    it, which would otherwise be folded into its arguments again and again.
    """
    labels = tuple(labels)
    rows = docs.withColumn(name, norm)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches):
        search = shared(labels)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = search.bits([t or "" for t in part.column(name).to_pylist()])
                place = {bits: i for i, bits in enumerate(dict.fromkeys(found))}
                sets = pa.array([[j for j in range(len(labels)) if bits >> j & 1] for bits in place], pa.list_(pa.int32()))
                hits = sets.take(pa.array([place[bits] for bits in found], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], hits], names=schema.names)

    return rows.mapInArrow(run, schema)
