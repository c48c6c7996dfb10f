"""Toxicity as an ordinal severity, by a cumulative-link regression.

Grades are 0 (clean), 1 and 2. Labels say only toxic or not, so a toxic sample
document is graded by a first fit with one toxic grade: above the median of the
toxic documents' scores it is severe (2), otherwise mild (1). One
weight vector serves both thresholds: P(grade >= k) = sigmoid(w.x - t_k) with
t_1 <= t_2, and the expected severity is the sum over k.

Features are all words (runs of letters and digits, lower case) of the sample's
toxic texts and their first bytes, which inflected insults have in common, near
copies counted once; the value is 1 + log(count). Such words can't lower a
severity: weights aren't negative, so words of clean texts alone would have none.
An exponential prior, which weighs as much against few texts as against many,
leaves most at zero. The fit therefore works on a growing set: whichever feature
would gain a weight joins it, until none would.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grown, staged, table, text_slices, tidied
from .decontaminate import words_of

#: Labelled documents that the model is fitted on, taken in order of a hash of their id.
FIT_ROWS = 12_000
#: Lengths of the beginnings that are features beside whole words.
STEMS = (4, 6, 8)
#: Rate of the exponential prior on the weights.
PRIOR = 0.5
#: Features that join the fit at a time, those first that would gain most; it ends when none would.
JOIN = 200
THRESHOLD = 0.5


def features_of(words: list[bytes]) -> list[bytes]:
    """The words, and the beginnings of longer ones, marked by a blank."""
    out = list(words)
    for k in STEMS:
        out += [b" " + w[:k] for w in words if len(w) > k]
    return out


@dataclass
class Severity:
    """A fitted model; ``words`` may be empty, then all documents are clean."""

    words: dict[bytes, float]
    thresholds: tuple[float, float]

    def grades(self, texts) -> np.ndarray:
        """(n, 2): the probability of grade 1 or more, and of grade 2."""
        out = np.zeros((len(texts), 2))
        if not self.words:
            return out
        whole = {w for w in self.words if w[:1] != b" "}
        stems = [(k, s) for k in STEMS if (s := {w[1:] for w in self.words if w[:1] == b" " and len(w) == k + 1})]
        for i, text in enumerate(texts):
            words = words_of(text)
            found = [w for w in words if w in whole]
            for k, own in stems:
                found += [b" " + w[:k] for w in words if w[:k] in own and len(w) > k]
            out[i] = sum(self.words[w] * (1 + np.log(n)) for w, n in Counter(found).items())
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - out, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled documents.

    An id with several labels has the highest; null ids and labels are left
    out. The ids are few, by ``limit``, so they can be broadcast.
    """
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.join(F.broadcast(known), rows["doc_id"] == known["_id"]).select("doc_id", "label", "text")


def _signed(batches):
    """Adds the lowest hash of a text's runs of four words; near copies mostly share it."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            signs = []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                runs = zip(*(words[k:] for k in range(4))) if len(words) >= 4 else [words]
                signs.append(min(xxhash.xxh64_intdigest(b" ".join(r)) for r in runs))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(signs, np.uint64).view(np.int64))], names=[*part.schema.names, "sign"])


def _features(batches):
    """The features of toxic texts, once for each batch run."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            found: set[bytes] = set()
            for text in part.column("text").to_pylist():
                found.update(features_of(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Severity:
    """The model of ``labels.toxic``; no labels of either class give the empty model.

    ``limit`` bounds the labelled documents that it learns from, and so what the
    driver holds. Every feature of their toxic texts is looked at; of those that
    the sample doesn't tell apart (found in the same texts, as often in each)
    only the shortest is fitted, for all of them: on sf0.01 that merges 6,188 of
    13,716 features, mostly longer beginnings of one word with shorter ones.
    """
    sample = labelled(docs, labels, "toxic", limit)
    signed = staged(sample.mapInArrow(_signed, grown(sample.schema, ("sign", "long"))), "toxicity-sample")
    texts = signed.groupBy("sign", "label").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d"))
    texts = staged(texts.select("d.doc_id", "label", "d.text"), "toxicity-texts")
    sizes = {bool(r[0]): r[1] for r in texts.groupBy(F.col("label") > 0).count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return Severity({}, (0.0, 0.0))
    # bounded by the sample, as the rows below are; the shortest first
    words = texts.where("label > 0").select("text").mapInArrow(_features, "word binary").distinct().toArrow().column("word").to_pylist()
    chosen = sorted(words, key=lambda w: (len(w), w))
    if not chosen:
        return Severity({}, (0.0, 0.0))
    index = {w: i for i, w in enumerate(chosen)}

    def vectors(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                at, values = [], []
                for text in part.column("text").to_pylist():
                    found = Counter([index[w] for w in features_of(words_of(text)) if w in index])
                    at.append(list(found))
                    values.append([1 + float(np.log(n)) for n in found.values()])
                cols = [part.column("doc_id"), part.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "at", "x"])

    # bounded: at most ``limit`` rows of features
    rows = texts.mapInArrow(tidied(vectors), "doc_id long, label int, at array<int>, x array<float>").orderBy("doc_id", F.size("at")).toArrow()
    y = (rows.column("label").to_numpy() > 0).astype(int)
    lists = rows.column("at").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    at = lists.flatten().to_numpy(zero_copy_only=False)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    del rows, lists
    doc = np.repeat(np.arange(len(y), dtype=np.int32), size)
    # of features that no text of the sample tells apart the first, the shortest, stands for all
    sums = _sums(at, doc, x, np.random.default_rng(0).random(len(y)), len(chosen))
    alone = np.zeros(len(chosen), bool)
    alone[np.unique(np.round(sums, 6), return_index=True)[1]] = True
    own = alone[at]
    doc, at, x = doc[own], at[own], x[own]
    # with one grade of toxic documents first: its scores say which are severe
    w, t = _growing(doc, at, x, 2 * y, len(chosen))
    marks = _sums(doc, at, x, w, len(y))
    marked = marks[(y == 1) & (marks > 0)]
    grade = np.where(y == 0, 0, np.where(marks > (np.median(marked) if len(marked) else 0), 2, 1))
    w, t = _growing(doc, at, x, grade, len(chosen))
    return Severity({word: float(w[i]) for word, i in index.items() if w[i]}, (float(t[0]), float(t[1])))


def _sums(to: np.ndarray, of: np.ndarray, x: np.ndarray, values: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """For each of ``size`` targets the sum of x times the value of its source; in steps, so that little is copied at a time."""
    out = np.zeros(size)
    for i in range(0, len(to), step):
        cut = slice(i, i + step)
        out += np.bincount(to[cut], weights=x[cut] * values[of[cut]], minlength=size)
    return out


def _growing(doc: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The fit over all ``width`` features, by fits over those that would gain a weight against the prior."""
    n, whole = len(grade), np.zeros(width)
    t = np.array([np.log(max((grade == 0).sum(), 1) / max((grade > 0).sum(), 1)), 2.0])
    place, size = np.full(width, -1), 0
    while True:
        d1, d2 = _slopes(_sums(doc, at, x, whole, n), t, grade)
        gain = -_sums(at, doc, x, d1 + d2, width)
        gain[place >= 0] = 0
        more = np.flatnonzero(gain > 1.02 * PRIOR)
        if not len(more):
            return whole, t
        more = more[np.argsort(-gain[more], kind="stable")][:JOIN]
        place[more] = size + np.arange(len(more))
        size += len(more)
        own, w = place[at] >= 0, np.zeros(size)
        w[place[place >= 0]] = whole[place >= 0]
        w, t = _cumulative_link(doc[own], place[at[own]], x[own], grade, size, w, t[0], steps)
        whole[place >= 0] = w[place[place >= 0]]


def _slopes(s: np.ndarray, t: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """d loss / d (s - t_k) of each document: grade 0 leaves below t_1, 1 lies between, 2 above t_2."""
    p1, p2 = (1 / (1 + np.exp(np.clip(c - s, -500, 500))) for c in t)
    mid = np.maximum(p1 - p2, 1e-12)
    d1 = np.where(grade == 0, p1, np.where(grade == 1, -p1 * (1 - p1) / mid, 0))
    d2 = np.where(grade == 2, -(1 - p2), np.where(grade == 1, p2 * (1 - p2) / mid, 0))
    return d1, d2


def _cumulative_link(doc: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, w=None, t1: float = 0.0, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and two ordered thresholds by full-batch Adam on the ordinal log loss and the prior."""
    n = len(grade)
    # the weights, the first threshold, the log of the gap to the second
    m, v, params = np.zeros(width + 2), np.zeros(width + 2), np.append(np.zeros(width) if w is None else w, [t1, 0.5])
    for k in range(1, steps + 1):
        w, t1, gap = params[:-2], params[-2], np.exp(params[-1])
        s = np.bincount(doc, weights=x * w[at], minlength=n)
        d1, d2 = _slopes(s, np.array([t1, t1 + gap]), grade)
        d1, d2 = d1 / n, d2 / n
        g = np.concatenate([np.bincount(at, weights=x * (d1 + d2)[doc], minlength=width) + PRIOR / n, [-(d1 + d2).sum(), -d2.sum() * gap]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        params[:-2] = np.maximum(params[:-2], 0)
    return params[:-2], np.array([params[-2], params[-2] + np.exp(params[-1])])


def score(docs: DataFrame, model: Severity, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with severity double (0 to 2), grade int and toxic boolean.

    severity is the expected grade, grade the number of thresholds passed with
    probability ``threshold``, toxic grade > 0. Null and empty texts have no
    features. The text goes unless ``keep_text``; a taken name gets a leading
    underscore; repeated rows score alike; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    schema = grown(schema, ("severity", "double"), ("grade", "int"), ("toxic", "boolean"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                p = model.grades(part.column(text).to_pylist())
                grade = (p >= threshold).sum(axis=1)
                cols = [*(part.column(c) for c in kept), pa.array(p.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(grade > 0)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the model of ``labels`` calls toxic, otherwise as they were."""
    scored = score(docs, fit(docs, labels), keep_text=True)
    return scored.where(~F.col(f"`{scored.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
