"""Document quality by a regularised quadratic discriminant of text statistics.

Each class is a normal distribution over transformed statistics of a document.
Its covariance is shrunk towards its diagonal and the pooled one, and factored
once; a score is the logistic of the difference of log densities (Mahalanobis
distances through the Cholesky factors) plus the log odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grown, staged, table, text_slices

#: Shares of the pooled covariance and of the diagonal in each class's covariance.
POOLED, DIAGONAL = 0.1, 0.1
RIDGE = 1e-3
THRESHOLD = 0.3
#: The learning rows: crc32 of the id as text, modulo FOLDS, is not 0.
FOLDS = 5

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_STOP = np.isin(_ASCII, [ord(c) for c in ".!?"])
_COMMON = np.isin(_ASCII, [ord(c) for c in ".,'-"])
_SPACE = np.isin(_ASCII, [9, 10, 11, 12, 13, 32])
_MARK = (_ASCII < 128) & (_ASCII > 32) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_COMMON

NAMES = (
    "log_chars", "log_words", "upper", "digit", "mark", "bang", "beyond_ascii", "word_length", "word_spread",
    "distinct", "pairs", "top_word", "line_repeat", "sentence", "line_words", "entropy",
)


def _rate(part: float, whole: float) -> float:
    """A share on a log scale, where few and none differ little."""
    return float(np.log((part + 0.5) / (whole + 50.0)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty one has those of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = int(counts.sum())
    words = raw.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    lower = raw.lower().split()
    kinds: dict[bytes, int] = {}
    for w in lower:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = len(set(zip(lower, lower[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops = int(counts[_STOP].sum())
    letters = counts[_LOWER | _UPPER].sum()
    share = counts[counts > 0] / max(n, 1)
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        _rate(counts[_UPPER].sum(), letters),
        _rate(counts[_DIGIT].sum(), n),
        _rate(counts[_MARK].sum(), n),
        _rate(counts[ord("!")], n),
        _rate(counts[128:].sum(), n),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log((len(kinds) + 1) / (m + 2)) + 0.35 * np.log(m + 2)),
        float(np.log((m + 1) / (pairs + 1))),
        _rate(max(kinds.values(), default=0), m),
        _rate(len(lines) - len(set(lines)), len(lines)),
        float(np.log((m + 1) / (stops + 1))),
        float(np.log((m + 1) / (len(lines) + 1))),
        float(-(share * np.log(share)).sum()) if n else 0.0,
    ]


@dataclass
class Quadratic:
    """Two normal classes; ``whiten`` holds inverse Cholesky factors."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        d = [((x - self.means[c]) @ self.whiten[c].T) for c in (0, 1)]
        logs = [self.offsets[c] - 0.5 * (d[c] ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _sums(batches):
    """For each class: the count, the sums, and the sums of products, as (class, i, value)."""
    k = len(NAMES)
    held = {0: np.zeros((k + 1, k + 1)), 1: np.zeros((k + 1, k + 1))}
    for batch in batches:
        y = batch.column("label").to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(-1, k)
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        for c in held:
            held[c] += x[y == c].T @ x[y == c]
    out = [(c, i, float(v)) for c, m in held.items() if m[0, 0] for i, v in enumerate(m.ravel())]
    if out:
        a, b, v = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.float64())], names=["c", "i", "v"])


def add_statistics(docs: DataFrame, text: str = "text", name: str = "x") -> DataFrame:
    """``docs`` without its text, with the statistics as array<double> in ``name``."""
    kept = [c for c in docs.columns if c != text]
    schema = grown(docs.select(*[F.col(f"`{c}`") for c in kept]).schema, (name, "array<double>"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                x = [statistics(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def fit(rows: DataFrame) -> Quadratic | None:
    """The model of all ``rows`` (label 0 or 1, x); None unless both classes have rows."""
    k = len(NAMES)
    sums = rows.mapInArrow(_sums, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))
    made = {0: np.zeros((k + 1) ** 2), 1: np.zeros((k + 1) ** 2)}
    for r in sums.collect():  # 2 x (k + 1)^2 numbers
        made[r["c"]][r["i"]] = r["v"]
    made = {c: m.reshape(k + 1, k + 1) for c, m in made.items()}
    n = np.array([made[c][0, 0] for c in (0, 1)])
    if not n.all():
        return None
    means = np.stack([made[c][0, 1:] / n[c] for c in (0, 1)])
    own = np.stack([made[c][1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, offsets = [], []
    for c in (0, 1):
        s = (1 - POOLED - DIAGONAL) * own[c] + POOLED * pooled + DIAGONAL * np.diag(np.diag(own[c]))
        low = np.linalg.cholesky(s + RIDGE * np.diag(np.diag(pooled) + RIDGE))
        whiten.append(np.linalg.inv(low))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Quadratic(means, np.stack(whiten), np.array(offsets))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    The model is fitted on all labelled rows outside the held-out fold; an id
    with several labels has the lowest; null ids and labels are not learnt
    from, and a null doc_id is not held out. Null and empty texts are scored by
    the statistics of no words. Without labels of both classes each score is
    the share of class 1 among them (0.5 with none). Repeated rows score alike;
    further columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    seen = staged(add_statistics(rows.withColumn("held_out", held)), "quality-statistics")
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    known = known.groupBy("_id").agg(F.min("label").alias("label"))
    train = seen.where(~F.col("held_out")).join(known, seen["doc_id"] == known["_id"]).select("label", "x")
    model = fit(train)
    if model is None:
        share = train.agg(F.avg(F.col("label").cast("double"))).first()[0]
        scored = seen.select("doc_id", "held_out", F.lit(0.5 if share is None else float(share)).alias("score"))
    else:

        def run(batches):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x))], names=["doc_id", "held_out", "score"])

        scored = seen.mapInArrow(run, grown(seen.select("doc_id", "held_out").schema, ("score", "double")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the labels outside the held-out fold; cases as in ``score``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
