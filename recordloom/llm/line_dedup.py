"""Line dedup: winnowed line hashes find repeated runs of lines across a corpus.

Lines are compared in lower case with white space collapsed; blank ones are no
lines. A window is the shortest run of lines from a line on (and, likewise, up
to a line) with at least ``run_words`` words. Equal runs have equal windows, so
the line of lowest hash in each window is a fingerprint that both copies are
sure to select; neighbouring windows mostly select the same line, and a document
gives each selected line once. Places of equal fingerprints are joined. Where a
fingerprint has two places, it is carried both ways, to the ends of the windows
that selected it. Of equal windows the first in order of (doc_id, position)
stays; windows that touch make one run, and the lines of later copies go. The
first copy of every line that goes is always kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, grown, split_join, staged, table, text_key, text_slices, tidied

#: A repeated run of this many words or more is deleted from all but its first place.
RUN_WORDS = 50


def split_lines(text: str | None) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """All lines of a text; indexes, hashes and word counts of those that aren't blank."""
    lines = (text or "").split("\n")
    at, hashes, words = [], [], []
    digest = xxhash.xxh64_intdigest
    for i, line in enumerate(lines):
        parts = line.lower().split()
        if parts:
            at.append(i)
            hashes.append(digest(" ".join(parts).encode("utf-8", "surrogatepass")))
            words.append(len(parts))
    return lines, at, np.array(hashes, np.uint64), np.array(words, np.int64)


def windows(words: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line (inclusive) of every shortest run of ``run_words`` words or more."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + run_words)  # lines before this index make the run
    ahead = np.flatnonzero(ends <= n)
    starts = np.searchsorted(total, total[1:] - run_words, side="right") - 1
    back = np.flatnonzero(starts >= 0)
    pairs = np.concatenate([np.stack([ahead, ends[ahead] - 1], axis=1), np.stack([starts[back], back], axis=1)])
    pairs = np.unique(pairs, axis=0)
    return pairs[:, 0], pairs[:, 1]


def _lowest(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the lowest hash in each run (the last of equals), by doubling spans."""
    n = len(hashes)
    best = [np.arange(n)]
    span = 1
    while span * 2 <= int((last - first).max()) + 1:
        a, b = best[-1][: n - 2 * span + 1], best[-1][span : span + n - 2 * span + 1]
        best.append(np.where(hashes[a] < hashes[b], a, b))
        span *= 2
    level = np.log2(last - first + 1).astype(int)
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        m = level == k
        a, b = best[k][first[m]], best[k][last[m] - (1 << k) + 1]
        out[m] = np.where(hashes[a] < hashes[b], a, b)
    return out


def _run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    raw = hashes.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b + 8], 7) for a, b in zip(first.tolist(), last.tolist())], np.uint64)


def _selected(text: str | None, run_words: int) -> tuple[np.ndarray, ...]:
    """The windows of a text in order of the line that each selects: first, last, hash, that line, its hash."""
    _, _, hashes, words = split_lines(text)
    first, last = windows(words, run_words)
    if not len(first):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    low = _lowest(hashes, first, last)
    order = np.argsort(low, kind="stable")
    first, last, low = first[order], last[order], low[order]
    return first, last, _run_hashes(hashes, first, last).view(np.int64), low, hashes[low]


def _scan(docs: DataFrame, run_words: int) -> DataFrame:
    """A row for each selected line: (doc_id, key, line, mark) and the windows that select it."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for i, text in enumerate(part.column("text").to_pylist()):
                    made = _selected(text, run_words)
                    if len(made[0]):
                        for held, x in zip(rows, (np.full(len(made[0]), i), *made)):
                            held.append(x)
                if not rows[0]:
                    continue
                row, first, last, whole, low, mark = map(np.concatenate, rows)
                starts = np.concatenate([[0], np.flatnonzero((row[1:] != row[:-1]) | (low[1:] != low[:-1])) + 1])
                offsets = pa.array(np.append(starts, len(row)), pa.int32())
                cols = [part.column(c).take(pa.array(row[starts])) for c in ("doc_id", "key")]
                cols += [pa.array(low[starts]), pa.array(mark[starts].view(np.int64))]
                cols += [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((first, pa.int32()), (last, pa.int32()), (whole, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "line", "mark", "first", "last", "run"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidied(run), "doc_id long, key long, line long, mark long, first array<int>, last array<int>, run array<long>")


def repeated_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, key, first, last): runs of non-blank lines, by number, that repeat earlier ones.

    ``docs`` has doc_id, key (a hash of the text) and text.
    """
    places = staged(_scan(docs, run_words), "lines-places")
    # a fingerprint is worth a look if it is selected in two places
    place = F.struct("doc_id", "key", "line")
    marks = places.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    marks = staged(marks.where("a <> b").select("mark", "n"), "lines-marks")
    twice = split_join(places, marks, ["mark"], "n", semi=True)
    known = staged(twice.select("doc_id", "key", "mark", F.inline(F.arrays_zip("first", "last", "run"))), "lines-windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "first", "last")
    runs = known.groupBy("run", "mark").agg(F.min(order).alias("o"), F.max(order).alias("z"), F.count("*").alias("n"))
    runs = staged(runs.where("o < z").select("run", "mark", "o", "n"), "lines-runs")
    here = split_join(known, runs, ["run", "mark"], "n")
    own = F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("key") == F.col("o.key"))
    # in one document, a copy must not overlap the run that it repeats
    later = here.where(F.when(own, F.col("first") > F.col("o.last")).otherwise(True))
    return later.select("doc_id", "key", "first", "last").distinct()


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of the text; no row goes.

    Kept lines stay as they are, in order, joined by newlines; blank lines
    between deleted ones go too. ``counts`` adds n_lines (all lines) and
    n_deleted. Null texts stay null and have no lines; an empty text has one.
    Rows without doc_id come last in the order; rows equal in doc_id and text
    are one document and are treated alike. Taken names get a leading
    underscore. An empty table gives no rows.
    """
    columns = list(docs.columns)
    key = bare("key", columns)
    keyed = docs.withColumn(key, text_key(text))
    slim = keyed.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(f"`{text}`").alias("text"))
    pairs = repeated_lines(slim, run_words)
    # windows that touch make one span; a document has at most two windows a line
    spans = staged(pairs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "lines-spans")
    mine = bare("spans", [*columns, key])
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("spans").alias(mine))
    joined = keyed.join(spans, keyed[f"`{doc_id}`"].cast("long").eqNullSafe(spans["_d"]) & (keyed[key] == spans["_k"]), "left")
    joined = joined.select(*[keyed[f"`{c}`"] for c in columns], mine)
    schema = docs.schema
    if counts:
        schema = grown(schema, ("n_lines", "long"), ("n_deleted", "long"))
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                out, n_lines, n_deleted = [], [], []
                for t, found in zip(part.column(text).to_pylist(), part.column(mine).to_pylist()):
                    if found:
                        lines, at, _, _ = split_lines(t)
                        gone = np.zeros(len(lines), bool)
                        for a, b in _merged((x["first"], x["last"]) for x in found):
                            gone[at[a] : at[b] + 1] = True
                        out.append("\n".join([x for x, g in zip(lines, gone.tolist()) if not g]))
                        n_lines.append(len(lines))
                        n_deleted.append(int(gone.sum()))
                    else:
                        out.append(t)
                        n_lines.append(0 if t is None else t.count("\n") + 1)
                        n_deleted.append(0)
                cols = [pa.array(out, pa.string()) if c == text else part.column(c) for c in columns]
                if counts:
                    cols += [pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(tidied(run), schema)


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with ``length``, where it is a column, set to the text's length; null texts keep theirs."""
    if length not in docs.columns:
        return docs
    n = F.length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)
    return docs.withColumn(length, F.coalesce(n, F.col(f"`{length}`")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated runs, with counts of lines; cases as in ``drop_repeated``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated(docs, counts=True)


#: The same by brute force: the words of every window as one string, no fingerprints.
OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, u.line, u.i FROM documents,
    unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'line': x, 'i': i}})) AS t(u)),
worded AS (SELECT doc_id, i, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS line FROM lines),
full_lines AS (SELECT doc_id, i, line, len(string_split(line, ' ')) AS n FROM worded WHERE line <> ''),
placed AS (SELECT *, row_number() OVER w AS p, sum(n) OVER w AS t FROM full_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
ends AS (
  SELECT a.doc_id, a.p AS first, min(b.p) AS last FROM placed a JOIN placed b
    ON a.doc_id = b.doc_id AND b.p >= a.p AND b.t - a.t + a.n >= {RUN_WORDS} GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.p) AS first, a.p AS last FROM placed a JOIN placed b
    ON a.doc_id = b.doc_id AND b.p <= a.p AND a.t - b.t + b.n >= {RUN_WORDS} GROUP BY a.doc_id, a.p),
runs AS (SELECT e.doc_id, first, last, string_agg(line, chr(10) ORDER BY p) AS run
  FROM ends e JOIN placed q ON e.doc_id = q.doc_id AND q.p BETWEEN first AND last GROUP BY ALL),
firsts AS (SELECT run, min({{'d': doc_id, 'f': first, 'l': last}}) AS o FROM runs GROUP BY run),
copies AS (SELECT doc_id, first, last FROM runs JOIN firsts USING (run)
  WHERE doc_id <> o.d OR first > o.l),
numbered AS (SELECT DISTINCT c.doc_id, q.i, q.p FROM copies c JOIN placed q ON c.doc_id = q.doc_id AND q.p BETWEEN first AND last),
gaps AS (SELECT doc_id, i, lead(i) OVER w AS j, lead(p) OVER w - p AS d FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, CASE WHEN d = 1 THEN j ELSE i + 1 END)) AS i FROM gaps)
SELECT l.doc_id, CASE WHEN any_value(l.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END AS text,
  CASE WHEN any_value(l.text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(g.i) AS n_deleted
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
