"""Phrase collocations per language, counted and scored as rows of DataFrames.

A run of words is first counted under a hash of 32 bits: tasks send packed
counts of hashes, which are summed by ranges of hashes, and those that reach
the least count are noted in a table of bits of fixed size. Longer runs take
part only where all shorter ones in them are noted, as no other can be
frequent. Last, the noted runs are counted as texts. Hashes that meet only let
a rare run through to that count, so what comes out is exact, and neither
rare runs nor texts are shuffled. Candidates join the counts of their first
and last parts at every cut, are scored in integers of 38 digits, leave where a
phrase longer by one word holds nearly all their places, and are ranked.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, stored, table, text_slices, tidied, written

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
SCALE = 2_000_000
#: A candidate goes if a longer one has this many hundredths of its count.
COVERED = 80
#: Counts that a task holds before it sends them on.
SENT = 1 << 22
#: Phrases that a task holds before it sends them on.
HELD = 1 << 19
#: Bits of a hash, of the range that is summed at a time, and of the table of frequent hashes.
HASH, RANGE, NOTED = 32, 22, 28
#: Letters that are hashed at a time; a longer word is one.
BLOCK = 1 << 19
#: Candidates of a language are ranked in so many parts first.
PARTS = 64

# What parts pieces, and the language of rows without one.
PIECE_ENDS, NO_LANG = b".,;:!?\n\v\f\r", "und"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"abcdefghijklmnopqrstuvwxyz ")
_KINDS = np.zeros(256, np.int8)
_KINDS[32] = 1
_KINDS[list(PIECE_ENDS)] = 2
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(11).integers(1 << 40, 1 << 63, 6).tolist()]


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    n = int(_ODD[which])
    return tuple(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (n, pow(n, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[2]
    h = (h ^ (h >> np.uint64(29))) * _ODD[3]
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a few texts in lower case, and the runs of words that stand in one piece."""

    def __init__(self, texts: list[bytes | None], langs: list[str | None]):
        self.body = b"\n".join(t or b"" for t in texts).translate(_LOWER)
        letters = np.frombuffer(self.body, np.uint8)
        kinds = _KINDS[letters]
        edge = np.diff((kinds == 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kinds == 2, dtype=np.int64)[self.starts]
        names: dict[str, int] = {}
        code = np.array([names.setdefault(NO_LANG if x is None else x, len(names)) for x in langs], np.int64)
        first = np.cumsum([0] + [len(t or b"") + 1 for t in texts[:-1]])
        self.langs, self.lang = list(names), code[np.searchsorted(first, self.starts, "right") - 1]
        self.one = [self._hashes(letters, which) for which in (0, 1)]

    def _hashes(self, letters: np.ndarray, which: int) -> np.ndarray:
        """A hash of 64 bits of each word and its language."""
        seeds = np.array([xxhash.xxh64_intdigest(x, which) for x in self.langs], np.uint64)
        out, w, a = np.empty(len(self.starts), np.uint64), 0, 0
        while w < len(out):
            to = max(int(np.searchsorted(self.starts, a + BLOCK)), w + 1)
            b = int(self.ends[to - 1])
            up, down = _powers(which, 1 << (max(b - a, 2 * BLOCK) - 1).bit_length())
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((letters[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
            starts, ends = self.starts[w:to] - a, self.ends[w:to] - a
            own = (sums[ends] - sums[starts]) * down[starts]
            out[w:to] = _mixed(_mixed(own ^ ((ends - starts).astype(np.uint64) << np.uint64(48))) + seeds[self.lang[w:to]])
            w, a = to, b
        return out

    def runs(self, low: int, high: int, noted=None, known: int = 0):
        """(m, places, two hashes of each) of runs of ``low`` to ``high`` words, if their shorter runs of up to ``known`` words are ``noted``."""
        at, hashes = np.arange(len(self.starts)), self.one
        for m in range(1, high + 1):
            if m > 1:
                before = np.zeros(len(self.starts) + 1, bool)
                before[at] = True
                last = np.minimum(at + m - 1, len(self.starts) - 1)
                pick = np.flatnonzero((at + m <= len(self.starts)) & before[at + 1] & (self.piece[at] == self.piece[last]))
                at = at[pick]
                hashes = [_mixed(h[pick] * _ODD[4 + k] + one[at + m - 1]) for k, (h, one) in enumerate(zip(hashes, self.one))]
            if m <= known:
                keep = np.flatnonzero(noted(hashes[0]))
                at, hashes = at[keep], [h[keep] for h in hashes]
            if m >= low:
                yield m, at, hashes

    def phrase(self, at: int, m: int) -> bytes:
        raw = self.body[self.starts[at] : self.ends[at + m - 1]]
        return b" ".join(w for w in raw.split(b" ") if w) if b"  " in raw else raw


def _words(batches):
    for batch in batches:
        for part in text_slices(batch, "text"):
            yield Words(part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist())


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes, low ones of all first, as many as are needed; the first byte says how many."""
    n = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([n]) + x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:n].tobytes()


def _whole(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    return sum((row.astype(np.uint32) << np.uint32(8 * k) for k, row in enumerate(own)), np.uint32(0))


def _table(paths: list[str]):
    """Which hashes are noted in staged tables, by a table of bits; some others pass, too."""
    bits = np.zeros(1 << (NOTED - 3), np.uint8)
    for path in paths:
        for rows in stored(path, 1 << 20):
            at = rows.column("hash").to_numpy().astype(np.uint64) >> np.uint64(HASH - NOTED)
            np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def noted(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - NOTED)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    return noted


def _frequent(rows: DataFrame, low: int, high: int, least: int, paths: list[str], name: str) -> str:
    """Where the hashes of runs of ``low`` to ``high`` words with ``least`` places or more are staged."""

    def counted(batches):
        noted = _table(paths) if paths else None
        held, n = [], 0

        def sent():
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(hashes, np.arange((1 << (HASH - RANGE)) + 1, dtype=np.uint64) << np.uint64(RANGE))
            some = [(k, hashes[a:b] & np.uint32((1 << RANGE) - 1), np.minimum(counts[a:b], least)) for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            cols = [pa.array([k for k, _, _ in some], pa.int32()), pa.array([_planes(np.diff(h, prepend=np.uint32(0))) for _, h, _ in some], pa.binary()), pa.array([_planes(c) for _, _, c in some], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "hashes", "counts"])

        for words in _words(batches):
            for _, _, hashes in words.runs(low, high, noted, low - 1):
                held.append((hashes[0] >> np.uint64(64 - HASH)).astype(np.uint32))
                n += len(held[-1])
            if n > SENT:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    def summed(batches):
        part, sums = None, np.zeros(1 << RANGE, np.uint32)

        def done():
            hashes = np.flatnonzero(sums >= least) + (part << RANGE)
            sums.fill(0)
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], names=["hash"])

        for batch in batches:
            for own, raw, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "counts"))):
                if own != part and part is not None:
                    yield done()
                part = own
                at = np.cumsum(_whole(raw), dtype=np.uint32)
                sums[at] = np.minimum(sums[at] + _whole(counts), np.uint32(least))
        if part is not None:
            yield done()

    packed = rows.mapInArrow(tidied(counted), "part int, hashes binary, counts binary")
    return written(packed.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(summed), "hash long"), name)


def _phrases(rows: DataFrame, max_words: int, least: int, paths: list[str]) -> DataFrame:
    """(lang, phrase, f) of noted runs with ``least`` places; the empty phrase counts all words.

    A task sends its counts as lists, by the range of their hashes; those of a range are summed by text.
    """

    def counted(batches):
        noted = _table(paths)
        known: dict[tuple, list] = {}
        totals: dict[str, int] = {}

        def sent():
            parts: dict[int, list] = {0: [(x, "", n) for x, n in totals.items()]}
            for (h, _), (x, phrase, n) in known.items():
                parts.setdefault(h >> (64 - HASH + RANGE), []).append((x, phrase.decode(), n))
            cols = [pa.array(parts, pa.int32())] + [pa.array([[r[k] for r in own] for own in parts.values()], pa.list_(t)) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            known.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays(cols, names=["part", "lang", "phrase", "f"])

        for words in _words(batches):
            for x, n in zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                totals[x] = totals.get(x, 0) + n
            for m, at, (h, other) in words.runs(1, max_words, noted, max_words):
                order = np.lexsort((other, h))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(other[order]) != 0)])) if len(at) else np.empty(0, int)
                counts = np.diff(np.append(new, len(at)))
                first = order[new]
                for place, key, n in zip(at[first].tolist(), zip(h[first].tolist(), other[first].tolist()), counts.tolist()):
                    if (row := known.get(key)) is not None:
                        row[2] += n
                    else:
                        known[key] = [words.langs[words.lang[place]], words.phrase(place, m), n]
            if len(known) > HELD:
                yield sent()
        if totals:
            yield sent()

    def summed(batches):
        part, sums = None, {}

        def done():
            full = [(*key, n) for key, n in sums.items() if n >= least or not key[1]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, langs, phrases, counts = (batch.column(c)[i].as_py() for c in ("part", "lang", "phrase", "f"))
                if own != part and part is not None:
                    yield done()
                part = own
                for key, n in zip(zip(langs, phrases), counts):
                    sums[key] = sums.get(key, 0) + n
        if part is not None:
            yield done()

    packed = rows.mapInArrow(tidied(counted), "part int, lang array<string>, phrase array<string>, f array<long>")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(summed), "lang string, phrase string, f long")


def _length() -> Column:
    """The words of a phrase, which holds no other blanks."""
    return F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "))) + 1


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """``rows`` of the best ``top`` ranks of each language; parts of a language are ranked first, so that no task gets all of it."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = rows.withColumn("_p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*best))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top).drop("_p")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut that scores
    lowest (of equal scores the first), ``n`` all words of the language. Ties
    in rank go to the larger count, then to the phrase that comes first in
    bytes. A null text is empty and a null language is NO_LANG; texts of blanks
    or marks alone have no phrase. Repeated rows count each time. A very long
    piece is one row of its words. Columns besides text and language play no
    part, whatever their names. An empty table, or one without a phrase of
    ``min_count`` places, gives no rows.

    Hashes and counts are staged in the shared folder. Phrases of a task are
    told apart by 128 bits before they are texts.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    # the hashes of words and pairs, then of longer runs of frequent pairs
    paths = [_frequent(rows, 1, min(2, max_words), min_count, [], "phrase-short")]
    if max_words > 2:
        paths.append(_frequent(rows, 3, max_words, min_count, paths, "phrase-long"))
    found = staged(_phrases(rows, max_words, min_count, paths), "phrase-counts")
    totals = found.where("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = found.where("phrase <> ''").withColumn("m", _length())
    candidates = counts.where("m > 1").select("lang", "phrase", F.col("f").alias("a"), "m")

    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice(words, F.lit(1), k)).alias("first"), F.concat_ws(" ", F.slice(words, k + 1, F.col("m") - k)).alias("rest")))
    cut = candidates.select("lang", "phrase", "a", F.inline(cuts))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast((cast({SCALE} AS decimal(7,0)) * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS long)")
    low = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    scored = low.select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    ends = F.array(F.concat_ws(" ", F.slice(words, F.lit(1), F.col("m") - 1)), F.concat_ws(" ", F.slice(words, F.lit(2), F.col("m") - 1)))
    longer = candidates.where("m > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = longer.join(candidates.select("lang", "phrase", "a"), ["lang", "phrase"]).where(F.expr(f"100BD * longer >= {COVERED}BD * a")).select("lang", "phrase")
    kept = scored.join(covered, ["lang", "phrase"], "left_anti")
    return _ranked(kept, top).join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language of all documents; cases as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same by listing every run of one to four words.
OP11_SQL = f"""
WITH t AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, {MAX_WORDS + 1}) AS s(m))),
f AS (SELECT lang, m, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING m = 1 OR count(*) >= {MIN_COUNT}),
n AS (SELECT lang, cast(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, phrase, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.*, x.f AS l, y.f AS r, cast(({SCALE} * cast(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.m)),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM f x JOIN f y ON x.lang = y.lang AND x.m > 1 AND y.m > x.m
  AND 100 * cast(y.f AS HUGEINT) >= {COVERED} * cast(x.f AS HUGEINT) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
kept AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= {TOP}
"""
