"""Benchmark decontamination with one Aho-Corasick automaton over words.

Texts become words (runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z in lower case). Any WINDOW consecutive words of a test item
hold one of its blocks: the items cut into pieces of half a window. These blocks
are the automaton's patterns, so it has about a node for each word of the
benchmark and not one for each word of each window. It reads a document's words
once, as numbers in the vocabulary of the items. A block that occurs is carried
both ways as far as the words around it agree with an item; the windows are what
reaches WINDOW words. An item of fewer words is one pattern and one window.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, grown, stored, table, text_slices, tidied, written

WINDOW = 13
#: Test items that are read from the shared folder at a time.
ITEMS = 1000

_BLANK = 0x20
_NORMAL = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else _BLANK for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def word_spans(text: str) -> np.ndarray:
    """(n, 2) character offsets in the original text of its words."""
    raw = text.encode("utf-8", "surrogatepass")
    kept = np.frombuffer(raw.translate(_NORMAL), np.uint8) != _BLANK
    edge = np.diff(np.concatenate([[0], kept.view(np.int8), [0]]))
    spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
    # bytes that continue a character do not count
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return chars[spans]


class Windows:
    """The windows of test items, as an automaton of blocks and the words around each block.

    ``items`` gives (item, text) pairs; it is read once, and the texts aren't kept.
    """

    def __init__(self, items, window: int = WINDOW):
        self.window = window
        self.size = (window + 1) // 2
        self.reach = window - self.size  # words beside a block that can share a window with it
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.cuts = np.zeros(1, np.int64)
        known: dict[str, int] = {}
        codes, owner, ends, n = [], [], [], 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            if item not in known:
                known[item] = len(self.names)
                self.names.append(item)
            codes.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
            owner.append(known[item])
            n += len(words)
            ends.append(n)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        if codes:
            self._build(np.concatenate(codes), np.array(owner, np.int32), np.array(ends, np.int64))

    def _build(self, codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> None:
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        whole = sizes < self.window
        many = np.where(whole, 1, sizes // self.size)
        item = np.repeat(np.arange(len(sizes)), many)
        at = starts[item] + (np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)) * self.size
        length = np.where(whole[item], sizes[item], self.size)
        # the words beside a block, from the nearest outwards; a negative number is no word
        side = np.arange(1, self.reach + 1)
        left, right = at[:, None] - side, (at + length - 1)[:, None] + side
        padded = np.append(codes, -1)
        left = padded[np.where((left >= starts[item][:, None]) & ~whole[item][:, None], left, -1)]
        right = padded[np.where((right < ends[item][:, None]) & ~whole[item][:, None], right, -1)]
        places: dict[tuple[int, ...], int] = {}
        number = np.empty(len(at), np.int64)
        flat = codes.tolist()
        for i, (a, k) in enumerate(zip(at.tolist(), length.tolist())):
            number[i] = places.setdefault(tuple(flat[a : a + k]), len(places))
        for key, k in places.items():
            self.machine.add_word(key, k)
        self.machine.make_automaton()
        # flat arrays in order of block: its pieces with the words around them, then whole items
        order = np.lexsort((whole[item], number))
        self.around, self.owners = np.concatenate([left, right], axis=1)[order], owner[item][order]
        count = np.bincount(number, minlength=len(places))
        self.cuts = np.concatenate([[0], np.cumsum(count)])
        self.pieces = self.cuts[1:] - np.bincount(number, weights=whole[item], minlength=len(places)).astype(np.int64)
        self.sizes = np.fromiter(map(len, places), np.int32, len(places))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) inside windows, and the items whose windows occur."""
        if len(self.cuts) == 1:
            return [], set()
        vocabulary, reach = self.vocabulary, self.reach
        codes = tuple([vocabulary.get(w, 0) for w in words])
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        line = None
        for end, k in self.machine.iter(codes):
            size, first, middle, last = int(self.sizes[k]), self.cuts[k], self.pieces[k], self.cuts[k + 1]
            start, end = end + 1 - size, end + 1
            if middle < last:  # whole items
                spans.append((start, end))
                found.update(self.owners[middle:last].tolist())
            if first == middle:
                continue
            if line is None:
                # beyond the text's ends stands a number that no item has
                line = np.concatenate([np.full(reach, -2), codes, np.full(reach, -2)]).astype(np.int32)
            at, around = start + reach, self.around[first:middle]
            lefts = _leading(around[:, :reach] == line[at - reach : at][::-1])
            rights = _leading(around[:, reach:] == line[at + size : at + size + reach])
            hit = np.flatnonzero(lefts + rights + size >= self.window)
            if len(hit):
                found.update(self.owners[first:middle][hit].tolist())
                spans += {(start - a, end + b) for a, b in zip(lefts[hit].tolist(), rights[hit].tolist())}
        return merged(spans), {self.names[k] for k in found}


def _leading(same: np.ndarray) -> np.ndarray:
    """For each row, how many of its first values are true."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if same.shape[1] else np.zeros(len(same), np.int64)


_WINDOWS: dict[tuple[str, int], Windows] = {}


def _windows(path: str, window: int) -> Windows:
    """The windows of the staged items, built once in each Python worker."""
    if (path, window) not in _WINDOWS:
        _WINDOWS.clear()
        rows = (row for batch in stored(path, ITEMS) for row in zip(*(c.to_pylist() for c in batch.columns)))
        _WINDOWS[path, window] = Windows(rows, window)
    return _WINDOWS[path, window]


def find_windows(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), with what the benchmark's windows hit.

    New columns: n_words long, n_hit long, items array<string> (sorted),
    spans array<struct<start, end>> (characters of the original text).

    Null and empty texts have no words. Items without words have no windows;
    items without an id go by the empty id; items that share an id are one
    item. New columns whose names are taken get a leading underscore. Repeated
    rows are judged alike. Empty tables give no rows, or no hits.

    The documents are read once, whatever the benchmark's size, and the driver
    holds none of the items: they are staged in the shared folder, and each
    Python worker builds the automaton from them. Its memory grows with the
    benchmark alone.
    """
    text = doc_text
    kept = [c for c in docs.columns if keep_text or c != text]
    names = [bare(n, kept) for n in ("n_words", "n_hit", "items", "spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in (kept if keep_text else [*kept, text])])
    pair = "array<struct<start: long, end: long>>"
    schema = grown(rows.select(*[F.col(f"`{c}`") for c in kept]).schema, *zip(names, ("long", "long", "array<string>", pair)))
    arrow = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    path = written(benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{item_text}`").alias("text")), "benchmark")

    def run(batches):
        windows = _windows(path, window)
        for batch in batches:
            for part in text_slices(batch, text):
                out: list[list] = [[], [], [], []]
                for t in part.column(text).to_pylist():
                    words = words_of(t)
                    spans, items = windows.scan(words)
                    at = word_spans(t) if spans else None
                    out[0].append(len(words))
                    out[1].append(sum(b - a for a, b in spans))
                    out[2].append(sorted(items))
                    out[3].append([{"start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in spans])
                cols = [part.column(c) for c in kept] + [pa.array(x, kind) for x, kind in zip(out, arrow)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(tidied(run), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, in one pass; other rows as they were."""
    found = find_windows(docs, benchmark, keep_text=True)
    words, hit = (F.col(f"`{c}`") for c in found.columns[len(docs.columns) :][:2])
    return found.where(~is_contaminated(hit, words)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH items AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT *, least({WINDOW}, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
rows AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM rows, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item_id FROM places JOIN windows USING (k, g)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
owned AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  cast(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM rows LEFT JOIN covered c USING (r) LEFT JOIN owned o USING (r)
"""
