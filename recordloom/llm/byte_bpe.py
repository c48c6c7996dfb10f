"""Byte-level BPE: pre-tokens by a scan of transition functions, cached merging.

The pre-tokeniser knows the pattern ``PATTERN`` of public_tokenizers as a finite
machine. Each code point gets a class; each class is a function from the state
before it to the state after it. Composing functions is associative, so blocks
are composed side by side, their products are scanned, and the state before
every code point follows without any regular expression.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grown, table, text_slices, tidied

#: The pattern that the machine stands for; another one is refused.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_multi_50k.tiktoken"

# Classes of code points. The last of a run of white space before other text
# stands alone (GAP) or, if it is U+0020, opens the next token (LEAD).
LETTER, NUMBER, OTHER, LEAD, GAP, BLANK, SHORT, LONG, BREAK = range(9)
# States: inside a run of letters, numbers, others; after a LEAD; inside white
# space; one or two letters before a contraction's end; closed.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, LED, IN_BLANK, ONE_MORE, TWO_MORE, CLOSED = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and opens[class, state]: whether a token starts there."""
    step, opens = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for s in range(8):
        for c, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            step[c, s], opens[c, s] = run, s not in (run, LED)
        for c, then in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            inside = s in (IN_OTHERS, LED)
            step[c, s], opens[c, s] = IN_OTHERS if inside else then, not inside
        step[LEAD, s], opens[LEAD, s] = LED, True
        step[GAP, s], opens[GAP, s] = CLOSED, True
        step[BLANK, s], opens[BLANK, s] = IN_BLANK, s != IN_BLANK
        step[BREAK, s], opens[BREAK, s] = CLOSED, True
    for s, then in ((ONE_MORE, CLOSED), (TWO_MORE, ONE_MORE)):  # letters, by the apostrophe's class
        step[LETTER, s], opens[LETTER, s] = then, False
    return step, opens


STEP, OPENS = _machine()


@cache
def code_points() -> np.ndarray:
    """Class of each code point by itself: LETTER, NUMBER, OTHER or BLANK; BREAK for one beyond Unicode."""
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[c] = BLANK
    out[0x110000] = BREAK
    return out


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point beside those that follow it; 0x110000 ends a text."""
    out = code_points()[points]
    after = np.append(points[1:], 0x110000)
    last = (out == BLANK) & (np.append(out[1:], BREAK) < LEAD)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        beyond = np.append(after[1:], 0x110000)
        one, two = after[at], beyond[at]
        r, v, e, ell = (ord(c) for c in "rvel")
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        out[at[(np.isin(one, [r, v]) & (two == e)) | ((one == ell) & (two == ell))]] = LONG
    out[last] = np.where(points[last] == 0x20, LEAD, GAP)
    return out


def states(kinds: np.ndarray, step: np.ndarray = STEP, block: int = 64, start: int = CLOSED) -> np.ndarray:
    """The state before each element, by a blocked scan of composed functions."""
    n, width = len(kinds), step.shape[1]
    if n <= block:
        out, s = np.empty(n, np.uint8), start
        for i, k in enumerate(kinds.tolist()):
            out[i] = s
            s = step[k, s]
        return out
    flat = step.ravel()
    pad = -n % block
    rows = np.concatenate([kinds, np.zeros(pad, np.uint8)]).reshape(-1, block).T.astype(np.intp) * width
    made = np.broadcast_to(np.arange(width, dtype=np.uint8), (rows.shape[1], width))
    for row in rows:
        made = flat[row[:, None] + made]
    before = _scan(made, start)
    out = np.empty((block, rows.shape[1]), np.uint8)
    for i, row in enumerate(rows):
        out[i] = before
        before = flat[row + before]
    return out.T.ravel()[:n]


def _scan(made: np.ndarray, start: int) -> np.ndarray:
    """The state before each of a row of functions (n x states)."""
    n = len(made)
    if n <= 64:
        out, s = np.empty(n, np.uint8), start
        for i in range(n):
            out[i] = s
            s = made[i, s]
        return out
    half = np.concatenate([made, np.arange(made.shape[1], dtype=np.uint8)[None]]) if n % 2 else made
    pairs = np.take_along_axis(half[1::2], half[0::2].astype(np.intp), axis=1)
    before = _scan(pairs, start)
    out = np.empty(len(half), np.uint8)
    out[0::2] = before
    out[1::2] = half[np.arange(0, len(half), 2), before]
    return out[:n]


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of ``texts`` in order, and how many each text has."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    broken = np.insert(points, ends, 0x110000)
    kinds = classes(broken)
    opens = OPENS.ravel()[kinds.astype(np.intp) * 8 + states(kinds)]
    opens &= kinds != BREAK
    at = np.flatnonzero(opens)
    breaks = ends + np.arange(len(ends))
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], breaks])))
    starts = at - np.searchsorted(breaks, at)  # positions without the breaks
    stops = np.append(starts[1:], len(points))
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())], counts


class Codec:
    """Encodes and decodes with a rank file; caches the merges of short pre-tokens."""

    CACHED = 200_000
    SHORT_PIECE = 64
    #: Pairs of tokens whose merge is remembered.
    PAIRS = 250_000
    NEVER = 1 << 62

    def __init__(self, path: str, pattern: str = PATTERN):
        if pattern != PATTERN:
            raise ValueError("the pre-tokeniser stands for another pattern")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        top = max(self.ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.decimal = [str(i) for i in range(top)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.bytes = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The token that two neighbours make, NEVER if none."""
        key = a << 32 | b
        made = self.pairs.get(key)
        if made is None:
            if len(self.pairs) > self.PAIRS:
                self.pairs.clear()
            made = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], self.NEVER)
        return made

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        """As ``merge``, for few bytes: the next merge is found by looking through all."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self.bytes[b] for b in piece]
        pair = self.pair
        made = [pair(a, b) for a, b in zip(ids, ids[1:])]
        while made:
            low = min(made)
            if low == self.NEVER:
                break
            i = made.index(low)
            ids[i] = low
            del ids[i + 1], made[i]
            if i < len(made):
                made[i] = pair(low, ids[i + 1])
            if i:
                made[i - 1] = pair(ids[i - 1], low)
        return tuple(ids)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the lowest-ranked neighbours merge first, the leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, ranks = len(piece), self.ranks
        ends, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n:
                continue
            j = ends[i]
            if ranks.get(piece[i : ends[j]]) != r:  # one side has grown since
                continue
            alive[j], ends[i] = False, ends[j]
            if ends[i] < n:
                left[ends[i]] = i
                if (q := ranks.get(piece[i : ends[ends[i]]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (k := left[i]) >= 0 and (q := ranks.get(piece[k : ends[i]])) is not None:
                heapq.heappush(heap, (q, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        pieces, counts = pretokens(texts)
        kinds = set(pieces)
        if len(self.cache) > self.CACHED:  # what this slice needs stays
            self.cache = {p: self.cache[p] for p in kinds.intersection(self.cache)}
        known, own = self.cache, {}
        for piece in kinds.difference(known):
            if len(piece) <= self.SHORT_PIECE:
                known[piece] = self.merge_short(piece.encode("utf-8", "surrogatepass"))
            else:
                own[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
        found = [known.get(p) or own[p] for p in pieces] if own else [known[p] for p in pieces]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = np.concatenate([[0], np.cumsum(n)])
        return np.split(ids, total[np.cumsum(counts)[:-1]]) if len(texts) else []

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte of the text at which each token starts."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])[:-1].astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker and rank file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS, ids: bool = True, offsets: bool = False, digests: bool = False) -> DataFrame:
    """``docs`` without its text, with the tokens of each whole text.

    New columns: n_tokens long; ids array<int>; offsets array<long> (byte at
    which each token starts); ids_sha256 and decoded_sha256 (of the ids joined
    by commas, and of the bytes that the ids decode to). A taken name gets a
    leading underscore. ``ranks`` names a file of public_tokenizers, found on
    the machine that runs the task. Null counts as empty, which has no tokens.
    Repeated rows are encoded alike; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    wanted = [("n_tokens", "long", pa.int64(), True), ("ids", "array<int>", pa.list_(pa.int32()), ids), ("offsets", "array<long>", pa.list_(pa.int64()), offsets)]
    wanted += [("ids_sha256", "string", pa.string(), digests), ("decoded_sha256", "string", pa.string(), digests)]
    wanted = [w for w in wanted if w[3]]
    schema = grown(schema, *((name, kind) for name, kind, _, _ in wanted))

    def run(batches):
        coder = codec(public_tokenizers.path(ranks))
        for batch in batches:
            for part in text_slices(batch, text):
                made: dict[str, list] = {w[0]: [] for w in wanted}
                for found in coder.encode([t or "" for t in part.column(text).to_pylist()]):
                    made["n_tokens"].append(len(found))
                    if ids:
                        made["ids"].append(found)
                    if offsets:
                        made["offsets"].append(coder.offsets(found))
                    if digests:
                        plain = found.tolist()
                        made["ids_sha256"].append(hashlib.sha256(",".join([coder.decimal[i] for i in plain]).encode()).hexdigest())
                        made["decoded_sha256"].append(hashlib.sha256(coder.decode(plain)).hexdigest())
                cols = [*(part.column(c) for c in kept), *(pa.array(made[w[0]], w[2]) for w in wanted)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, ids: str = "ids", ranks: str = RANKS, name: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for in ``name``; null ids give null."""
    schema = grown(rows.schema, (name, "string"))

    def run(batches):
        coder = codec(public_tokenizers.path(ranks))
        for batch in batches:
            out = [None if x is None else coder.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ids=False, digests=True)
