"""Exact top-k by inner product, pruned by segment means and deviations.

Split two vectors into segments of s components: by Cauchy and Schwarz their
inner product is at most the sum over segments of s (mean mean' + dev dev').
For vectors of fixed lengths this is the familiar lower bound of the distance
between segment means and deviations, |x-y|^2 = |x|^2 + |y|^2 - 2xy. The bound
tightens with every halving of the segments. Vectors are first turned by an
orthonormal transform (the axes of a sample, strongest first), which changes no
inner product and gathers what they vary by in few segments.

Blocks of queries meet chunks of candidates tile by tile. A tile's bounds are
tested coarse to fine against each query's k-th best score known so far; queries
and candidates without a survivor leave, and what is left is scored by one
matrix product of the integers. A level that keeps nearly all costs more than it
saves, so a task passes over it after some tiles; that changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, stored, table, written

K = 10
SCALE = 1024
#: Bytes of candidates (as longs) that a task holds, and of queries that it reads at a time.
CHUNK_BYTES, BLOCK_BYTES = 32 << 20, 8 << 20
#: Queries and candidates of one tile at most; its matrices have 8 bytes for each pair.
TILE = 1024
#: Candidates of each length whose exact scores set the first thresholds, and that say how to turn vectors.
SEEDS = 1024
#: After TRIED tiles, a level that leaves more than this share of the work is passed over.
TRIED, USEFUL = 8, 0.8
#: Lengths whose seeds are drawn by their own number of vectors; rarer lengths by that of all vectors.
LENGTHS = 256
#: Axes by whose signs vectors are ordered.
AXES = 12
#: Pairs that are scored by themselves at a time.
PAIRS = 1 << 15
#: Scoring a pair by itself costs so many times its share of a matrix product.
ALONE = 8
#: Up to this, sums of products of doubles are exact integers.
EXACT = 1 << 53


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part.

    Vectors that are null, or hold null, NaN or infinite components, and rows
    without an id are left out.
    """
    x = F.col(f"`{embedding}`")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double"))).alias("v"))


def segments(v: np.ndarray, size: int) -> np.ndarray:
    """sqrt(size) times the mean and the deviation of each segment, side by side."""
    n, d = v.shape
    pad = -d % size
    x = np.concatenate([v, np.zeros((n, pad))], axis=1).reshape(n, -1, size)
    mean = x.mean(axis=2)
    dev = np.sqrt(np.maximum((x * x).mean(axis=2) - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(size)


def levels(d: int) -> list[int]:
    """Segment sizes from coarse to fine; at 2 only the order inside a pair is not known."""
    out = [s for s in (64, 16, 8, 4, 2) if s <= d]
    return out if d >= 4 else []


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes (columns) of a sample, those along which it is longest first."""
    if not sample.size:
        return np.eye(sample.shape[1])
    x = sample.astype(float)
    _, turned = np.linalg.eigh(x.T @ x)
    return turned[:, ::-1]


class Side:
    """Some vectors of one length: their ids, integers, and statistics of each level, made when asked for."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, v: np.ndarray, turn: np.ndarray):
        turned = v.astype(float) @ turn
        # vectors on the same side of the strongest axes stand together, so that whole parts of a tile can leave
        self.order = np.lexsort((turned[:, :AXES] > 0).T[::-1]) if turned.shape[1] else np.arange(len(v))
        self.row, self.ids, self.v, self.turned = row[self.order], ids[self.order], v[self.order], turned[self.order]
        self.x = self.v.astype(float)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.most = float(np.abs(self.x).max(initial=0))
        self.made: dict[int, np.ndarray] = {}

    def stats(self, size: int) -> np.ndarray:
        if size not in self.made:
            self.made[size] = segments(self.turned, size)
        return self.made[size]


class Search:
    """Scores tiles; counts the pairs that each level has seen and left, and those that were scored."""

    def __init__(self, d: int, k: int):
        self.d, self.k = d, k
        self.seen = {size: (0, 0, 0) for size in levels(d)}  # tiles, pairs, what was left to score
        self.pairs = self.scored = 0

    def _pays(self, size: int) -> bool:
        tiles, pairs, kept = self.seen[size]
        return tiles < TRIED or kept <= USEFUL * pairs

    def tile(self, q: Side, c: Side, at: slice, to: slice, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the pairs in a tile that reach their query's floor.

        Of one query's pairs only the ``k`` best are given, ties by candidate.
        """
        rows, cols = np.arange(at.start, at.stop), np.arange(to.start, to.stop)
        self.pairs += len(rows) * len(cols)
        alive = None
        for size in levels(self.d):
            if not len(rows) or not len(cols):
                break
            if not self._pays(size):
                continue
            bound = q.stats(size)[rows] @ c.stats(size)[cols].T
            # rounding is relative to the lengths of the vectors
            bound += 1e-9 * (1 + q.norm[rows, None]) * (1 + c.norm[None, cols]) + 1e-3
            before, alive = bound.size, bound >= floor[rows, None]
            some, others = alive.any(axis=1), alive.any(axis=0)
            rows, cols, alive = rows[some], cols[others], alive[some][:, others]
            cost = min(ALONE * int(alive.sum()), alive.size)
            tiles, pairs, kept = self.seen[size]
            self.seen[size] = tiles + 1, pairs + before, kept + cost
        if not len(rows) or not len(cols):
            return (np.empty(0, np.int64),) * 3
        if alive is not None and ALONE * int(alive.sum()) < alive.size:
            a, b = np.nonzero(alive)
            score = np.concatenate([np.einsum("ij,ij->i", q.v[rows[a[i : i + PAIRS]]], c.v[cols[b[i : i + PAIRS]]]) for i in range(0, len(a), PAIRS)] or [np.empty(0, np.int64)])
            self.scored += len(a)
            hit = (score >= floor[rows[a]]) & (q.row[rows[a]] != c.row[cols[b]])
            a, b, score = a[hit], b[hit], score[hit]
        else:
            self.scored += len(rows) * len(cols)
            exact = self.d * q.most * c.most < EXACT
            score = (q.x[rows] @ c.x[cols].T).astype(np.int64) if exact else q.v[rows] @ c.v[cols].T
            a, b = np.nonzero((score >= floor[rows, None]) & (q.row[rows, None] != c.row[None, cols]))
            score = score[a, b]
        keep = self._best(a, score, c.ids[cols[b]])
        return rows[a[keep]], cols[b[keep]], score[keep]

    def _best(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions of the ``k`` best of each query, best first, ties by id."""
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        return order[rank < self.k]

    def best(self, q: Side, c: Side, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score): the ``k`` best of ``c`` for each of ``q`` at or above ``floor``, which it raises.

        All three, and the result's numbers, follow the order that the sides have put their rows in.
        """
        query, cand, score = (np.empty(0, np.int64) for _ in range(3))
        out = []
        for top in range(0, len(q.ids), TILE):
            at = slice(top, min(top + TILE, len(q.ids)))
            query, cand, score = (np.empty(0, np.int64) for _ in range(3))
            for left in range(0, len(c.ids), TILE):
                made = self.tile(q, c, at, slice(left, min(left + TILE, len(c.ids))), floor)
                if not len(made[0]):
                    continue
                query, cand, score = (np.concatenate(x) for x in zip((query, cand, score), made))
                keep = self._best(query, score, c.ids[cand])
                query, cand, score = query[keep], cand[keep], score[keep]
                count = np.bincount(query, minlength=len(q.ids))
                last = np.cumsum(count) - 1  # rows are in order of query, each query's best first
                full = np.flatnonzero(count >= self.k)
                floor[full] = np.maximum(floor[full], score[last[full]])
            out.append((query, cand, score))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (query, cand, score)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("d").to_numpy()
    for d in np.unique(lengths):
        yield int(d), batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))


class Seeds:
    """The seeds of each length, read once in a task, and the turn that they give."""

    def __init__(self, path: str):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in stored(path, SEEDS):
            for d, part in _by_length(batch):
                held.setdefault(d, []).append(part)
        self.sides: dict[int, tuple[Side, np.ndarray]] = {}
        for d, parts in held.items():
            t = pa.Table.from_batches(parts).sort_by("row").combine_chunks()
            v = _matrix(t.column("v").combine_chunks(), d)
            turn = axes(v)
            self.sides[d] = Side(t.column("row").to_numpy(), t.column("vec_id").to_numpy(), v, turn), turn

    def turn(self, d: int) -> np.ndarray:
        return self.sides[d][1] if d in self.sides else np.eye(d)


def _side(batch: pa.RecordBatch, d: int, turn: np.ndarray) -> Side:
    return Side(batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), d), turn)


def drawn(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, row, d, v) of which about twice SEEDS of each length are left.

    Rows stay by a hash, so this is a filter in the scan: no vector is moved.
    The rate of a length is that of its number of rows, counted for the LENGTHS
    most frequent; others, if there are more, share the rate of the whole.
    """
    n = rows.groupBy("d").count().orderBy(F.col("count").desc(), "d").limit(LENGTHS).collect()
    if not n:
        return rows
    rest = rows.count() if len(n) == LENGTHS else sum(r["count"] for r in n)
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r in n for x in (r["d"], r["count"])]), F.col("d")), F.lit(rest))
    return rows.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 32)) * many <= F.lit(2 * SEEDS << 32))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each of ``queries``.

    Both have (vec_id, v) as ``integers`` gives them, and ``queries`` is a
    condition on the rows of ``vectors``, or a table of its own. Every row but
    the query's own is a candidate: rows that share a vec_id are rows like any
    others, each a candidate of the other, and each query row has its own list.
    Ties go to the smaller vec_id. Only candidates of the query's own length
    compare. Fewer than ``k`` candidates: all of them. Sums of products must
    fit a long. Empty tables give no rows.

    Queries are staged in the shared folder in blocks; each task holds a chunk
    of candidates and reads the blocks one after another, so neither side ever
    is on the driver, and all vectors are read once.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select("vec_id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")), "topk-vectors")
    if isinstance(queries, DataFrame):  # no row of ``vectors`` is one of these
        asked = queries.select("vec_id", "v", F.size("v").alias("d"), (-1 - F.monotonically_increasing_id()).alias("row"))
    else:
        asked = rows.where(queries)
    mixed = Window.partitionBy("d").orderBy(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 32)), "row")
    seeds = written(drawn(rows).withColumn("r", F.row_number().over(mixed)).where(F.col("r") <= SEEDS).drop("r"), "topk-seeds")

    def first(batches):
        """Queries with the k-th best score among the seeds, or the least long."""
        known = Seeds(seeds)
        for batch in batches:
            for d, part in _by_length(batch):
                floor = np.full(part.num_rows, -np.inf)
                if d in known.sides:
                    side, turn = known.sides[d]
                    q, own = _side(part, d, turn), floor.copy()
                    Search(d, k).best(q, side, own)
                    floor[q.order] = own
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor)], names=[*part.schema.names, "floor"])

    blocks = written(asked.mapInArrow(first, "vec_id long, v array<long>, d int, row long, floor double"), "topk-queries")

    def run(batches):
        known = Seeds(seeds)

        def solve(held: list[pa.RecordBatch]):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            sides = {d: (_side(part, d, known.turn(d)), Search(d, k)) for b in whole for d, part in _by_length(b)}
            widest = max(sides)
            for block in stored(blocks, max(1, BLOCK_BYTES // (8 * max(widest, 1)))):
                for d, part in _by_length(block):
                    if d not in sides:
                        continue
                    (side, search), q = sides[d], _side(part, d, known.turn(d))
                    query, cand, score = search.best(q, side, part.column("floor").to_numpy()[q.order])
                    if len(query):
                        yield pa.RecordBatch.from_arrays([pa.array(q.row[query]), pa.array(q.ids[query]), pa.array(side.ids[cand]), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += 8 * len(batch.column("v").flatten()) + 8 * batch.num_rows
            if size >= CHUNK_BYTES:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    found = rows.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    # each chunk kept its best k of a query; the best k of those are left
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every row whose vec_id is divisible by 100."""
    return top_k(integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
