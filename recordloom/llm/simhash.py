"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints of unrelated texts lie about 32 bits apart, give or take 4, so a
vantage-point tree over all 64 bits can prune almost nothing at a search radius
of 4 (a median split is crossed by three searches in four). The trees are
therefore rooted in projections: of six blocks of bits, two fingerprints that
differ in at most four bits agree on two blocks or more. In such a projection
the search radius is 0 and the triangle bound leaves one branch, the shell at
distance 0 from the projected point. Below these roots the trees measure whole
fingerprints: a crowded branch is cut into shells of distance from two vantage
points, each fingerprint goes to every shard that its ball of radius 2 touches
(two fingerprints within 4 have a point within 2 of both, so they meet in the
shard of that point), and in a shard only fingerprints within the triangle
bound of a vantage point are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, grown, staged, table, text_key, text_slices
from .components import EDGES, connected

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Sizes of the six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A branch with more fingerprints than this is cut into shells.
CROWD = 4096
#: In shards up to this size all are compared by position; larger ones are searched by distance.
SMALL = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's runs of ``width`` words, in order; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), "<u8", n)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; 0 where it has no words."""
    return fingerprint(shingles(text, width))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 where there are none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = hashes[at : at + 65536]
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long in ``name``."""
    kept = [c for c in docs.columns if c != text]
    schema = grown(docs.select(*[F.col(f"`{c}`") for c in kept]).schema, (name, "long"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                fps = np.array([simhash(t) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(fps)], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def masks(blocks: tuple[int, ...] = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of the projections: pairs within ``radius`` agree under one of them."""
    if sum(blocks) != 64 or len(blocks) <= radius:
        raise ValueError("blocks must cover 64 bits and outnumber the radius")
    at, parts = 0, []
    for size in blocks:
        parts.append(((1 << size) - 1) << at)
        at += size
    out = [sum(c) for c in combinations(parts, len(blocks) - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _ham(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def search(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Edges that connect all pairs of distinct ``fps`` within ``radius``, as (n, 2).

    Points are ordered by distance from a vantage point. A breadth-first walk
    compares each reached point only with unreached points whose distance from
    the vantage point differs by at most ``radius``; others are ruled out by
    the triangle inequality. Reached points leave, so a dense group takes few
    comparisons and gives one edge for each point.
    """
    d = _ham(fps, fps[0])
    order = np.argsort(d, kind="stable")
    fps, d = fps[order], d[order].astype(np.int16)
    rest, rest_d, out = fps, d, []
    while len(rest) > 1:
        queue = [(rest[0], rest_d[0])]
        rest, rest_d = rest[1:], rest_d[1:]
        while queue and len(rest):
            x, dx = queue.pop()
            lo, hi = np.searchsorted(rest_d, [dx - radius, dx + radius + 1])
            near = _ham(rest[lo:hi], x) <= radius
            if near.any():
                hit = np.flatnonzero(near) + lo
                out.append(np.stack([rest[hit], np.full(len(hit), x)], axis=1))
                queue += zip(rest[hit], rest_d[hit])
                stay = np.ones(len(rest), bool)
                stay[hit] = False
                rest, rest_d = rest[stay], rest_d[stay]
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _shards(batches):
    """Search each shard (a run of rows with one key) of a sorted partition."""

    def solve(key: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        shard = np.repeat(np.arange(len(starts)), sizes)
        few = (sizes <= SMALL)[shard]
        out = []
        for lag in range(1, SMALL):
            at = np.flatnonzero((shard[lag:] == shard[:-lag]) & few[lag:])
            if not len(at):
                break
            at = at[_ham(fp[at], fp[at + lag]) <= RADIUS]
            out.append(np.stack([fp[at], fp[at + lag]], axis=1))
        out += [search(np.unique(fp[starts[i] : starts[i] + sizes[i]])) for i in np.flatnonzero(sizes > SMALL)]
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    keys, fps, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        keys.append(np.stack(cols[:3], axis=1))
        fps.append(cols[3])
        n += batch.num_rows
        if n < 1 << 18:
            continue
        key, fp = np.concatenate(keys), np.concatenate(fps)
        last = np.flatnonzero((key[:-1] != key[-1]).any(axis=1))
        whole = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
        if whole:
            yield solve(key[:whole], fp[:whole])
        keys, fps, n = [key[whole:]], [fp[whole:]], len(fp) - whole
    if n:
        yield solve(np.concatenate(keys), np.concatenate(fps))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (fp long) within RADIUS bits.

    Not every pair within RADIUS is an edge, but the two ends of every such
    pair are connected by edges.
    """
    roots = F.posexplode(F.array(*[F.lit(m) for m in masks()])).alias("p", "m")
    seen = fps.select("fp", roots).select(F.col("p").cast("long"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    mixed = F.xxhash64("fp")
    crowded = seen.groupBy("p", "k").agg(F.count("*").alias("n"), F.min_by("fp", mixed).alias("v1"), F.max_by("fp", mixed).alias("v2"))
    crowded = staged(crowded.where(F.col("n") > crowd).select("p", "k", "v1", "v2"), "simhash-crowded")

    def touched(v: str):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col(v)))
        lo, hi = (F.floor((d + F.lit(s)) / F.lit(RADIUS + 1)) for s in (-(RADIUS // 2), RADIUS // 2))
        return F.when(F.col(v).isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(lo, hi))

    shards = (
        seen.join(crowded, ["p", "k"], "left")
        .withColumn("s", F.explode(touched("v1")))
        .withColumn("t", F.explode(touched("v2")))
        .select("p", "k", (F.col("s") * 100 + F.col("t")).alias("s"), "fp")
    )
    return shards.repartition("p", "k", "s").sortWithinPartitions("p", "k", "s").mapInArrow(_shards, EDGES)


def _groups(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, fp) of ``docs``, and labels (fp, root, rep) of fingerprints.

    rep is the first document of a fingerprint: known ids before null ones,
    then by id, then by a hash of the text.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(f"`{text}`").alias("text"))
    rows = staged(add_fingerprint(rows), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    reps = staged(rows.groupBy("fp").agg(first), "simhash-reps")
    roots = connected(links(reps.select("fp")), "simhash-components")
    labels = reps.join(roots, reps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    return rows, staged(labels, "simhash-labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts have no words: fingerprint zero, linked like others.
    Rows with a null doc_id take part; component_id is null only for a
    component without any id. Repeated rows give repeated result rows. Further
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows, labels = _groups(docs, doc_id, text)
    lowest = labels.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    by_fp = labels.join(lowest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups=_groups) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they were.

    ``groups`` says what is near: fingerprints within RADIUS bits, or another rule.

    The row with the smallest doc_id stays, one without id only where its group
    has no id; among equal ids, that with the lowest hash of its text; of rows
    that repeat both, any one.
    """
    rows, labels = groups(docs, doc_id, text)
    keep = staged(labels.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.key"), "simhash-keep")
    mine = bare("key", docs.columns)
    keyed = docs.withColumn(mine, text_key(text))

    def by(other: DataFrame):
        return keyed[f"`{doc_id}`"].cast("long").eqNullSafe(other["doc_id"]) & (keyed[mine] == other["key"])

    kept = keyed.join(keep, by(keep), "left_semi")
    twice = staged(rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "simhash-twice")
    if not twice.isEmpty():
        once = kept.join(twice, by(twice), "left_anti")
        kept = once.union(kept.join(twice, by(twice), "left_semi").dropDuplicates([doc_id, mine]))
    return kept.drop(mine)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
