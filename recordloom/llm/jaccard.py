"""Near-duplicates by the Jaccard similarity of their word shingles.

Documents with equal shingle sets are one. The others meet where SimHash links
their fingerprints, and in buckets of MinHash bands, as sets of similarity 0.8
mostly lie farther apart than SimHash's radius: two such sets share none of the
40 bands of six minima in one case of 190,000, more similar sets more rarely.
Both only say who may be alike: each connected group of them is read again, and its sets
are compared whole, by exact counts of common shingles. A group that is more
than one task should hold is taken apart into cells (``_cells``), so that any
two of its sets that share a bucket and may be alike in size meet in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, split_join, staged, text_key, text_slices, tidied
from .components import EDGES, connected
from .simhash import SEED, fingerprint, links, shingles

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
ALIKE = (4, 5)
BANDS, ROWS = 40, 6
#: Shingles whose minima are taken at a time.
STEP = 4096
#: What a block of sets weighs: its shingles, and so much for each set. A cell has two blocks.
HELD, EACH = 1 << 19, 1024
#: Sets whose sizes are so far apart are never alike: a bit over 5/4.
APART = 1.26

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's runs of WIDTH words; of a shorter text all its words are one."""
    return np.unique(shingles(text, WIDTH))


def bands(own: np.ndarray) -> np.ndarray:
    """The bucket of each band; none where there are no shingles."""
    if not len(own):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), STEP):
        low = np.minimum(low, (own[at : at + STEP, None] * _FACTORS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def alike(names: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Edges (n, 2) that connect all pairs of ``sets`` with a similarity of ALIKE or more.

    A walk from set to set: each reached one is compared with those not reached
    yet whose size allows the similarity, and the ones found leave.
    """
    up, down = ALIKE
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    rest, out = np.arange(len(order)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            n = sizes[x]
            lo, hi = np.searchsorted(sizes[rest], [-(-up * n // down), down * n // up + 1])
            own = sets[order[x]]
            common = np.array([np.isin(sets[order[y]], own, assume_unique=True).sum() for y in rest[lo:hi]], np.int64)
            hit = lo + np.flatnonzero(down * common >= up * (n + sizes[rest[lo:hi]] - common))
            out += [(names[order[y]], names[order[x]]) for y in rest[hit]]
            queue += rest[hit].tolist()
            rest = np.delete(rest, hit)
    return np.array(out, np.int64).reshape(-1, 2)


def _signed(batches):
    """Adds the digest, the size and the fingerprint of a text's shingle set, and its buckets."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            cols = [part.column("doc_id"), part.column("key"), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "fp", "size", "print", "bands"])


def _compared(batches):
    """Edges of each group (a run of rows with one group) of a sorted partition."""
    group, held = None, {}

    def solve():
        edges = alike(np.array(list(held), np.int64), list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        for part in text_slices(batch, "text"):
            for own, fp, text in zip(*(part.column(c).to_pylist() for c in ("group", "fp", "text"))):
                if own != group and held:
                    yield solve()
                    held = {}
                group = own
                if fp not in held:
                    held[fp] = shingle_set(text)
    if held:
        yield solve()


def _linked(reps: DataFrame) -> DataFrame:
    """(fp, bucket): the bucket of each set (fp, size, print) that isn't empty, the same for all whose fingerprints SimHash links."""
    sets = reps.where("size > 0")
    roots = connected(links(sets.select(F.col("print").alias("fp")).distinct()), "jaccard-prints")
    bucket = F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("bucket")
    return staged(sets.join(roots, sets["print"] == roots.node, "left").select("fp", bucket), "jaccard-linked")


def _blocks(units: DataFrame) -> DataFrame:
    """(fp, group): the cells of each unit of ``units`` (unit, fp, size).

    A unit is cut by size, so that sets alike are in one class or in
    neighbouring ones, and each class into blocks of about HELD by a hash.
    Every two blocks of one class or of neighbours are a cell.
    """
    units = staged(units.withColumn("class", F.floor(F.log("size") / F.lit(float(np.log(APART))))), "jaccard-units")
    load = F.sum(F.col("size") + F.lit(EACH))
    # the classes of a unit are as many as powers of APART up to the longest text's length
    by = Window.partitionBy("unit").orderBy("class")
    classes = units.groupBy("unit", "class").agg(F.count("*").alias("n"), load.alias("load"), F.ceil(load / F.lit(HELD)).alias("own"))
    whole = F.sum("load").over(Window.partitionBy("unit")) <= F.lit(HELD)

    def beside(at, step: int) -> Column:
        return F.when(at("class", 1).over(by) == F.col("class") + F.lit(step), at("own", 1).over(by)).otherwise(F.lit(0))

    classes = classes.select("unit", "class", "n", "own", whole.alias("whole"), beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    classes = staged(classes, "jaccard-classes")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), "own")

    def cells(n: str, cell) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1), cell)).otherwise(F.array().cast("array<long>"))

    one = F.col("class")
    inside = F.filter(cells("own", lambda j: F.when((j != mine) | (F.col("own") == 1), F.xxhash64("unit", one, F.least(j, mine), one, F.greatest(j, mine)))), lambda c: c.isNotNull())
    below = cells("below", lambda j: F.xxhash64("unit", one - 1, j, one, mine))
    above = cells("above", lambda j: F.xxhash64("unit", one, mine, one + 1, j))
    parts = F.when(F.col("whole"), F.array("unit")).otherwise(F.concat(inside, below, above))
    return split_join(units, classes, ["unit", "class"], "n").select("fp", F.explode(parts).alias("group"))


def _cells(sets: DataFrame, rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, group) for sets (group, fp, size): what is compared whole in one task.

    Groups up to HELD stay as they are. Of a larger one each bucket is a unit,
    or, where its buckets have more pairs than the group itself (copies of
    one text share most of them), the whole is; units are cut into blocks.
    """
    load = staged(sets.groupBy("group").agg(F.count("*").alias("n"), F.count("*").alias("sets"), F.sum(F.col("size") + F.lit(EACH)).alias("load")), "jaccard-load")
    if load.where(F.col("load") > HELD).isEmpty():
        return sets.select("fp", "group")
    sets = staged(split_join(sets, load, ["group"], "n"), "jaccard-sets")
    big = sets.where(F.col("load") > HELD).select("group", "fp", "size", "sets")
    own = rows.groupBy("fp").agg(F.first("bands").alias("bands")).join(big, "fp").join(linked, "fp")
    own = staged(own.select("group", "fp", "size", "sets", F.explode(F.concat("bands", F.array("bucket"))).alias("bucket")), "jaccard-crowded")
    # buckets of the same sets are one
    held = own.groupBy("group", "sets", "bucket").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y"))
    held = staged(held.where("n > 1").groupBy("group", "sets", "n", "x", "y").agg(F.min("bucket").alias("bucket")), "jaccard-held")
    pairs = F.sum(F.col("n").cast("double") * F.col("n"))
    cut = staged(held.groupBy("group", "sets").agg(pairs.alias("pairs")), "jaccard-cut")
    fewer = F.col("pairs") < F.col("sets").cast("double") * F.col("sets")
    entire = split_join(big.drop("sets"), cut.where(~fewer).select("group", F.col("sets").alias("n")), ["group"], "n", semi=True)
    apart = held.join(cut.where(fewer).select("group"), "group", "left_semi").select("group", "bucket", "n")
    parts = split_join(own.drop("sets"), apart, ["group", "bucket"], "n", semi=True)
    units = entire.select(F.xxhash64("group").alias("unit"), "fp", "size").union(parts.select(F.xxhash64("group", "bucket"), "fp", "size"))
    return sets.where(F.col("load") <= HELD).select("fp", "group").union(_blocks(units))


def groups(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, fp) of ``docs``, and labels (fp, root, rep) of shingle sets.

    rep is the first document of a set, chosen as by SimHash. Null and empty
    texts have the empty set, which is like no other.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(f"`{text}`").alias("text"))
    rows = staged(texts.mapInArrow(tidied(_signed), grown(texts.drop("text").schema, ("fp", "long"), ("size", "long"), ("print", "long"), ("bands", "array<long>"))), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    reps = staged(rows.groupBy("fp").agg(first, F.max("size").alias("size"), F.max("print").alias("print")), "jaccard-reps")
    linked = _linked(reps)
    seen = rows.select("fp", F.explode("bands").alias("bucket")).union(linked)
    shared = seen.groupBy("bucket").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
    meet = seen.join(shared, "bucket").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    maybe = connected(meet, "jaccard-buckets")
    maybe = maybe.union(maybe.select("root", "root").distinct())  # a root has no row of its own
    # what may be alike is read again: one text for each set
    sets = staged(reps.join(maybe, reps.fp == maybe.node).select(F.col("root").alias("group"), "fp", "size"), "jaccard-maybe")
    need = _cells(sets, rows, linked).join(reps, "fp").select(F.col("rep.doc_id").alias("id"), F.col("rep.key").alias("k"), "fp", "group")
    again = texts.join(need, texts["doc_id"].eqNullSafe(need["id"]) & (texts["key"] == need["k"])).select("group", "fp", "text")
    edges = again.repartition("group").sortWithinPartitions("group").mapInArrow(tidied(_compared), EDGES)
    roots = connected(edges, "jaccard-components")
    labels = reps.join(roots, reps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    return rows.select("doc_id", "key", "fp"), staged(labels, "jaccard-labels")
