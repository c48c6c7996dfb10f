"""Shards of nearly equal bytes by sampled splitters, in built-in functions alone.

Rows are ordered by a digest of their text, then of their id, so equal texts
stand together. A sample weighted by size gives the boundaries of ranges, and
ranges that still hold too many rows (many small texts are light) are cut again
by a sample of their rows. Sizes are summed exactly inside ranges and carried
on by the ranges' totals, so each row knows how many bytes stand before it, and
that number cuts the shards. What the sample decides is who counts what, never
the result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, staged, table

SHARDS = 40
#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Ranges for each shard at least, and rows of a range from which there are more of them.
RANGES, RANGE_ROWS = 8, 1 << 22
#: Sampled rows for each range.
SAMPLES = 32
#: A range with more than so many times the mean number of rows is cut again, in so many rounds at most.
OVERFULL, ROUNDS = 3, 8
#: Equal texts that are together at most 1/WHOLE of a shard aren't parted by a cut.
WHOLE = 64

_KEY = ("k1", "k2", "uid")


def _digest(c: Column) -> Column:
    """60 bits of a text's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _literal(values: list, kind: str) -> Column:
    """A constant array, parsed once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _count_up_to(bounds: list, kind: str, key: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    held = _literal(bounds, kind)
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))


def _uniform(seed: int) -> Column:
    """A number from 0 to below 1 for each row, the same whenever the row is read."""
    return F.pmod(F.xxhash64(F.lit(seed), *_KEY), F.lit(1 << 53)) / F.lit(float(1 << 53))


class Ranges:
    """Boundaries of key ranges, and the exact bytes and rows of each."""

    def __init__(self, rows: DataFrame, total: int, n: int, ranges: int):
        self.rows, self.mean = rows, max(1, -(-n // ranges))
        m = SAMPLES * ranges
        sample = rows.where(_uniform(1) * F.lit(total) < F.col("size") * F.lit(m)).select(*_KEY, F.greatest(F.col("size").cast("double"), F.lit(total / m)).alias("w"))
        self.bounds = sorted(self._quantiles(sample.withColumn("g", F.lit(0)), F.lit(ranges)))
        self.count()
        for k in range(ROUNDS):
            over = [(r, -(-c // self.mean), c) for r, (_, c) in self.sizes.items() if c > OVERFULL * self.mean]
            if not over:
                break
            self.cut(over, seed=2 + k)
            self.count()

    def _quantiles(self, sample: DataFrame, pieces: Column) -> list[list[int]]:
        """First keys of the pieces of equal weight that each group g of a bounded sample falls into."""
        group = Window.partitionBy("g")
        before = F.sum("w").over(group.orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
        cut = sample.select("g", *_KEY, F.floor(before * pieces / F.sum("w").over(group)).alias("j"))
        first = cut.where("j > 0").groupBy("g", "j").agg(F.min(F.struct(*_KEY)).alias("key"))
        return [[r.key[k] for k in _KEY] for r in first.select("key").collect()]

    def number(self) -> Column:
        bounds = [dict(zip(_KEY, b)) for b in self.bounds]
        return _count_up_to(bounds, "struct<k1: long, k2: long, uid: long>", F.struct(*_KEY))

    def count(self) -> None:
        found = self.rows.select(self.number().alias("r"), "size").groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        self.sizes = {x.r: (x.b, x.n) for x in found}

    def cut(self, over: list[tuple[int, int, int]], seed: int) -> None:
        """Cut ranges (number, pieces, rows) by samples of their rows; the list is shorter than that of ranges."""
        held = [{"g": r, "pieces": p, "rate": SAMPLES * p / c} for r, p, c in over]
        wide = self.rows.sparkSession.range(1).select(F.inline(_literal(held, "struct<g: int, pieces: int, rate: double>")))
        sample = self.rows.withColumn("g", self.number()).join(F.broadcast(wide), "g").where(_uniform(seed) < F.col("rate"))
        more = self._quantiles(sample.select("g", *_KEY, "pieces", F.lit(1.0).alias("w")), F.max("pieces").over(Window.partitionBy("g")))
        self.bounds = sorted({tuple(b) for b in self.bounds} | {tuple(b) for b in more})

    def places(self) -> DataFrame:
        """The rows with ``at``, the bytes, and ``i``, the rows that stand before them in the whole order."""
        top = max(self.sizes) + 1
        b, n = [0], [0]
        for r in range(top):
            size, count = self.sizes.get(r, (0, 0))
            b.append(b[-1] + size)
            n.append(n[-1] + count)
        w = Window.partitionBy("r").orderBy(*_KEY)
        rows = self.rows.withColumn("r", self.number())
        run = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        rows = rows.select("*", run.alias("at"), (F.row_number().over(w) - 1).cast("long").alias("i"))
        return rows.withColumn("at", F.col("at") + F.get(_literal(b, "long"), F.col("r"))).withColumn("i", F.col("i") + F.get(_literal(n, "long"), F.col("r"))).drop("r")


def _cuts(placed: DataFrame, total: int, n: int, shards: int) -> list[tuple[int, int]]:
    """For each shard but the first, the bytes and rows that stand before it."""
    even = F.expr(f"(at * {shards}) div {total}L")
    first = placed.groupBy(even.cast("int").alias("s")).agg(F.min("at").alias("at"), F.min("i").alias("i"), F.min_by("k1", "at").alias("k1")).collect()
    found = {r.s: r for r in first}
    keys = sorted({r.k1 for r in first})
    groups = placed.where(F.col("k1").isin(keys)).groupBy("k1").agg(F.min("at").alias("at"), F.min("i").alias("i"), F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    group = {g.k1: g for g in groups}
    cuts, after = [], (total, n)
    for s in reversed(range(1, shards)):
        if s in found:
            r, g = found[s], group[found[s].k1]
            after = (r.at, r.i)
            if g.at < r.at and g.b * shards * WHOLE <= total:
                early = 2 * total * s <= shards * (2 * g.at + g.b)
                after = (g.at, g.i) if early else (g.at + g.b, g.i + g.n)
        cuts.append(after)
    return cuts[::-1]


def sharded(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with size, text_crc32, law, shard, slot and grown_shard.

    A row's size is its text's UTF-8 bytes and ROW_BYTES; ``law`` is bytes: a
    shard holds an equal share of all bytes, give or take one row and 1/WHOLE.
    ``slot`` numbers the rows of a shard from 0 without gaps; grown_shard is
    null, as this law promises nothing about one more shard. Equal texts
    stand together; a group of them that is at most 1/WHOLE of a shard is in one
    shard, a larger one may be cut, as one group may be larger than a shard.

    A null text counts as empty, with checksum 0, and is equal to it. A null id
    is an id like any other. Repeated rows are rows of their own and take one
    place each. A table with fewer rows than shards leaves some shards empty; an
    empty table gives no rows. A very long text is one row, so a shard may be
    larger by its size. Columns of ``docs`` with the names of the new ones keep
    them; the new ones get underscores in front.

    Rows are staged in the shared folder with their keys, so that what is drawn
    and numbered stays the same when an executor is lost. Only boundaries and
    totals of ranges, a number that grows with rows / RANGE_ROWS, reach the driver.
    """
    keep = docs.columns if keep is None else keep
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        (F.octet_length(t).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        _digest(F.col(f"`{text}`")).alias("k1"),
        _digest(F.col(f"`{doc_id}`")).alias("k2"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = staged(rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if n:
        ranges = Ranges(rows, total, n, max(RANGES * shards, -(-n // RANGE_ROWS)))
        rows = staged(ranges.places(), "shard-places")
        cuts = _cuts(rows, total, n, shards)
        shard = _count_up_to([b for b, _ in cuts], "long", F.col("at"))
        starts = [0] + [i for _, i in cuts]
    else:
        rows, shard, starts = rows.withColumns({"at": F.lit(0), "i": F.lit(0)}), F.lit(0), [0]
    new = {"size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit("bytes"), "shard": F.col("_s").cast("int"), "slot": (F.col("i") - F.get(_literal(starts, "long"), F.col("_s"))).cast("long"), "grown_shard": F.lit(None).cast("int")}
    out = rows.withColumn("_s", shard)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[c.alias(bare(name, keep)) for name, c in new.items()])


def write(docs: DataFrame, path: str, shards: int = SHARDS, **names: str) -> None:
    """Write ``docs`` as Parquet under ``path``, one folder shard=N for each shard that has rows."""
    sharded(docs, shards, **names).write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; cases as in ``sharded``."""
    return sharded(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32 (reversed polynomial 0xEDB88320)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8 bytes, byte by byte."""
    held = "[" + ", ".join(map(str, _crc_table())) + "]"
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: cast('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, {held}[1 + (xor(c, b) & 255)]), 4294967295))"


#: The same from all sizes summed in one order.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, strlen(t) + {ROW_BYTES} AS size, t,
  cast('0x' || substr(md5(t), 1, 15) AS BIGINT) AS k1, cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k2 FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) - size AS pos, row_number() OVER (ORDER BY k1, k2) - 1 AS i,
  sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k1) AS b FROM k),
g AS (SELECT *, min(pos) OVER (PARTITION BY k1) AS g, pos * {SHARDS} // total AS s FROM p),
h AS (SELECT *, min(s) OVER (PARTITION BY k1) AS low, max(s) OVER (PARTITION BY k1) AS high FROM g),
c AS (SELECT *, CASE WHEN low = high OR b * {SHARDS} * {WHOLE} > total THEN s
  WHEN 2 * total * high <= {SHARDS} * (2 * g + b) THEN high ELSE low END AS shard FROM h)
SELECT doc_id, cast(size AS BIGINT) AS size, cast({crc_sql('t')} AS BIGINT) AS text_crc32, 'bytes' AS law, cast(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS slot, cast(NULL AS INTEGER) AS grown_shard FROM c
"""
