"""WARC archives: a deterministic sharded writer, and a reader.

Records go in order of page_id (equal ones by payload digest). Running sums of
payload bytes in that order cut the records into shards, so a shard's content
depends on the data alone, not on the cluster. A task writes a shard's records,
one gzip member each, rolls to the next file by compressed size, and commits a
file by renaming it from a temporary name. The manifest, written last, names
the files that count; what a lost task leaves behind is never read, and a task
that runs again writes the same bytes under the same names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged, table, text_slices

#: Least and most payload bytes of a shard; between them, one of SHARDS equal parts.
SHARD_BYTES, SHARD_MOST, SHARDS = 2 << 20, 1 << 30, 4096
#: Compressed size at which a file is rolled.
FILE_BYTES = 256 << 20
#: The date of all records, so that archives of equal data are equal.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without payload."""
    sha = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        *([f"Page-Id: {page_id}"] if page_id is not None else []),
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(text: str) -> str:
    """A header value: characters that would end the line go percent-encoded."""
    return text.replace("%0", "%250").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%250", "%0")


def _packed(raw: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Roll:
    """Writes one shard's records to files of bounded size, each committed by a rename."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.file_bytes, self.number, self.done = shard, file_bytes, 0, []
        self.out = None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.count, self.sha = self.system.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = b"software: recordloom\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._write(_packed(head.encode() + info + b"\r\n\r\n"))
        self._write(_packed(raw))
        self.count += 1
        if self.size >= self.file_bytes:
            self.close()

    def _write(self, packed: bytes) -> None:
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.name, self.count, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


@dataclass
class Cuts:
    """The first key (page_id, digest) of each shard but the first; null ids come first, in order of digest."""

    nulls: np.ndarray
    ids: np.ndarray
    digests: list[str]

    def shards(self, page_id: pd.Series, digest: pd.Series) -> np.ndarray:
        known = page_id.notna().to_numpy()
        ids = page_id.fillna(0).to_numpy(np.int64)
        out = np.searchsorted(self.ids, ids, "left")
        for i in np.flatnonzero(known & (np.searchsorted(self.ids, ids, "right") > out)):
            while out[i] < len(self.ids) and self.ids[out[i]] == ids[i] and self.digests[out[i]] <= digest.iloc[i]:
                out[i] += 1
        own = np.searchsorted(self.nulls, digest.to_numpy(str), "right") if len(self.nulls) else 0
        return np.where(known, out + len(self.nulls), own)


def _cuts(slim: DataFrame, shard_bytes: int | None) -> Cuts:
    """Keys at which shards begin, from running sums in key order.

    The sums run side by side in range partitions; the partitions' totals, a
    row each, put them together. A shard begins where the sum passes a
    multiple of the shard's size, so the keys don't depend on the partitions.
    """
    spark = slim.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("page_id").asc_nulls_first(), F.col("digest")]
    keys = slim.groupBy("page_id", "digest").agg(F.sum("size").alias("size"))
    keys = staged(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "warc-keys")
    totals = keys.groupBy("part").agg(F.sum("size").alias("s"), F.min(F.struct(F.col("page_id").isNotNull().alias("k"), "page_id", "digest")).alias("first"))
    rows = sorted(totals.collect(), key=lambda r: (r["first"]["k"], r["first"]["page_id"] or 0, r["first"]["digest"]))
    whole = sum(r["s"] for r in rows)
    shard_bytes = shard_bytes or max(SHARD_BYTES, min(SHARD_MOST, whole // SHARDS))
    if whole <= shard_bytes:
        return Cuts(np.empty(0, str), np.empty(0, np.int64), [])
    before, at = 0, []
    for r in rows:
        at.append((r["part"], before))
        before += r["s"]
    skips = spark.createDataFrame(at, "part int, skip long")  # one row for each partition
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = keys.join(F.broadcast(skips), "part").withColumn("sum", F.col("skip") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    starts = summed.groupBy(F.floor(F.col("sum") / F.lit(shard_bytes)).alias("shard"))
    starts = starts.agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "digest")).alias("k")).where("shard > 0").select("k.*").collect()
    nulls, ids = sorted(r[2] for r in starts if not r[0]), sorted((r[1], r[2]) for r in starts if r[0])
    return Cuts(np.array(nulls, str), np.array([i for i, _ in ids], np.int64), [d for _, d in ids])


def write(pages: DataFrame, folder: str, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files in ``folder``; gives the manifest.

    The manifest (file, records, bytes, sha256) is also saved in ``folder``.
    A shard has ``shard_bytes`` of payload, or a record that is larger; without
    it one of SHARDS equal parts, but SHARD_BYTES at least and SHARD_MOST at
    most. Inside a shard a file is rolled at ``file_bytes`` of compressed size.
    Of records with equal payloads of at least ``least`` bytes that with the
    smallest page_id is a response, the others refer to it as revisits. A null
    html is an empty payload, a null url has no header. Rows with a null
    page_id come first; they refer to others, but only one another where no
    row with an id has that payload, in which case all are responses. Rows
    that repeat the smallest page_id are responses all. Further columns are
    ignored. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = staged(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-slim")
    first = slim.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    keys = slim.select("page_id", "digest").distinct()
    decided = keys.join(first, "digest", "left").where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    cuts = _cuts(slim, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(cuts.shards(page_id, digest))

    # a decision comes just before the rows that it is for, so one shuffle serves both
    none = F.lit(None)
    decided = decided.select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", F.lit(0).alias("tag"), "first")
    both = decided.unionByName(rows.withColumns({"tag": F.lit(1), "first": none.cast("long")}))
    both = both.withColumn("shard", shard_of("page_id", "digest"))
    # a shard's rows come in order; ties are rows that differ in url alone
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(cuts.nulls) + len(cuts.ids) + 1, 10_000))
    sort = ["shard", F.col("page_id").asc_nulls_first(), "digest", "tag", F.col("url").asc_nulls_first()]
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def run(batches):
        roll, key, refers = None, None, None
        for batch in batches:
            for part in text_slices(batch, "payload"):
                for row in part.to_pylist():
                    if roll is None or roll.shard != row["shard"]:
                        if roll is not None:
                            roll.close()
                            yield from _listed(roll)
                        roll = Roll(folder, row["shard"], file_bytes)
                    if row["tag"] == 0:
                        key, refers = (row["page_id"], row["digest"]), row["first"]
                    else:
                        target = refers if key == (row["page_id"], row["digest"]) else None
                        roll.add(record(row["page_id"], row["url"], row["payload"], target))
        if roll is not None:
            roll.close()
            yield from _listed(roll)

    made = both.repartition(n, "shard").sortWithinPartitions(*sort).mapInArrow(run, _MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest.parquet")
    return spark.read.schema(made.schema).parquet(f"{folder.rstrip('/')}/manifest.parquet")


def _listed(roll: Roll) -> Iterator[pa.RecordBatch]:
    if roll.done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*roll.done)], names=["file", "records", "bytes", "sha256"])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC file, member by member."""
    data, z, held = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        held.append(z.decompress(data))
        data = b""
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
            raw, held = b"".join(held), []
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]
    if any(held):
        raise ValueError("the archive ends inside a record")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest in ``folder`` names, one row each.

    payload_bytes and payload_digest are of the full payload: of what a
    response holds (its headers must agree), of what a revisit's headers say.
    """
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest.parquet").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        if f"sha1:{digest32(block)}" != fields["WARC-Block-Digest"] or (kind == "response" and (digest32(payload), len(payload)) != (told, length)):
                            raise ValueError(f"{name}: a digest differs from its record")
                        page, refers, url = fields.get("Page-Id"), fields.get("Refers-To-Page"), fields.get("WARC-Target-URI")
                        held.append((page and int(page), None if url is None else _unline(url), length, told, kind, refers and int(refers), payload if payloads and kind == "response" else None))
                        size += len(payload)
                        if size > 4 << 20 or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return manifest.repartition(n, "file").mapInArrow(run, _RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back; cases as in ``write`` and ``read``."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same from the table: SHA-1 in hex by DuckDB, twenty bits at a time as four characters of base 32.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
