"""Continuous intake: new files and corrections as streams (an extension of the batch plans)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).load(folder)


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a batch plan on each new part and append its rows as Parquet; a repeated part replaces itself."""

    def part(rows: DataFrame, number: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{target}/part={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window, late ones dropped after ``late``."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class LatestReview(StatefulProcessor):
    """Keeps the last review of each file: the latest in time, of equal times the highest id.

    A review that comes late, after one that is newer, changes nothing; what
    the file's state becomes is given out whenever it changes.
    """

    STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("review_id", T.LongType()), T.StructField("status", T.StringType())])

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", self.STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        known = tuple(self.state.get()) if self.state.exists() else None
        last = max(((r.at, r.review_id, r.status) for r in rows if r.at is not None), key=lambda r: r[:2], default=None)
        if last and (known is None or last[:2] > known[:2]):
            self.state.update(last)
            yield Row(file_name=key[0], at=last[0], review_id=last[1], status=last[2])

    def close(self) -> None:
        pass


def latest_reviews(reviews: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of reviews (file_name, reviewed_at, review_id, status) as the stream of each file's last one.

    State is a row for each file, kept in the key's partition; ``keep_ms``
    forgets files that were quiet for so long. Needs a state store with column
    families (``state_store``).
    """
    out = "file_name " + reviews.schema["file_name"].dataType.simpleString() + ", at long, review_id long, status string"
    rows = reviews.select("file_name", F.unix_micros("reviewed_at").alias("at"), "review_id", "status")
    last = rows.groupBy("file_name").transformWithState(LatestReview(keep_ms), out, "Update", "ProcessingTime" if keep_ms else "None")
    return last.select("file_name", F.timestamp_micros("at").alias("reviewed_at"), "review_id", "status")


class state_store:
    """While a query is started under this, its state goes to RocksDB; the session's own setting comes back after."""

    KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, self.STORE)

    def __exit__(self, *error) -> None:
        self.conf.set(self.KEY, self.before) if self.before else self.conf.unset(self.KEY)
