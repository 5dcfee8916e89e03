"""Recurring ingestion as Structured Streaming: new entries, deduplicated against a record table, delivered, recorded.

Delivery is at least once: an entry is recorded after its delivery returned 200, failures come again with the next poll.
A batch that runs again records nothing twice, because the record table is read at the start of every batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gleanery.operators.feeds import new_downloads
from gleanery.sources.readers import read_record, write_record

Deliver = Callable[[DataFrame], DataFrame]
RECORD = "torrent_name string, torrent_url string, part int"
PARTS = 256  # of the record table, by the address's hash; a poll reads only those that its entries fall into


def part_of(address: Column) -> Column:
    return F.when(address.isNotNull(), F.pmod(F.xxhash64(address), F.lit(PARTS)).cast("int"))


class PollErrors(StreamingQueryListener):
    """Keeps the errors that ended polls, and the number of polls that went well; a failing poll ends its own query only."""

    def __init__(self) -> None:
        self.errors: list[str] = []
        self.polls = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.polls += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)


def delivered(rows: DataFrame) -> DataFrame:
    """A delivery that always succeeds."""
    return rows.withColumn("status", F.lit(200))


def record_batch(batch: DataFrame, record_path: str, order: str, deliver: Deliver = delivered) -> None:
    parts = batch.select(part_of(F.col("torrent_url")).alias("part")).distinct().filter("part is not null")
    touched = [r[0] for r in parts.collect()]  # at most PARTS
    record = read_record(batch.sparkSession, record_path, RECORD).filter(F.col("part").isin(touched))
    new = new_downloads(batch, record, "torrent_url", order)
    sent = deliver(new).persist()
    done = sent.filter("status = 200").select("torrent_name", "torrent_url", part_of(F.col("torrent_url")).alias("part"))
    write_record(done, record_path, "part")
    sent.unpersist()


def poll(entries: DataFrame, record_path: str, checkpoint: str, order: str, deliver: Deliver = delivered, interval: str | None = None):
    """Start the poll: once over all that is there, or every `interval` (`1 hour`)."""
    writer = entries.writeStream.foreachBatch(lambda batch, _: record_batch(batch, record_path, order, deliver)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, at: str, kind: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and kind of a stream, late rows up to `late`."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, length), kind).agg(F.count("*").alias("n"))
