"""The decision log as a stream (T1, T2): files that arrive are folded into a change table, one published version a micro-batch.

The order key of this fold is the place in the log, so no watermark applies: a late event is simply an older place, and the
conditional upsert ignores it. A repeat of an event, in whatever batch, keeps the event's first place, as the table keeps every
event once; so any batching and any order of the batches give the same state, and so does a batch retried after a crash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.changefeed import ChangeTable, decision_feed
from cairn.session import filesystem

DECISIONS = "seq bigint, op string, ts string, assertion string, action string, via string, reason string, received_at timestamp_ntz"


def start(spark: SparkSession, source: str, root: str, checkpoint: str, by_instant: bool = False, once: bool = False, seconds: int = 2) -> StreamingQuery:
    """Follow a folder of Parquet files (T3: polled every two seconds); ``once`` drains what is there and stops."""
    target = ChangeTable(spark, root, by_place=not by_instant)
    reader = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 4 if once else 1000)
    fs, path = filesystem(spark, source)
    if fs.getFileStatus(path).isFile():  # a stream follows a folder
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source)

    def apply(batch: DataFrame, _: int) -> None:
        target.apply(decision_feed(batch), ("reopen",))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per type and window with a bound on lateness; works on a stream and on a batch alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
