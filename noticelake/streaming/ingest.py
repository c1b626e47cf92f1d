"""Incremental ingestion with Structured Streaming.

Batches go through the same transformations as tables do.  Sinks and state are
keyed by the batch, so a batch that runs again after a failure replaces what it
wrote: together with the checkpoint each row arrives once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticelake.operators import incremental as I
from noticelake.sources.state import SeenIds, Watermark
from noticelake.store import written

#: How often a polled source is read.
POLL = "30 seconds"


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", per_batch: int | None = None, **options: str) -> DataFrame:
    """New files of a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None) -> StreamingQuery:
    """Starts a stream that hands its batches to ``each``: all there is, or with ``poll`` again and again."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def ingest_unseen(stream: DataFrame, state_path: str, sink_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, id_col: str = "data_id", poll: str | None = None) -> StreamingQuery:
    """Writes rows with ids that no earlier batch had to ``sink_path/batch_id=<n>``, then remembers the ids.

    Ids are remembered for good, as long as the state is kept, as a table that every batch reads;
    :func:`noticelake.streaming.keyed.ingest_unseen_keyed` reads those of the batch alone.  A batch is all
    or nothing: its state is written after its data.  What is new is decided once
    and written, so that data and state agree whatever the source does.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = SeenIds(spark, state_path)
        fresh = I.unseen(batch, seen.get(before_batch=batch_id).withColumnRenamed("data_id", id_col), id_col)
        held = written(fresh, "fresh")
        transform(held).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        seen.add(held.select(F.col(id_col).alias("data_id")).distinct(), batch_id)

    return start(stream, each, checkpoint, poll)


def ingest_above(stream: DataFrame, state_path: str, sink_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, id_col: str = "id", default: int = 0, poll: str | None = None) -> StreamingQuery:
    """Writes rows with ids above the mark that held when their batch began, then advances it.

    The mark is stored beside each batch's data, so that a batch that runs again
    compares with the mark it met at first.  Ids at or below it are late and
    dropped.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        mark = Watermark(spark, state_path, default)
        before = [v for v in mark.folder.versions() if v < batch_id]
        stored = mark.folder.read(before[-1:], "last_id long").agg(F.max("last_id")).first()[0]
        stored = default if stored is None else stored
        fresh = written(I.above_watermark(batch, id_col, stored), "fresh")
        transform(fresh).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        mark.folder.write(I.advanced(fresh, id_col, stored), batch_id)
        mark.folder.drop([v for v in mark.folder.versions() if v < batch_id - 1])

    return start(stream, each, checkpoint, poll)


def digests(stream: DataFrame, ts_col: str = "ts", every: str = "1 day", late: str = "2 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by window of event time, late rows up to a bound; for daily or weekly digests."""
    return stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, every), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def is_quiet(minute: Column | str, start: Column | str, end: Column | str) -> Column:
    """Whether a minute of the day lies in quiet hours, which may wrap around midnight."""
    m, a, b = (F.col(c) if isinstance(c, str) else c for c in (minute, start, end))
    return F.when(a <= b, (m >= a) & (m < b)).otherwise((m >= a) | (m < b))
