"""Late events as data: a stream that keeps what a watermark would drop.

Every batch leaves the newest event time seen so far in a table of its own. The next one takes its watermark from there, the
delay behind that time, and deals its events: those in time, and those whose window (or whose own time) the watermark
has passed, with the watermark they missed. Both tables are overwritten when a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aphora.streaming import generations
from aphora.streaming.jobs import run_batches

_NEWEST = "newest timestamp"


def _newest(spark: SparkSession, marks: str, batch_id: int) -> DataFrame:
    return generations.read(spark, marks, _NEWEST, before=batch_id, after=batch_id - 2).drop("_last")


def watermark(spark: SparkSession, marks: str, batch_id: int, delay: str) -> Column:
    """The watermark a batch starts with, one number from the batch before; null before the first event."""
    reached = _newest(spark, marks, batch_id).agg(F.max(F.unix_micros(F.col("newest") - F.expr(f"INTERVAL {delay}"))).alias("at"))
    return F.timestamp_micros(F.lit(reached.first()["at"]).cast("bigint"))


def split_late(stream: DataFrame, out: str, quarantine: str, marks: str, checkpoint: str, at: str = "ts", delay: str = "10 minutes",
               closes: Column | None = None, trigger: dict | None = None, fanout: int = generations.FANOUT) -> StreamingQuery:
    """Write the events in time to ``out`` and the late ones, with ``watermark``, to ``quarantine``.

    ``closes`` is the time after which an event is of no use any more, such as the end of its window; the event's own time
    if not given. Events without a time are late, too.
    """
    limit = F.col(at) if closes is None else closes
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = watermark(spark, marks, batch_id, delay)
        late = F.col(at).isNull() | F.coalesce(limit < reached, F.lit(False))
        generations.write_batch(batch.where(~late), out, batch_id)
        generations.write_batch(batch.where(late).withColumn("watermark", reached), quarantine, batch_id)
        newest = batch.agg(F.max(at).alias("newest")).unionByName(_newest(spark, marks, batch_id))
        generations.write_batch(newest.agg(F.max("newest").alias("newest")), marks, batch_id)
        generations.forget(spark, marks, batch_id - 1)
        for folder, kept in ((out, schema), (quarantine, f"{schema}, watermark timestamp")):
            generations.compact(spark, folder, kept, batch_id, lambda rows: rows.drop("_last"), fanout, whole=False)

    return run_batches(stream, write, checkpoint, trigger=trigger)


def events_in(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return generations.read(spark, folder, schema).drop("_last")
