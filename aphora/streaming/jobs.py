"""Streams over event files and log files, written to Parquet.

A run reads what has arrived since its checkpoint and stops (``availableNow``), unless a trigger keeps it running. Windows and sessions appear
once the watermark has passed their end; later events than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from aphora.plans.logs import parse_logs, split_malformed
from aphora.session import ROCKSDB
from aphora.streaming import generations

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state off the Java heap, unless the session already chose a provider."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)


def as_glob(path: str) -> str:
    """The path as a pattern that matches only itself: a file stream takes a single file only as a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None,
                 at: str = "ts") -> DataFrame:
    """Event files as a stream. A watermark needs a zoned time, so the time column is cast."""
    use_rocksdb(spark)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def _run(writer: DataStreamWriter, trigger: dict | None) -> StreamingQuery:
    """Start; without a trigger, read what has arrived and wait for the end. With one the stream runs on."""
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def run_append(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write what is new as Parquet; the file sink's log makes restarts exactly-once.

    ``trigger`` holds the arguments of a trigger, such as ``{"processingTime": "10 seconds"}``.
    """
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _run(writer.outputMode("append"), trigger)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
                trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch to a function. It must be safe to repeat: a batch can come twice after a failure."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return _run(writer, trigger)


def ingest_events(stream: DataFrame, out: str, checkpoint: str, at: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Append events below one folder per day."""
    return run_append(stream.withColumn("dt", F.to_date(at)), out, checkpoint, ["dt"], trigger)


def ingest_logs(lines: DataFrame, out: str, quarantine: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parse log lines; malformed ones go to the quarantine.

    Each batch writes its own folder and overwrites it when repeated, so no line is stored twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_logs(batch).persist()  # read and parsed once for both writes
        good, bad = split_malformed(parsed)
        good.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        parsed.unpersist()

    return run_batches(lines, write, checkpoint, trigger=trigger)


def consume_once(stream: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each event once; copies are recognised within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def rate_windows(stream: DataFrame, key: str, at: str = "ts", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events per key and window."""
    counted = stream.withWatermark(at, delay).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def over_rate(stream: DataFrame, key: str, limit: int = 100, at: str = "ts", width: str = "1 minute",
              delay: str = "10 minutes") -> DataFrame:
    """Windows in which a key exceeded the rate."""
    return rate_windows(stream, key, at, width, delay).where(F.col("n") > limit)


def attempt_windows(stream: DataFrame, key: str, threshold: int = 5, at: str = "ts", width: str = "15 minutes",
                    slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a key reached the threshold."""
    window = F.window(at, width, slide).alias("w")
    counted = stream.withWatermark(at, delay).groupBy(key, window).agg(F.count("*").alias("attempts"))
    reached = counted.where(F.col("attempts") >= threshold)
    return reached.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts")


def metric_rollup(stream: DataFrame, name: str, value: str, at: str = "ts", width: str = "1 hour",
                  delay: str = "10 minutes") -> DataFrame:
    """Minimum, maximum, mean and number of values per metric and window."""
    exact = F.col(value).cast("decimal(15,4)")
    rolled = stream.withWatermark(at, delay).groupBy(F.col(name).alias("metric_name"), F.window(at, width).alias("w")).agg(
        F.min(exact).alias("min_value"), F.max(exact).alias("max_value"), F.sum(exact).alias("_sum"), F.count(exact).alias("n"),
    )
    return rolled.select("metric_name", F.col("w.start").alias("bucket_start"), "min_value", "max_value",
                         (F.col("_sum").cast("double") / F.col("n")).alias("avg_value"), "n")


def session_windows(stream: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of activity separated by idle gaps. In a session with the recommended settings the events of a key are merged
    to sessions before the shuffle too."""
    grouped = stream.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w"))
    counted = grouped.agg(F.count("*").alias("events"), F.max(at).alias("last_event"))
    return counted.select(key, F.col("w.start").alias("session_start"), "last_event", "events")


def _counter_schema(spark: SparkSession, stream: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*keys).schema.fields) + ", n bigint"


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by("n", "_last").alias("n"))


def run_counters(stream: DataFrame, keys: list[str], out: str, checkpoint: str, trigger: dict | None = None,
                 fanout: int = generations.FANOUT) -> StreamingQuery:
    """Live counts: every batch writes the counters it changed.

    The folders of earlier batches are merged into one snapshot whenever there are more than ``fanout``.
    """
    schema = _counter_schema(stream.sparkSession, stream, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        generations.write_batch(batch, out, batch_id)
        generations.compact(batch.sparkSession, out, schema, batch_id, lambda rows: _newest(rows, keys), fanout)

    return run_batches(stream.groupBy(*keys).agg(F.count("*").alias("n")), write, checkpoint, "update", trigger)


def current_counters(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """The newest value of every counter, from the last snapshot and the batches after it. ``schema`` is that of the keys."""
    return _newest(generations.read(spark, out, f"{schema}, n bigint"), keys)
