"""Queries that run a stream or a sink over the supplied tables and read back what was written.

Output and checkpoints go below the shared folder of the session, a new folder for every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora import schemas
from aphora.plans import logs, search
from aphora.queries.events import BREAKER_FOLD
from aphora.queries.registry import query
from aphora.session import shared_dir
from aphora.sources import sinks, tables
from aphora.sources.model import Model
from aphora.streaming import breaker, jobs, late, once


def _stream(m: Model) -> DataFrame:
    return jobs.event_stream(m.spark, jobs.as_glob(f"{m.folder}/events.parquet"), schemas.INPUT_TABLES["events"])


def _run(m: Model, stream: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    root = shared_dir(m.spark, name)
    jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint", partition_by)
    return m.spark.read.schema(stream.schema).parquet(f"{root}/out")


def _local(*names: str) -> list:
    """Zoned times back to times without zone."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


# Windows and sessions are complete once the watermark, ten minutes behind the newest event, has passed them.
_WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES FROM ev)"


@query("stream_ingest", "SELECT event_id, ts, user_id, event_type, CAST(CAST(ts AS DATE) AS STRING) AS dt FROM ev")
def stream_ingest(m: Model) -> DataFrame:
    root = shared_dir(m.spark, "ingest")
    jobs.ingest_events(_stream(m), f"{root}/out", f"{root}/checkpoint")
    stored = m.spark.read.schema(f"{schemas.INPUT_TABLES['events']}, dt date".replace("timestamp_ntz", "timestamp")).parquet(f"{root}/out")
    return stored.select("event_id", *_local("ts"), "user_id", "event_type", F.col("dt").cast("string").alias("dt"))


@query("stream_dedupe", "SELECT DISTINCT event_id, event_type, ts FROM webhook_events")
def stream_dedupe(m: Model) -> DataFrame:
    once = _stream(m).select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), "event_type", "ts")
    events = once.unionByName(once.where(F.col("event_type") == "purchase"))
    return _run(m, jobs.consume_once(events, ["event_id", "event_type"]), "dedupe").select("event_id", "event_type", *_local("ts"))


_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


@query("stream_once", "SELECT event_id, event_type, ts FROM ev")
def stream_once(m: Model) -> DataFrame:
    """Copies of purchases arrive again, in one case after everything else and far behind any watermark."""
    copies = m.ev.where(F.col("event_type") == "purchase")
    root = shared_dir(m.spark, "once")
    for rows in (m.ev.unionByName(copies), copies):
        rows.select("event_id", "ts", "user_id", "event_type").write.mode("append").parquet(f"{root}/events")
        stream = jobs.event_stream(m.spark, f"{root}/events", _EVENT)
        once.consume_ever_once(stream, ["event_id", "event_type"], f"{root}/out", f"{root}/history", f"{root}/checkpoint")
    found = once.consumed(m.spark, f"{root}/out", _EVENT.replace("timestamp_ntz", "timestamp"))
    return found.select("event_id", "event_type", *_local("ts"))


# Every seventh event arrives after the others; those more than ten minutes behind the newest of these are late.
@query("stream_late", """
  SELECT event_id, ts, event_type, event_id % 7 = 3 AND ts < (SELECT max(ts) FROM ev WHERE event_id % 7 <> 3) - INTERVAL 10 MINUTES AS late FROM ev""")
def stream_late(m: Model) -> DataFrame:
    """Late events in a table of their own, next to those in time."""
    behind = F.col("event_id") % 7 == 3
    root, schema = shared_dir(m.spark, "late"), _EVENT.replace("timestamp_ntz", "timestamp")
    folder = f"{root}/events"
    for rows in (m.ev.where(~behind), m.ev.where(behind)):
        rows.select("event_id", "ts", "user_id", "event_type").write.mode("append").parquet(folder)
        late.split_late(jobs.event_stream(m.spark, folder, _EVENT), f"{root}/out", f"{root}/quarantine", f"{root}/marks", f"{root}/checkpoint")
    good = late.events_in(m.spark, f"{root}/out", schema).withColumn("late", F.lit(False))
    bad = late.events_in(m.spark, f"{root}/quarantine", f"{schema}, watermark timestamp").drop("watermark").withColumn("late", F.lit(True))
    return good.unionByName(bad).select("event_id", *_local("ts"), "event_type", "late")


@query("stream_rate", f"""
  SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
    count(*) AS n FROM ev GROUP BY user_id, time_bucket(INTERVAL 1 MINUTE, ts)
  HAVING count(*) > 1 AND time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= {_WATERMARK}""")
def stream_rate(m: Model) -> DataFrame:
    found = _run(m, jobs.over_rate(_stream(m), "user_id", limit=1), "rate")
    return found.select("user_id", *_local("window_start", "window_end"), "n")


@query("stream_attempts", f"""
  SELECT user_id, window_start, window_start + INTERVAL 15 MINUTES AS window_end, count(*) AS attempts FROM (
    SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 14 MINUTES, time_bucket(INTERVAL 1 MINUTE, ts),
      INTERVAL 1 MINUTE)) AS window_start FROM ev) x
  WHERE window_start + INTERVAL 15 MINUTES <= {_WATERMARK} GROUP BY user_id, window_start HAVING count(*) >= 2""")
def stream_attempts(m: Model) -> DataFrame:
    found = _run(m, jobs.attempt_windows(_stream(m), "user_id", threshold=2), "attempts")
    return found.select("user_id", *_local("window_start", "window_end"), "attempts")


@query("stream_metrics", f"""
  SELECT event_type AS metric_name, date_trunc('hour', ts) AS bucket_start, min(CAST(value AS DECIMAL(15,4)))::DOUBLE AS min_value,
    max(CAST(value AS DECIMAL(15,4)))::DOUBLE AS max_value, CAST(sum(CAST(value AS DECIMAL(15,4))) AS DOUBLE) / count(*) AS avg_value,
    count(*) AS n FROM ev GROUP BY event_type, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_WATERMARK}""")
def stream_metrics(m: Model) -> DataFrame:
    rolled = _run(m, jobs.metric_rollup(_stream(m), "event_type", "value"), "metrics")
    return rolled.select("metric_name", *_local("bucket_start"), F.col("min_value").cast("double").alias("min_value"),
                         F.col("max_value").cast("double").alias("max_value"), "avg_value", "n")


@query("stream_sessions", f"""
  SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events FROM (
    SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY ts, event_id) AS session_no
    FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev) x) y
  GROUP BY user_id, session_no HAVING max(ts) + INTERVAL 30 MINUTES <= {_WATERMARK}""")
def stream_sessions(m: Model) -> DataFrame:
    found = _run(m, jobs.session_windows(_stream(m), "user_id"), "sessions")
    return found.select("user_id", *_local("session_start", "last_event"), "events")


@query("stream_counters", "SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY user_id, event_type")
def stream_counters(m: Model) -> DataFrame:
    root = shared_dir(m.spark, "counters")
    jobs.run_counters(_stream(m), ["user_id", "event_type"], f"{root}/out", f"{root}/checkpoint")
    return jobs.current_counters(m.spark, f"{root}/out", ["user_id", "event_type"], "user_id bigint, event_type string")


@query("stream_breaker", f"{BREAKER_FOLD} SELECT endpoint, call_id, ts, allowed, state, failures FROM fold WHERE rn > 0")
def stream_breaker(m: Model) -> DataFrame:
    calls = _stream(m).select(
        F.concat(F.lit("POST-host"), (F.col("user_id") % 5).cast("string")).alias("endpoint"), F.col("event_id").alias("call_id"), "ts",
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"),
    )
    root = shared_dir(m.spark, "breaker")
    breaker.run_breaker(calls, f"{root}/out", f"{root}/state", f"{root}/checkpoint")
    return breaker.breaker_calls(m.spark, f"{root}/out")


def _log_folder(m: Model) -> str:
    folder = f"{shared_dir(m.spark, 'logs')}/lines"
    sinks.bounded_files(m.request_log, folder, rows_per_file=100_000)
    return folder


@query("stream_logs", """
  SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    concat('req-', CAST(event_id AS STRING)) AS request_id, concat('GET /api/', event_type, CASE WHEN k % 7 = 3 THEN ' x=[1] start {"a"' ELSE '' END, ' done') AS message FROM ev""")
def stream_logs(m: Model) -> DataFrame:
    """Log files written with a bounded number of lines, then parsed as a stream."""
    root = shared_dir(m.spark, "logstream")
    jobs.ingest_logs(jobs.log_stream(m.spark, _log_folder(m)), f"{root}/out", f"{root}/quarantine", f"{root}/checkpoint")
    return m.spark.read.parquet(f"{root}/out").select("level", "request_id", "message")


@query("sink_bounded_files", """
  SELECT concat('req-', CAST(event_id AS STRING)) AS request_id, CAST(value AS INT) AS n FROM (
    SELECT event_id, CASE WHEN k % 11 = 5 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS value FROM ev) x""")
def sink_bounded_files(m: Model) -> DataFrame:
    good, _ = logs.split_malformed(logs.parse_logs(tables.log_lines(m.spark, _log_folder(m))))
    return good.select("request_id", F.get_json_object("meta", "$.statusCode").try_cast("int").alias("n"))


@query("sink_append", """
  SELECT user_id, action, details, created_at, CAST(CAST(created_at AS DATE) AS STRING) AS dt FROM (
    SELECT user_id, 'quote_view' AS action, concat('{"quote_id":', CAST(quote_id AS STRING), ',"category":"', category, '"}') AS details,
      created_at FROM views UNION ALL
    SELECT user_id, 'audio:generate', concat('{"voice_id":"', voice_id, '"}'), created_at FROM audio) x""")
def sink_append(m: Model) -> DataFrame:
    """Two appends of audit rows, one folder per day."""
    folder = f"{shared_dir(m.spark, 'audit')}/rows"
    sinks.append_by_day(sinks.audit_rows(m.views, "quote_view", ["quote_id", "category"]), folder)
    sinks.append_by_day(sinks.audit_rows(m.audio, "audio:generate", ["voice_id"]), folder)
    stored = m.spark.read.schema("user_id bigint, action string, details string, created_at timestamp_ntz, dt date").parquet(folder)
    return stored.withColumn("dt", F.col("dt").cast("string"))


@query("sink_export", "SELECT quote_id, text, category, lang, score FROM quotes")
def sink_export(m: Model) -> DataFrame:
    """The catalogue exported as JSON and read again."""
    folder = f"{shared_dir(m.spark, 'export')}/quotes"
    sinks.export(m.quotes.select("quote_id", "text", "category", "lang", "score"), folder, "json")
    return m.spark.read.schema("quote_id bigint, text string, category string, lang string, score int").json(folder)


@query("sink_json_arrays", "SELECT text, category, lang, date_trunc('millisecond', created_at) AS created_at FROM quotes")
def sink_json_arrays(m: Model) -> DataFrame:
    """Quotes kept in commented files of at most a thousand each, read back with their time in milliseconds."""
    folder = f"{shared_dir(m.spark, 'files')}/quotes"
    at = F.unix_millis(F.col("created_at").cast("timestamp")).alias("createdAt")
    sinks.array_files(m.quotes.select("text", "category", "lang", at, "quote_id"), folder, F.floor(F.col("quote_id") / 1000), "quotes, block")
    return tables.generated_quotes(m.spark, folder).select("text", "category", "lang", *_local("created_at"))


@query("sink_categories", "SELECT category AS id, upper(category) AS name, bool_or(premium) AS premium FROM quotes GROUP BY category")
def sink_categories(m: Model) -> DataFrame:
    """The categories in use, kept in one commented file per initial, read back."""
    folder = f"{shared_dir(m.spark, 'files')}/categories"
    used = m.quotes.groupBy(F.col("category").alias("id")).agg(F.upper(F.first("category")).alias("name"), F.max("premium").alias("premium"))
    sinks.array_files(used, folder, F.left("id", F.lit(1)), "categories")
    return tables.category_file(m.spark, folder).select("id", "name", "premium")


@query("sink_generated", "SELECT item_id AS quote_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def sink_generated(m: Model) -> DataFrame:
    """A batch appended to an existing table."""
    folder = f"{shared_dir(m.spark, 'generated')}/quotes"
    sinks.append_generated(folder, m.quotes.select("quote_id", "text"))
    sinks.append_generated(folder, m.raw("benchmark").select(F.col("item_id").alias("quote_id"), "text"))
    return m.spark.read.schema("quote_id bigint, text string").parquet(folder)


@query("stored_index", """
  SELECT quote_id FROM (SELECT quote_id, string_split_regex(lower(concat(text, ' ', author)), '[^\\p{L}\\p{N}]+') AS w FROM quotes) x
  WHERE list_contains(w, 'hand') AND list_contains(w, 'rest')""")
def stored_index(m: Model) -> DataFrame:
    """Search in an index stored by term hash."""
    folder = f"{shared_dir(m.spark, 'index')}/terms"
    search.write_index(search.inverted_index(m.quotes), folder)
    index = m.spark.read.schema("quote_id bigint, term string, bucket int").parquet(folder)
    return search.search_index(index, ["hand", "rest"])
