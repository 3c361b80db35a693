"""Queries about event streams at rest: logs, latency, attempts, sessions, breaker states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.functions import text as t
from aphora.functions.masking import mask_columns, mask_json_deep, mask_json_text
from aphora.operators import filters, health, series
from aphora.plans import logs
from aphora.queries.registry import AS_OF, as_of, query
from aphora.sources.model import Model
from aphora.sources.tables import epoch_ms_to_timestamp

_PARSED = r"""
  SELECT event_id, regexp_extract(value, '^\[([^\]]+)\] \[(\w+)\] (?:\[([^\]]+)\] )?(.*?)(?: (\{"statusCode".*\}))?$',
    ['logged_at', 'level', 'request_id', 'message', 'meta']) AS p FROM request_log"""


@query("parse_logs", f"""
  SELECT CAST(replace(replace(p.logged_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS logged_at, p.level, p.request_id,
    p.message, p.meta FROM ({_PARSED}) x""")
def parse_logs(m: Model) -> DataFrame:
    good, _ = logs.split_malformed(logs.parse_logs(m.request_log))
    return good


@query("malformed_logs", "SELECT count(*) AS malformed FROM documents WHERE NOT regexp_matches(text, '^\\[([^\\]]+)\\] \\[(\\w+)\\] ')")
def malformed_logs(m: Model) -> DataFrame:
    """Texts that are not log lines end up in the quarantine."""
    _, bad = logs.split_malformed(logs.parse_logs(m.raw("documents").select(F.col("text").alias("value"))))
    return bad.agg(F.count("*").alias("malformed"))


@query("format_logs", """
  SELECT event_id, concat('[', strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST((epoch_us(ts) // 1000 % 1000) AS STRING), 3, '0'), 'Z] [',
    upper(event_type), '] ', CASE WHEN k % 3 = 0 THEN '' ELSE concat('[req-', CAST(event_id AS STRING), '] ') END,
    'done', CASE WHEN k % 5 = 0 THEN '' ELSE concat(' {"user":', CAST(user_id AS STRING), ',"token":"********","password":"********","tags":["', event_type, '"]}') END) AS line
  FROM ev""")
def format_logs(m: Model) -> DataFrame:
    request = F.when(F.col("k") % 3 != 0, F.concat(F.lit("req-"), F.col("event_id").cast("string")))
    meta = F.when(F.col("k") % 5 == 0, "{}").otherwise(
        F.to_json(F.struct(
            F.col("user_id").alias("user"), F.struct(F.concat(F.lit("}t"), F.col("k")).alias("v"), F.array(F.array("k")).alias("of")).alias("token"),
            F.array(F.lit("x]"), F.col("event_type")).alias("password"), F.array("event_type").alias("tags")))
    )
    return m.ev.select("event_id", logs.format_line(F.col("ts"), F.col("event_type"), request, F.lit("done"), meta).alias("line"))


@query("mask_secrets", """
  SELECT event_id, concat('{"statusCode":', CASE WHEN k % 11 = 5 THEN '"n/a"' WHEN event_type = 'error' THEN '500' ELSE '200' END,
    ',"responseTime":', CAST(CAST(value AS DECIMAL(15,4)) AS STRING), ',"token":"********"}') AS meta FROM ev""")
def mask_secrets(m: Model) -> DataFrame:
    parsed = logs.parse_logs(m.request_log)
    number = F.regexp_extract("request_id", "([0-9]+)", 1).cast("bigint")
    return parsed.select(number.alias("event_id"), mask_json_text(F.col("meta")).alias("meta"))


_DEEP = 20


@query("mask_spelt_keys", f"""
  SELECT event_id, concat('{{"id":', CAST(event_id AS STRING), ',"pass\\u0077ord" : "********","list":[{{"\\u0041pi\\u004BEY":"********","note":"\\"token\\":1"}}],',
    '"CREDIT\\u005fcard":"********","tokens":"t', CAST(k AS STRING), '","my\\"secret":{{"a":[]}}}}') AS meta FROM ev""")
def mask_spelt_keys(m: Model) -> DataFrame:
    """Sensitive keys written with escapes and in any case, above values of twenty levels."""
    nested = "".join(['[{"a":"]}\\\\","b":' for _ in range(_DEEP // 2)]) + "1" + "}]" * (_DEEP // 2)
    meta = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"pass\\u0077ord" : "p\\"'), F.col("k").cast("string"),
        F.lit('","list":[{"\\u0041pi\\u004BEY":' + nested + ',"note":"\\"token\\":1"}],"CREDIT\\u005fcard":{"n":' + nested + '},"tokens":"t'),
        F.col("k").cast("string"), F.lit('","my\\"secret":{"a":[]}}'))
    return m.ev.select("event_id", mask_json_text(meta).alias("meta"))


def _nested(m: Model) -> DataFrame:
    secret = F.concat(F.lit("p"), F.col("k").cast("string"))
    device = F.struct(F.col("event_type").alias("kind"), secret.alias("token"))
    user = F.struct(F.col("user_id").alias("id"), secret.alias("password"), secret.alias("apiKey"), F.array(device).alias("devices"))
    return m.ev.select("event_id", F.struct(user.alias("user"), F.create_map(F.lit("secret"), secret).alias("extra")).alias("meta"))


_MASKED = """
  SELECT event_id, concat('{"user":{"id":', CAST(user_id AS STRING), ',"password":"********","apiKey":"', {key},
    '","devices":[{{"kind":"', event_type, '","token":"********"}}]}},"extra":{{"secret":"********"}}}}') AS meta FROM ev"""
_MASKED = _MASKED.replace("{{", "{").replace("}}", "}")


@query("mask_struct", _MASKED.replace("{key}", "'********'"))
def mask_struct(m: Model) -> DataFrame:
    return mask_columns(_nested(m), ["meta"]).select("event_id", F.to_json("meta").alias("meta"))


@query("mask_struct_parity", _MASKED.replace("{key}", "concat('p', CAST(k AS STRING))"))
def mask_struct_parity(m: Model) -> DataFrame:
    return mask_columns(_nested(m), ["meta"], parity=True).select("event_id", F.to_json("meta").alias("meta"))


@query("mask_json_deep", _MASKED.replace("{key}", "'********'"))
def mask_deep(m: Model) -> DataFrame:
    hide = mask_json_deep()
    return _nested(m).select("event_id", hide(F.to_json("meta")).alias("meta"))


_LATENCY = """count(*) AS requests, CAST(sum(ms) AS DOUBLE) / count(*) AS mean_ms, quantile_cont(CAST(ms AS DOUBLE), 0.5) AS p50_ms,
    quantile_cont(CAST(ms AS DOUBLE), 0.95) AS p95_ms, CAST(max(ms) AS DOUBLE) AS max_ms"""


@query("route_latency", f"""
  SELECT 'GET' AS method, concat('/api/', event_type) AS url, status, {_LATENCY}
  FROM (SELECT event_type, CASE WHEN k % 11 = 5 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    CAST(value AS DECIMAL(15,4)) AS ms FROM ev) x GROUP BY event_type, status""")
def route_latency(m: Model) -> DataFrame:
    return logs.route_latency(logs.parse_logs(m.request_log))


@query("request_pairs", """
  SELECT concat('req-', CAST(event_id AS STRING)) AS request_id, 'GET' AS method, concat('/api/', event_type) AS url,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CAST(floor(value) AS DOUBLE) AS response_ms FROM ev""")
def request_pairs(m: Model) -> DataFrame:
    return logs.pair_requests(m.request_events).select("request_id", "method", "url", "status_code", "response_ms")


@query("error_counts", """
  SELECT level, count(*) AS lines FROM (SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END
    AS level FROM ev) x WHERE level <> 'DEBUG' GROUP BY level""")
def error_counts(m: Model) -> DataFrame:
    return logs.level_counts(logs.parse_logs(m.request_log), "info")


@query("error_actions", """
  SELECT action, count(*) AS rows FROM audit WHERE action LIKE '%error' GROUP BY action""")
def error_actions(m: Model) -> DataFrame:
    return logs.error_actions(m.audit)


@query("level_filter", "SELECT id, action FROM audit WHERE action IN ('error')")
def level_filter(m: Model) -> DataFrame:
    """Audit rows as log rows: errors are above the threshold, views below."""
    leveled = m.audit.withColumn("level", F.when(F.col("action") == "error", "error").otherwise("debug"))
    return filters.at_least_level(leveled, "warn").select("id", "action")


@query("json_roundtrip", """
  SELECT id, CASE WHEN json_valid(details) THEN CAST(json(details) AS STRING) ELSE details END AS details FROM (
    SELECT id, CASE WHEN action = 'error' THEN concat(details, '}') ELSE details END AS details FROM audit) x""")
def json_roundtrip(m: Model) -> DataFrame:
    broken = F.when(F.col("action") == "error", F.concat("details", F.lit("}"))).otherwise(F.col("details"))
    return m.audit.select("id", t.json_or_raw(broken).alias("details"))


@query("cache_key", """
  SELECT event_id, concat('recommendations-', CAST(user_id AS STRING), '-', CAST(k AS STRING)) AS cache_key FROM ev""")
def cache_key(m: Model) -> DataFrame:
    return m.ev.select("event_id", t.cache_key(F.lit("recommendations"), "user_id", "k").alias("cache_key"))


@query("envelope", """
  SELECT event_id, CASE WHEN event_type = 'error' THEN concat('{"ok":false,"error":{"message":"failed","code":"', CAST(k AS STRING),
    '","details":{}}}') ELSE concat('{"ok":true,"user":', CAST(user_id AS STRING), ',"kind":"', event_type, '"}') END AS response FROM ev""")
def envelope(m: Model) -> DataFrame:
    good = t.ok_envelope(user=F.col("user_id"), kind=F.col("event_type"))
    bad = t.error_envelope(F.lit("failed"), F.col("k").cast("string"))
    return m.ev.select("event_id", F.when(F.col("event_type") == "error", bad).otherwise(good).alias("response"))


@query("epoch_to_ts", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM ev")
def epoch_to_ts(m: Model) -> DataFrame:
    """Back from epoch milliseconds to a time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return m.ev.select("event_id", epoch_ms_to_timestamp(ms).cast("timestamp_ntz").alias("at"))


@query("limit_param", """
  SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN k = 0 THEN 5 ELSE k END WHEN 'purchase' THEN CASE WHEN k = 0 THEN 5 ELSE k END
    WHEN 'signup' THEN CASE WHEN k = 0 THEN 5 ELSE -k END ELSE 5 END AS row_limit FROM ev""")
def limit_param(m: Model) -> DataFrame:
    k = F.col("k").cast("string")
    raw = (F.when(F.col("event_type") == "click", k).when(F.col("event_type") == "purchase", F.concat(F.lit(" "), k, F.lit("px")))
           .when(F.col("event_type") == "signup", F.concat(F.lit("-"), k)).when(F.col("event_type") == "error", F.lit("abc")))
    return m.ev.select("event_id", t.limit_param(raw).alias("row_limit"))


@query("backoff_schedule", """
  SELECT event_id, a AS attempt, least(300.0::DOUBLE * pow(2, a), 10000) AS wait_ms, 400.0::DOUBLE * pow(2, a) AS plain_ms
  FROM (SELECT event_id, CAST(k % 8 AS INT) AS a FROM ev) x""")
def backoff_schedule(m: Model) -> DataFrame:
    attempt = (F.col("k") % 8).cast("int")
    return m.ev.select("event_id", attempt.alias("attempt"), t.backoff_ms(attempt).alias("wait_ms"),
                       t.doubling_backoff_ms(attempt).alias("plain_ms"))


@query("backoff_bounds", """
  SELECT k, min(wait_low) AS wait_low, max(wait_high) AS wait_high FROM (SELECT k,
    round(300 * pow(1.6, k % 4), 3) AS wait_low, round(300 * pow(2.4, k % 4), 3) AS wait_high FROM ev) x GROUP BY k""")
def backoff_bounds(m: Model) -> DataFrame:
    attempt = F.col("k") % 4
    low, high = F.round(t.backoff_ms(attempt, jitter=0.8), 3), F.round(t.backoff_ms(attempt, jitter=1.2), 3)
    return m.ev.select("k", low.alias("wait_low"), high.alias("wait_high")).groupBy("k").agg(
        F.min("wait_low").alias("wait_low"), F.max("wait_high").alias("wait_high")
    )


@query("brute_force", """
  SELECT user_id, event_id, ts, attempts FROM (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS attempts FROM ev) x WHERE attempts >= 2""")
def brute_force(m: Model) -> DataFrame:
    return series.brute_force(m.ev, "user_id", "ts", "event_id", threshold=2)


@query("rolling_attempts", """
  SELECT event_type, event_id, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts
    RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS attempts FROM ev""")
def rolling_attempts(m: Model) -> DataFrame:
    """Rolling counts for five very hot keys."""
    return series.rolling_counts(m.ev, "event_type", "ts", "event_id")


@query("rate_limit", """
  SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
    count(*) AS n FROM ev GROUP BY user_id, time_bucket(INTERVAL 1 MINUTE, ts) HAVING count(*) > 1""")
def rate_limit(m: Model) -> DataFrame:
    return series.over_rate(m.ev, "user_id", "ts", limit=1)


@query("sessions_gap", """
  SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events FROM (
    SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY ts, event_id) AS session_no
    FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev) x) y
  GROUP BY user_id, session_no""")
def sessions_gap(m: Model) -> DataFrame:
    return series.activity_sessions(m.ev, "user_id", "ts")


BREAKER_FOLD = """
  WITH RECURSIVE calls AS MATERIALIZED (SELECT endpoint, call_id, ts, outcome = 'failure' AS failed,
      row_number() OVER (PARTITION BY endpoint ORDER BY ts, call_id) AS rn FROM call_log),
    fold AS (
      SELECT DISTINCT endpoint, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS TIMESTAMP) AS ts,
        true AS allowed, 'closed' AS state, 0 AS failures, CAST(NULL AS TIMESTAMP) AS last_failure FROM calls
      UNION ALL
      SELECT endpoint, rn, call_id, ts, state <> 'open', CASE WHEN state = 'open' THEN 'open'
          WHEN failed AND failures >= 4 THEN 'open' WHEN NOT failed AND state = 'half-open' THEN 'closed' ELSE state END,
        CASE WHEN state = 'open' THEN failures WHEN failed THEN failures + 1 WHEN state = 'half-open' THEN 0 ELSE failures END,
        CASE WHEN state <> 'open' AND failed THEN ts ELSE last_failure END
      FROM (SELECT c.endpoint, c.rn, c.call_id, c.ts, c.failed, f.last_failure,
          CASE WHEN f.state = 'open' AND c.ts > f.last_failure + INTERVAL 30 SECONDS THEN 'half-open' ELSE f.state END AS state,
          CASE WHEN f.state = 'open' AND c.ts > f.last_failure + INTERVAL 30 SECONDS THEN 0 ELSE f.failures END AS failures
        FROM fold f JOIN calls c ON c.endpoint = f.endpoint AND c.rn = f.rn + 1) step)
"""


@query("breaker_fold", f"{BREAKER_FOLD} SELECT endpoint, call_id, ts, allowed, state, failures FROM fold WHERE rn > 0")
def breaker_fold(m: Model) -> DataFrame:
    return health.breaker_states(m.call_log)


@query("breaker_status", f"""{BREAKER_FOLD} SELECT endpoint, last(state ORDER BY rn) AS state, last(failures ORDER BY rn) AS failures,
    max(last_failure) AS last_failure, epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(max(last_failure)) // 1000 AS ms_since_last_failure
  FROM fold GROUP BY endpoint""")
def breaker_status(m: Model) -> DataFrame:
    return health.breaker_status(m.call_log, as_of())
