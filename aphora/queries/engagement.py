"""Queries about engagement reports, table upkeep and referential integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.operators import filters, lifecycle, relations, series
from aphora.plans import reports
from aphora.queries.registry import AS_OF, as_of, query
from aphora.sources import tables
from aphora.sources.model import Model


@query("recent_quote_count", f"""
  SELECT count(*) AS quote_count FROM quotes WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS""")
def recent_quote_count(m: Model) -> DataFrame:
    return reports.recent_quote_count(m.quotes, as_of())


@query("recent_audit", f"""
  SELECT id, user_id, action, details, created_at FROM audit WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS
  ORDER BY created_at DESC, id LIMIT 100""")
def recent_audit(m: Model) -> DataFrame:
    return reports.recent_audit(m.audit, as_of(), 100)


@query("users_by_tier", """
  SELECT subscription_tier, subscription_status, count(*) AS users FROM users GROUP BY ALL""")
def users_by_tier(m: Model) -> DataFrame:
    return reports.users_by_tier(m.users)


@query("quote_metrics_pivot", """
  SELECT quote_id, CAST(sum(CASE WHEN metric_type = 'view' THEN metric_value ELSE 0 END) AS DOUBLE) AS view,
    CAST(sum(CASE WHEN metric_type = 'audio_request' THEN metric_value ELSE 0 END) AS DOUBLE) AS audio_request,
    CAST(sum(CASE WHEN metric_type = 'share_click' THEN metric_value ELSE 0 END) AS DOUBLE) AS share_click,
    CAST(sum(CASE WHEN metric_type = 'time_spent' THEN metric_value ELSE 0 END) AS DOUBLE) AS time_spent
  FROM quote_analytics GROUP BY quote_id""")
def quote_metrics_pivot(m: Model) -> DataFrame:
    found = reports.quote_metrics(m.quote_analytics)
    return found.select("quote_id", *[F.col(c).cast("double").alias(c) for c in dimensions.METRIC_TYPES])


@query("likes_per_quote", "SELECT quote_id, count(*) AS likes FROM likes GROUP BY quote_id")
def likes_per_quote(m: Model) -> DataFrame:
    return reports.likes_per_quote(m.likes)


@query("likes_and_shares", """
  SELECT platform, count(*) AS shares, CAST(sum(click_count) AS BIGINT) AS clicks FROM shares GROUP BY platform""")
def likes_and_shares(m: Model) -> DataFrame:
    return reports.clicks_per_platform(m.shares)


@query("voice_usage", """
  SELECT voice_id, count(*) AS generations, CAST(sum(text_length) AS BIGINT) AS characters,
    CAST(sum(ceil(text_length / 12)) AS BIGINT) AS seconds,
    CAST(sum(text_length) AS DOUBLE) / count(text_length) AS avg_length FROM audio GROUP BY voice_id""")
def voice_usage(m: Model) -> DataFrame:
    return reports.voice_usage(m.audio)


@query("audio_by_user", """
  SELECT user_id, count(*) AS generations, CAST(sum(text_length) AS BIGINT) AS characters FROM audio GROUP BY user_id""")
def audio_by_user(m: Model) -> DataFrame:
    return reports.audio_by_user(m.audio)


@query("mood_summary", """
  SELECT user_id, mood, count(*) AS entries, CAST(sum(energy_level) AS DOUBLE) / count(energy_level) AS avg_energy
  FROM mood_tracking GROUP BY user_id, mood""")
def mood_summary(m: Model) -> DataFrame:
    return reports.mood_distribution(m.mood_tracking)


@query("mood_triggers", """
  SELECT mood, trigger, count(*) AS entries FROM (SELECT mood, unnest(triggers) AS trigger FROM mood_tracking) x
  GROUP BY mood, trigger""")
def mood_triggers(m: Model) -> DataFrame:
    return reports.mood_triggers(m.mood_tracking)


@query("metric_buckets", """
  SELECT metric_name, date_trunc('hour', metric_ts) AS bucket_start, CAST(min(metric_value) AS DOUBLE) AS min_value,
    CAST(max(metric_value) AS DOUBLE) AS max_value, CAST(sum(metric_value) AS DOUBLE) / count(*) AS avg_value,
    CAST(last(metric_value ORDER BY metric_ts, id) AS DOUBLE) AS last_value, count(*) AS n
  FROM system_metrics GROUP BY metric_name, date_trunc('hour', metric_ts)""")
def metric_buckets(m: Model) -> DataFrame:
    found = series.metric_buckets(m.system_metrics)
    return found.withColumns({c: F.col(c).cast("double") for c in ("min_value", "max_value", "last_value")})


_RATES = """
    CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses,
    CAST(count(*) FILTER (hit AND is_ai) AS BIGINT) AS ai_hits,
    CAST(count(*) FILTER (NOT hit AND starts_with(cache_key, 'ai:')) AS BIGINT) AS ai_misses"""
_STATS = """hits, misses, ai_hits, ai_misses, hits / greatest(hits + misses, 1) AS hit_rate,
    ai_hits / greatest(ai_hits + ai_misses, 1) AS ai_hit_rate"""


@query("cache_stats", f"SELECT {_STATS} FROM (SELECT {_RATES} FROM cache_log) x")
def cache_stats(m: Model) -> DataFrame:
    return reports.cache_stats(m.cache_log)


@query("cache_stats_by_key", f"SELECT cache_key, {_STATS} FROM (SELECT cache_key, {_RATES} FROM cache_log GROUP BY cache_key) x")
def cache_stats_by_key(m: Model) -> DataFrame:
    return reports.cache_stats(m.cache_log, ["cache_key"])


@query("collections_expand", """
  SELECT c.collection_id, q.quote_id, q.author, q.lang FROM collections c
  JOIN collection_quotes m ON m.collection_id = c.collection_id JOIN quotes q ON q.quote_id = m.quote_id
  WHERE c.is_public""")
def collections_expand(m: Model) -> DataFrame:
    return reports.collection_quotes(m.collections, m.collection_quotes, m.quotes)


@query("collection_items", """
  SELECT c.role AS collection_id, c.quote_id, q.author FROM (SELECT DISTINCT role, conv_id AS quote_id FROM conversations) c
  JOIN quotes q ON q.quote_id = c.quote_id""")
def collection_items(m: Model) -> DataFrame:
    """Collections that carry their quotes as a list: here one list per conversation turn."""
    listed = m.raw("conversations").select(F.col("role").alias("id"), F.array("conv_id").alias("items"))
    expanded = reports.collection_items(listed, m.quotes.select("quote_id", "author"))
    return expanded.select("collection_id", "quote_id", "author").distinct()


@query("category_dim", """
  SELECT q.quote_id, q.category, c.category_name, c.category_premium FROM quotes q
  LEFT JOIN categories c ON c.category = q.category""")
def category_dim(m: Model) -> DataFrame:
    return reports.quotes_with_category(m.quotes.select("quote_id", "category"), dimensions.categories(m.spark))


@query("orphans", """
  SELECT f.event_id, f.quote_id FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.quote_id = f.quote_id)""")
def orphans(m: Model) -> DataFrame:
    return relations.orphans(m.feedback, "quote_id", m.quotes, "quote_id").select("event_id", "quote_id")


@query("cascade_delete", """
  SELECT f.user_id, f.quote_id, f.created_at FROM favorites f
  WHERE f.user_id NOT IN (SELECT user_id FROM users WHERE subscription_status = 'canceled')""")
def cascade_delete(m: Model) -> DataFrame:
    return relations.cascade_delete(m.favorites, filters.with_status(m.users, "canceled"), "user_id")


_OWNED = "SELECT collection_id, length(collection_id) % 10 AS user_id FROM collections"


@query("cascade_collections", f"""
  SELECT cq.collection_id, cq.quote_id FROM collection_quotes cq WHERE cq.collection_id NOT IN (
    SELECT collection_id FROM ({_OWNED}) o JOIN users u ON u.user_id = o.user_id WHERE u.subscription_status = 'canceled')""")
def cascade_collections(m: Model) -> DataFrame:
    """Members of collections that remain when canceled users go with their collections."""
    owned = m.collections.withColumn("user_id", (F.length("collection_id") % 10).cast("bigint"))
    _, members = relations.cascade_collections(owned, m.collection_quotes, filters.with_status(m.users, "canceled"))
    return members.select("collection_id", "quote_id")


@query("set_null", """
  SELECT a.id, CAST(CASE WHEN u.user_id IS NULL THEN a.user_id END AS STRING) AS user_id, a.action
  FROM audit a LEFT JOIN users u ON u.user_id = a.user_id AND u.subscription_status = 'canceled'""")
def set_null(m: Model) -> DataFrame:
    kept = relations.set_null(m.audit, filters.with_status(m.users, "canceled"), "user_id")
    return kept.select("id", F.col("user_id").cast("string").alias("user_id"), "action")


@query("dedupe_unique", """
  SELECT event_id, event_type, ts FROM webhook_events GROUP BY event_id, event_type, ts""")
def dedupe_unique(m: Model) -> DataFrame:
    return lifecycle.keep_first(m.webhook_events, ["event_id", "event_type"], ["ts"])


@query("duplicate_keys", """
  SELECT event_id, event_type, count(*) AS n FROM webhook_events GROUP BY event_id, event_type HAVING count(*) > 1""")
def duplicate_keys(m: Model) -> DataFrame:
    return lifecycle.duplicates(m.webhook_events, ["event_id", "event_type"])


@query("idempotent_events", """
  SELECT DISTINCT event_id, event_type, ts FROM webhook_events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def idempotent_events(m: Model) -> DataFrame:
    """Events still to be processed when everything before a date was consumed."""
    consumed = m.webhook_events.where(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return lifecycle.unseen_events(m.webhook_events, consumed, ["event_id", "event_type"], ["ts"])


@query("upsert_users", f"""
  WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM account_updates) x WHERE rn = 1)
  SELECT coalesce(u.user_id, n.user_id) AS user_id, u.email, coalesce(n.subscription_tier, u.subscription_tier) AS subscription_tier,
    coalesce(n.subscription_status, u.subscription_status) AS subscription_status,
    CASE WHEN u.user_id IS NULL THEN TIMESTAMP '{AS_OF}' ELSE u.created_at END AS created_at,
    CASE WHEN n.user_id IS NULL THEN u.created_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
  FROM users u FULL OUTER JOIN newest n ON n.user_id = u.user_id""")
def upsert_users(m: Model) -> DataFrame:
    merged = lifecycle.upsert(m.users, m.account_updates, "user_id", "ts", "event_id",
                              ["subscription_tier", "subscription_status"], as_of())
    return merged.select("user_id", "email", "subscription_tier", "subscription_status", "created_at", "updated_at")


@query("with_defaults", """
  SELECT user_id, coalesce(lang, 'EN') AS lang, 'inactive' AS state, false AS email_verified FROM users""")
def with_defaults(m: Model) -> DataFrame:
    people = m.users.select("user_id", "lang")
    filled = lifecycle.with_defaults(people, {"lang": lifecycle.QUOTE_DEFAULTS["language"],
                                              "state": lifecycle.USER_DEFAULTS["subscription_status"],
                                              "email_verified": lifecycle.USER_DEFAULTS["email_verified"]})
    return filled.select("user_id", "lang", "state", "email_verified")


SWEEP_DAY = "2025-01-15 00:00:00"
METRIC_DAY = "2024-04-10 00:00:00"


@query("retention", f"""
  SELECT 'audit' AS table_name, CAST(count(*) FILTER (created_at >= TIMESTAMP '{SWEEP_DAY}' - INTERVAL 1 YEAR) AS BIGINT) AS kept,
    CAST(count(*) FILTER (created_at < TIMESTAMP '{SWEEP_DAY}' - INTERVAL 1 YEAR) AS BIGINT) AS purged FROM audit
  UNION ALL SELECT 'system_metrics', count(*) FILTER (metric_ts >= TIMESTAMP '{METRIC_DAY}' - INTERVAL 90 DAYS),
    count(*) FILTER (metric_ts < TIMESTAMP '{METRIC_DAY}' - INTERVAL 90 DAYS) FROM system_metrics
  UNION ALL SELECT 'sessions', count(*) FILTER (gone IS NOT TRUE), count(*) FILTER (gone) FROM (
    SELECT expires_at < TIMESTAMP '{AS_OF}' OR (NOT is_active AND last_used_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS gone
    FROM sessions) s""")
def retention(m: Model) -> DataFrame:
    sweep = F.lit(SWEEP_DAY).cast("timestamp_ntz")
    audit = lifecycle.sweep_report("audit", m.audit, lifecycle.audit_expired(sweep))
    metrics = lifecycle.sweep_report("system_metrics", m.system_metrics,
                                     lifecycle.metric_expired(F.lit(METRIC_DAY).cast("timestamp_ntz")))
    sessions = lifecycle.sweep_report("sessions", m.sessions, lifecycle.session_expired(as_of()))
    return audit.unionByName(metrics).unionByName(sessions)


@query("session_purge", f"""
  SELECT id, user_id, expires_at FROM sessions WHERE (expires_at < TIMESTAMP '{AS_OF}'
    OR (NOT is_active AND last_used_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS)) IS NOT TRUE""")
def session_purge(m: Model) -> DataFrame:
    return lifecycle.purge(m.sessions, lifecycle.session_expired(as_of())).select("id", "user_id", "expires_at")


@query("ttl_live", f"""
  SELECT quote_id, voice, format, created_at, expires_at FROM (SELECT *, row_number() OVER (
    PARTITION BY quote_id, voice, format ORDER BY created_at DESC, event_id DESC) AS rn FROM audio_cache) x
  WHERE rn = 1 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')""")
def ttl_live(m: Model) -> DataFrame:
    live = lifecycle.live_entries(m.audio_cache, ["quote_id", "voice", "format"], "created_at", "event_id", as_of())
    return live.select("quote_id", "voice", "format", "created_at", "expires_at")


@query("ttl_expiry", """
  SELECT event_id, CASE WHEN k > 10 THEN ts + to_seconds(k - 10) END AS expires_at FROM ev""")
def ttl_expiry(m: Model) -> DataFrame:
    return m.ev.select("event_id", lifecycle.expiry(F.col("ts"), F.col("k") - 10).alias("expires_at"))


@query("token_live", f"""
  SELECT id, user_id, expires_at FROM refresh_tokens WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{AS_OF}'""")
def token_live(m: Model) -> DataFrame:
    return lifecycle.live_tokens(m.refresh_tokens, as_of()).select("id", "user_id", "expires_at")


@query("prefix_filter", "SELECT event_id, cache_key FROM cache_log WHERE cache_key LIKE 'ai:4%'")
def prefix_filter(m: Model) -> DataFrame:
    return filters.starts_with(m.cache_log, "cache_key", "ai:4").select("event_id", "cache_key")


@query("partial_filters", """
  SELECT 'sessions' AS subset, count(*) AS n FROM sessions WHERE is_active
  UNION ALL SELECT 'collections', count(*) FROM collections WHERE is_public
  UNION ALL SELECT 'quotes', count(*) FROM quotes WHERE premium_tier IS NOT NULL
  UNION ALL SELECT 'users', count(*) FROM users WHERE subscription_status <> 'inactive'
  UNION ALL SELECT 'audit', count(*) FROM audit WHERE action = 'error'""")
def partial_filters(m: Model) -> DataFrame:
    billed = m.users.withColumn("stripe_customer_id", F.when(F.col("subscription_status") != "inactive", F.col("email")))
    traced = m.audit.withColumn("request_id", F.when(F.col("action") == "error", F.col("id").cast("string")))
    subsets = {
        "sessions": filters.active_sessions(m.sessions), "collections": filters.public_collections(m.collections),
        "quotes": filters.premium_quotes(m.quotes), "users": filters.billed_users(billed),
        "audit": filters.traced_audit(traced),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("subset"), "n") for name, df in subsets.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query("json_containment", "SELECT id FROM audit WHERE details = '{\"k\": 7}'")
def json_containment(m: Model) -> DataFrame:
    return m.audit.where(filters.json_field_is(F.col("details"), "k", "7")).select("id")


@query("append_rows", """
  SELECT quote_id, text, category, lang FROM quotes
  UNION ALL SELECT item_id, text, 'focus', NULL FROM benchmark""")
def append_rows(m: Model) -> DataFrame:
    existing = m.quotes.select("quote_id", "text", "category", "lang")
    new = m.raw("benchmark").select(F.col("item_id").alias("quote_id"), "text", F.lit("focus").alias("category"))
    return lifecycle.append(existing, new)


@query("parameterised_sql", """
  SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'click' AND value > 50 GROUP BY user_id""")
def parameterised_sql(m: Model) -> DataFrame:
    statement = "SELECT user_id, count(*) AS n FROM {ev} WHERE event_type = :kind AND value > :least GROUP BY user_id"
    return tables.query(m.spark, statement, {"kind": "click", "least": 50}, ev=m.ev)
