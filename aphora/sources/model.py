"""The canonical model over the supplied star-schema, event and document tables.

Every table is a lazy DataFrame. ``ORACLE_CTES`` states the same tables in SQL for the correctness check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.sources.tables import table


def _by_remainder(key: Column, values: list[str]) -> Column:
    """The value at position ``key mod n``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _map(key: str, pairs: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, value in pairs.items():
        out = F.when(F.col(key) == name, F.lit(value)).otherwise(out)
    return out


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(15,4)")


class Model:
    """Tables of the canonical model, derived from the tables found in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def users(self) -> DataFrame:
        first_order = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
        key = F.col("c_custkey")
        people = self.raw("customer").select(
            key.alias("user_id"),
            F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("email"),
            _by_remainder(key, ["free", "standard", "pro"]).alias("subscription_tier"),
            _by_remainder(key, ["inactive", "active", "past_due", "canceled", "active"]).alias("subscription_status"),
            F.when(key % 4 != 0, F.lit("en")).alias("lang"),
        )
        joined = people.join(first_order, people.user_id == first_order.o_custkey, "left")
        return joined.drop("o_custkey")

    @cached_property
    def quotes(self) -> DataFrame:
        doc = F.col("doc_id")
        own = doc % 3 == 0
        return self.raw("documents").select(
            doc.alias("quote_id"),
            "text",
            "lang",
            _by_remainder(doc, dimensions.CATEGORY_IDS).alias("category"),
            F.col("source").alias("author"),
            F.array(_by_remainder(doc, dimensions.CATEGORY_IDS), F.col("source")).alias("tags"),
            _by_remainder(F.col("n_chars"), ["calm", "focused", "tired", "motivated"]).alias("mood"),
            (doc % 4 == 0).alias("premium"),
            F.when(doc % 4 == 0, F.lit("pro")).alias("premium_tier"),
            (F.col("n_chars") % 100 + 1).cast("int").alias("score"),
            own.alias("user_generated"),
            F.when(own, doc % 15).alias("user_id"),
            (F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval(mins=(doc % 100000).cast("int"))).alias(
                "created_at"
            ),
        )

    @cached_property
    def ev(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "ts", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    def _events(self, kind: str) -> DataFrame:
        return self.ev.where(F.col("event_type") == kind)

    @cached_property
    def favorites(self) -> DataFrame:
        clicks = self._events("click")
        return clicks.groupBy("user_id", F.col("k").alias("quote_id")).agg(F.min("ts").alias("created_at"))

    @cached_property
    def views(self) -> DataFrame:
        seen = self._events("view").select("event_id", "user_id", F.col("k").alias("quote_id"), F.col("ts").alias("created_at"))
        return seen.join(self.quotes.select("quote_id", "category"), "quote_id", "left")

    @cached_property
    def view_audit(self) -> DataFrame:
        """View events as audit rows; the category is JSON null where the quote is unknown."""
        seen = self._events("view").select("user_id", F.col("k").alias("quote_id"), "ts")
        named = seen.join(self.quotes.select("quote_id", "category"), "quote_id", "left")
        payload = F.to_json(F.struct("quote_id", "category"), {"ignoreNullFields": "false"})
        return named.select("user_id", F.lit("quote_view").alias("action"), payload.alias("details"),
                            F.col("ts").alias("created_at"))

    @cached_property
    def audio(self) -> DataFrame:
        return self._events("purchase").select(
            F.col("event_id").alias("id"), "user_id", F.col("k").alias("quote_id"),
            F.concat(F.lit("voice_"), (F.col("k") % 20).cast("string")).alias("voice_id"),
            F.floor("value").cast("int").alias("text_length"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tier"),
            F.col("o_orderdate").alias("period_start"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"),
            F.col("props").alias("details"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def webhook_events(self) -> DataFrame:
        """Every event as a webhook; purchases are delivered twice."""
        once = self.ev.select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), "event_type", "ts")
        return once.unionByName(once.where(F.col("event_type") == "purchase"))

    @cached_property
    def call_log(self) -> DataFrame:
        return self.ev.select(
            F.concat(F.lit("POST-host"), (F.col("user_id") % 5).cast("string")).alias("endpoint"),
            F.col("event_id").alias("call_id"), "ts",
            F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("outcome"),
        )

    @cached_property
    def cache_log(self) -> DataFrame:
        ai = F.col("k") % 2 == 0
        return self.ev.select(
            "event_id", "ts",
            F.concat(F.when(ai, F.lit("ai:")).otherwise(F.lit("api-")), F.col("k").cast("string")).alias("cache_key"),
            (F.col("event_type") != "error").alias("hit"), ai.alias("is_ai"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        level = _map("event_type", {"error": "ERROR", "view": "DEBUG"}, "INFO")
        status = F.when(F.col("k") % 11 == 5, F.lit('"n/a"')).when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200"))
        asked = F.when(F.col("k") % 7 == 3, F.lit(' x=[1] start {"a"')).otherwise(F.lit(""))
        return self.ev.select(F.concat(
            F.lit("["), F.col("ts").cast("date").cast("string"), F.lit("T00:00:00.000Z] ["), level, F.lit("] [req-"),
            F.col("event_id").cast("string"), F.lit("] GET /api/"), F.col("event_type"),
            asked, F.lit(' done {"statusCode":'), status, F.lit(',"responseTime":'),
            _money("value").cast("string"), F.lit(',"token":"t'), F.col("k").cast("string"), F.lit('"}'),
        ).alias("value"))

    @cached_property
    def request_events(self) -> DataFrame:
        """The start and the end of each request as two rows."""
        request = F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id")
        method, url = F.lit("GET").alias("method"), F.concat(F.lit("/api/"), F.col("event_type")).alias("url")
        started = self.ev.select(request, method, url, F.lit("start").alias("phase"), "ts",
                                 F.lit(None).cast("int").alias("status_code"))
        status = F.when(F.col("event_type") == "error", 500).otherwise(200)
        took = F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)") / 1000)
        ended = self.ev.select(request, method, url, F.lit("end").alias("phase"), (F.col("ts") + took).alias("ts"),
                               status.alias("status_code"))
        return started.unionByName(ended)

    @cached_property
    def completions(self) -> DataFrame:
        number = lambda shift: ((F.col("user_id") + shift) % 20 + 1).cast("string")
        return self.ev.select("user_id").distinct().select("user_id", F.concat(
            F.lit("1. "), number(0), F.lit(" - fits\n2. 99 - too far\nnoise\n3. "), number(7), F.lit(" - also fits"),
        ).alias("completion"))

    @cached_property
    def sessions(self) -> DataFrame:
        n = F.col("event_id")
        return self.ev.select(
            n.alias("id"), "user_id", F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), (n % 4 != 0).alias("is_active"),
            F.when(n % 9 != 0, F.col("ts")).alias("last_used_at"),
        )

    @cached_property
    def audio_cache(self) -> DataFrame:
        return self._events("purchase").select(
            "event_id", F.col("k").alias("quote_id"),
            F.concat(F.lit("voice_"), (F.col("k") % 20).cast("string")).alias("voice"), F.lit("mp3").alias("format"),
            F.col("ts").alias("created_at"),
            F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("expires_at"),
        )

    @cached_property
    def collections(self) -> DataFrame:
        by_category = self.quotes.groupBy(F.col("category").alias("collection_id"))
        return by_category.agg(F.count("*").alias("n_items"), (F.min("quote_id") % 2 == 0).alias("is_public"))

    @cached_property
    def collection_quotes(self) -> DataFrame:
        return self.quotes.where("premium").select(F.col("category").alias("collection_id"), "quote_id")

    @cached_property
    def mood_tracking(self) -> DataFrame:
        return self._events("signup").select(
            F.col("event_id").alias("id"), "user_id",
            _by_remainder(F.col("k"), ["calm", "focused", "tired", "motivated"]).alias("mood"),
            (F.col("k") % 10 + 1).cast("int").alias("energy_level"),
            F.array(_by_remainder(F.col("k"), ["work", "sleep", "family"]),
                    _by_remainder(F.col("user_id"), ["music", "sport"])).alias("triggers"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def quote_analytics(self) -> DataFrame:
        kind = _map("event_type", {"view": "view", "purchase": "audio_request", "click": "share_click"}, "time_spent")
        return self.ev.select(F.col("event_id").alias("id"), F.col("k").alias("quote_id"), kind.alias("metric_type"),
                              _money("value").alias("metric_value"), "user_id", F.col("ts").alias("created_at"))

    @cached_property
    def system_metrics(self) -> DataFrame:
        return self.ev.select(F.col("event_type").alias("metric_name"), _money("value").alias("metric_value"),
                              F.col("ts").alias("metric_ts"), F.col("event_id").alias("id"))

    @cached_property
    def shares(self) -> DataFrame:
        return self._events("click").select(
            F.col("event_id").alias("id"), "user_id", F.col("k").alias("quote_id"),
            _by_remainder(F.col("event_id"), ["twitter", "facebook", "whatsapp", "email"]).alias("platform"),
            F.floor("value").cast("int").alias("click_count"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def likes(self) -> DataFrame:
        return self._events("signup").select("user_id", F.col("k").alias("quote_id")).distinct()

    @cached_property
    def feedback(self) -> DataFrame:
        """Feedback on quotes; some names a quote that does not exist."""
        verdict = _map("event_type", {"purchase": "like", "signup": "like", "error": "dislike"}, "neutral")
        return self.ev.select("user_id", (F.col("k") * 13).alias("quote_id"), verdict.alias("feedback"),
                              F.col("ts").alias("created_at"), "event_id")

    @cached_property
    def account_updates(self) -> DataFrame:
        """Account changes, some for accounts that do not exist yet; several may hit the same account."""
        return self._events("signup").select(
            (F.col("user_id") * 100 + F.col("k")).alias("user_id"),
            _by_remainder(F.col("event_id"), ["standard", "pro"]).alias("subscription_tier"),
            F.lit("active").alias("subscription_status"), "ts", "event_id",
        )

    @cached_property
    def refresh_tokens(self) -> DataFrame:
        n = F.col("event_id")
        return self.ev.select(
            n.alias("id"), "user_id", F.col("ts").alias("issued_at"),
            F.when(n % 11 != 0, F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
            F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("revoked_at"),
        )

    @cached_property
    def personalize_requests(self) -> DataFrame:
        """Personalisation requests as they arrive: lists, and texts that may be missing."""
        return self._events("signup").select(
            F.col("event_id").alias("request_id"), "user_id",
            F.array(_by_remainder(F.col("k"), ["nature", "sport", "family"])).alias("preferences"),
            F.array(_by_remainder(F.col("k"), dimensions.CATEGORY_IDS),
                    _by_remainder(F.col("user_id"), dimensions.CATEGORY_IDS)).alias("topics"),
            _by_remainder(F.col("event_id"), ["stoic", "playful"]).alias("style"),
            _by_remainder(F.col("event_id"), ["short", "medium", "long"]).alias("length"),
            _by_remainder(F.col("user_id"), ["ro", "en", "fr"]).alias("language"),
            F.col("ts").alias("created_at"),
        )


# The same tables in SQL, each naming only the supplied tables and tables above it.
_CATEGORY_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(dimensions.CATEGORY_IDS))


def _sql_values(rows: list[tuple]) -> str:
    def lit(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


ORACLE_CTES = {
    "users": """
      SELECT c.c_custkey AS user_id, lower(replace(c.c_name, '#', '_')) AS email,
        CASE c.c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'standard' ELSE 'pro' END AS subscription_tier,
        CASE c.c_custkey % 5 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' WHEN 2 THEN 'past_due'
          WHEN 3 THEN 'canceled' ELSE 'active' END AS subscription_status,
        CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE 'en' END AS lang, o.first_ts AS created_at
      FROM customer c
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_ts FROM orders GROUP BY o_custkey) o
        ON c.c_custkey = o.o_custkey""",
    "quotes": f"""
      SELECT doc_id AS quote_id, text, lang, CASE doc_id % 15 {_CATEGORY_CASE} END AS category, source AS author,
        [CASE doc_id % 15 {_CATEGORY_CASE} END, source] AS tags,
        CASE n_chars % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'focused' WHEN 2 THEN 'tired' ELSE 'motivated' END AS mood,
        doc_id % 4 = 0 AS premium, CASE WHEN doc_id % 4 = 0 THEN 'pro' END AS premium_tier,
        CAST(n_chars % 100 + 1 AS INT) AS score, doc_id % 3 = 0 AS user_generated,
        CASE WHEN doc_id % 3 = 0 THEN doc_id % 15 END AS user_id,
        TIMESTAMP '2024-01-31' - to_minutes(doc_id % 100000) AS created_at
      FROM documents""",
    "ev": """
      SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "favorites": """
      SELECT user_id, k AS quote_id, min(ts) AS created_at FROM ev WHERE event_type = 'click' GROUP BY user_id, k""",
    "views": """
      SELECT e.event_id, e.user_id, e.k AS quote_id, q.category, e.ts AS created_at
      FROM ev e LEFT JOIN quotes q ON e.k = q.quote_id WHERE e.event_type = 'view'""",
    "audio": """
      SELECT event_id AS id, user_id, k AS quote_id, concat('voice_', CAST(k % 20 AS STRING)) AS voice_id,
        CAST(floor(value) AS INT) AS text_length, ts AS created_at FROM ev WHERE event_type = 'purchase'""",
    "subscriptions": """
      SELECT o_orderkey AS subscription_id, o_custkey AS user_id, o_orderstatus AS status, o_orderpriority AS tier,
        o_orderdate AS period_start FROM orders""",
    "audit": """
      SELECT event_id AS id, user_id, event_type AS action, props AS details, ts AS created_at FROM events""",
    "webhook_events": """
      SELECT concat('evt_', CAST(event_id AS STRING)) AS event_id, event_type, ts FROM ev
      UNION ALL
      SELECT concat('evt_', CAST(event_id AS STRING)) AS event_id, event_type, ts FROM ev
      WHERE event_type = 'purchase'""",
    "call_log": """
      SELECT concat('POST-host', CAST(user_id % 5 AS STRING)) AS endpoint, event_id AS call_id, ts,
        CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome FROM ev""",
    "cache_log": """
      SELECT event_id, ts, concat(CASE WHEN k % 2 = 0 THEN 'ai:' ELSE 'api-' END, CAST(k AS STRING)) AS cache_key,
        event_type <> 'error' AS hit, k % 2 = 0 AS is_ai FROM ev""",
    "request_log": """
      SELECT event_id, concat('[', CAST(CAST(ts AS DATE) AS STRING), 'T00:00:00.000Z] [',
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END, '] [req-',
        CAST(event_id AS STRING), '] GET /api/', event_type, CASE WHEN k % 7 = 3 THEN ' x=[1] start {"a"' ELSE '' END, ' done {"statusCode":',
        CASE WHEN k % 11 = 5 THEN '"n/a"' WHEN event_type = 'error' THEN '500' ELSE '200' END, ',"responseTime":',
        CAST(CAST(value AS DECIMAL(15,4)) AS STRING), ',"token":"t', CAST(k AS STRING), '"}') AS value FROM ev""",
    "completions": """
      SELECT user_id, concat('1. ', CAST(user_id % 20 + 1 AS STRING), ' - fits', chr(10), '2. 99 - too far', chr(10),
        'noise', chr(10), '3. ', CAST((user_id + 7) % 20 + 1 AS STRING), ' - also fits') AS completion
      FROM (SELECT DISTINCT user_id FROM ev) u""",
    "sessions": """
      SELECT event_id AS id, user_id, ts AS created_at, ts + INTERVAL '7' DAY AS expires_at,
        event_id % 4 <> 0 AS is_active, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS last_used_at FROM ev""",
    "audio_cache": """
      SELECT event_id, k AS quote_id, concat('voice_', CAST(k % 20 AS STRING)) AS voice, 'mp3' AS format,
        ts AS created_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '14' DAY END AS expires_at
      FROM ev WHERE event_type = 'purchase'""",
    "collections": """
      SELECT category AS collection_id, count(*) AS n_items, min(quote_id) % 2 = 0 AS is_public
      FROM quotes GROUP BY category""",
    "collection_quotes": "SELECT category AS collection_id, quote_id FROM quotes WHERE premium",
    "mood_tracking": """
      SELECT event_id AS id, user_id,
        CASE k % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'focused' WHEN 2 THEN 'tired' ELSE 'motivated' END AS mood,
        CAST(k % 10 + 1 AS INT) AS energy_level,
        [CASE k % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'sleep' ELSE 'family' END,
         CASE user_id % 2 WHEN 0 THEN 'music' ELSE 'sport' END] AS triggers, ts AS created_at
      FROM ev WHERE event_type = 'signup'""",
    "quote_analytics": """
      SELECT event_id AS id, k AS quote_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'audio_request'
        WHEN 'click' THEN 'share_click' ELSE 'time_spent' END AS metric_type,
        CAST(value AS DECIMAL(15,4)) AS metric_value, user_id, ts AS created_at FROM ev""",
    "system_metrics": """
      SELECT event_type AS metric_name, CAST(value AS DECIMAL(15,4)) AS metric_value, ts AS metric_ts, event_id AS id
      FROM ev""",
    "shares": """
      SELECT event_id AS id, user_id, k AS quote_id, CASE event_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'facebook'
        WHEN 2 THEN 'whatsapp' ELSE 'email' END AS platform, CAST(floor(value) AS INT) AS click_count, ts AS created_at
      FROM ev WHERE event_type = 'click'""",
    "likes": "SELECT DISTINCT user_id, k AS quote_id FROM ev WHERE event_type = 'signup'",
    "feedback": """
      SELECT user_id, k * 13 AS quote_id, CASE event_type WHEN 'purchase' THEN 'like' WHEN 'signup' THEN 'like'
        WHEN 'error' THEN 'dislike' ELSE 'neutral' END AS feedback, ts AS created_at, event_id FROM ev""",
    "account_updates": """
      SELECT user_id * 100 + k AS user_id, CASE event_id % 2 WHEN 0 THEN 'standard' ELSE 'pro' END AS subscription_tier,
        'active' AS subscription_status, ts, event_id FROM ev WHERE event_type = 'signup'""",
    "refresh_tokens": """
      SELECT event_id AS id, user_id, ts AS issued_at,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL '7' DAY END AS expires_at,
        CASE WHEN event_type = 'error' THEN ts + INTERVAL '1' DAY END AS revoked_at FROM ev""",
    "personalize_requests": f"""
      SELECT event_id AS request_id, user_id, [CASE k % 3 WHEN 0 THEN 'nature' WHEN 1 THEN 'sport' ELSE 'family' END]
        AS preferences, [CASE k % 15 {_CATEGORY_CASE} END, CASE user_id % 15 {_CATEGORY_CASE} END] AS topics,
        CASE event_id % 2 WHEN 0 THEN 'stoic' ELSE 'playful' END AS style,
        CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS length,
        CASE user_id % 3 WHEN 0 THEN 'ro' WHEN 1 THEN 'en' ELSE 'fr' END AS language, ts AS created_at
      FROM ev WHERE event_type = 'signup'""",
    "voices": "SELECT * FROM (VALUES "
              + _sql_values([(*v, pos) for pos, v in enumerate(dimensions.VOICES)])
              + f") AS t({', '.join(dimensions.VOICE_COLUMNS)})",
    "categories": "SELECT * FROM (VALUES " + _sql_values(dimensions.CATEGORIES)
                  + f") AS t({', '.join(dimensions.CATEGORY_COLUMNS)})",
    "plans": "SELECT * FROM (VALUES " + _sql_values([p[:3] + p[5:] for p in dimensions.PLANS])
             + ") AS t(tier, name, price, max_favorites, max_audio, max_voices, premium_content, analytics)",
}
