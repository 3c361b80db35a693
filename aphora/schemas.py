"""Column types of every table the package reads; jobs never infer a schema."""

from __future__ import annotations

INPUT_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The canonical model: what the operators expect. Timestamps are without zone in batch tables and are cast
# to zoned ones where a stream needs a watermark.
CANONICAL = {
    "users": "user_id bigint, email string, subscription_tier string, subscription_status string, "
             "stripe_customer_id string, email_verified boolean, lang string, total_logins int, last_login date, "
             "badges array<string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "subscriptions": "subscription_id string, user_id bigint, status string, tier string, "
                     "period_start timestamp_ntz, period_end timestamp_ntz, cancel_at_period_end boolean, "
                     "created_at timestamp_ntz, updated_at timestamp_ntz",
    "quotes": "quote_id bigint, text string, author string, category string, lang string, tags array<string>, "
              "mood string, premium boolean, premium_tier string, score int, embedding array<float>, "
              "user_generated boolean, user_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz",
    "categories": "id string, name string, premium boolean",
    "favorites": "user_id bigint, quote_id bigint, created_at timestamp_ntz",
    "audit": "user_id bigint, action string, details string, request_id string, ip string, created_at timestamp_ntz",
    "quote_analytics": "quote_id bigint, metric_type string, metric_value decimal(38,10), user_id bigint, "
                       "session_id string, metadata string, created_at timestamp_ntz",
    "audio_generations": "user_id bigint, quote_id bigint, voice_id string, text_length int, duration_ms int, "
                         "ip string, created_at timestamp_ntz",
    "audio_cache": "quote_id bigint, voice string, speed decimal(4,2), format string, file_url string, "
                   "file_size int, duration_seconds int, created_at timestamp_ntz, expires_at timestamp_ntz",
    "sessions": "user_id bigint, expires_at timestamp_ntz, is_active boolean, last_used_at timestamp_ntz, "
                "created_at timestamp_ntz",
    "refresh_tokens": "user_id bigint, token string, issued_at timestamp_ntz, expires_at timestamp_ntz, "
                      "revoked_at timestamp_ntz",
    "consumed_events": "event_id string, event_type string, processed_at timestamp_ntz, metadata string",
    "collections": "collection_id string, user_id bigint, name string, is_public boolean, tags array<string>",
    "collection_quotes": "collection_id string, quote_id bigint, added_at timestamp_ntz",
    "shares": "quote_id bigint, user_id bigint, platform string, share_url string, click_count int",
    "likes": "quote_id bigint, user_id bigint, created_at timestamp_ntz",
    "mood_tracking": "user_id bigint, mood string, energy_level int, context string, triggers array<string>, "
                     "created_at timestamp_ntz",
    "system_metrics": "metric_name string, metric_value decimal(15,4), tags string, metric_ts timestamp_ntz",
    "push_tokens": "user_id bigint, token string, created_at timestamp_ntz",
}

# Files of the catalogue.
QUOTE_FILE = "id string, text string, author string, source string, year int, premium boolean"
GENERATED_FILE = "text string, category string, lang string, createdAt bigint"
COLLECTION_FILE = "id string, name string, items array<string>"
CATEGORY_FILE = "id string, name string, premium boolean"
