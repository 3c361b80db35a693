"""Time the registered queries on the supplied tables; prints one JSON line.

Every query runs to the end with all of its columns (``noop`` sink), twice to warm up and once to be timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aphora.queries import QUERIES  # noqa: E402
from aphora.session import build_session  # noqa: E402
from aphora.sources.model import Model  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]

# One or more of every kind of operator; BENCH_QUERIES names others, or "all".
HEADLINE = [
    "user_stats", "active_subscriptions", "favorites_with_quotes", "personalized_history", "top_categories", "user_profile",
    "candidate_quotes", "recommendations", "recommendation_prompt", "personalize_prompt", "feedback_apply", "quote_of_day",
    "quote_lookup", "best_quotes", "dashboard", "weekly_progress", "activity_streak", "plan_usage", "recent_audit",
    "quote_metrics_pivot", "mood_summary", "metric_buckets", "cache_stats", "category_dim", "orphans", "cascade_delete",
    "idempotent_events", "upsert_users", "retention", "ttl_live", "parse_logs", "format_logs", "mask_struct", "mask_json_deep",
    "route_latency", "request_pairs", "json_roundtrip", "brute_force", "rate_limit", "sessions_gap", "breaker_fold",
    "mood_classify", "voice_assignment", "voice_catalogue", "share_feed", "sanitize_text", "text_search", "text_search_index",
    "generated_batch", "validate_numbers", "validate_strings", "validate_objects", "quarantine", "stream_dedupe", "stream_rate",
    "sink_append",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(Model(spark, FOLDER)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="aphora-bench-") as shared:
        measure(shared)


def measure(shared: str) -> None:
    spark = build_session(
        "aphora-bench", f"local[{CPUS}]", int(CPUS) if CPUS.isdigit() else 8,
        **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared},
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    names = list(QUERIES) if ONLY == ["all"] else ONLY or HEADLINE
    for name in names:
        run(spark, name)
        run(spark, name)
        times[name] = round(run(spark, name), 4)
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
              "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
