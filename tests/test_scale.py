"""Properties of the plans that keep the jobs usable on much larger and skewed tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from aphora.operators import ranking, relations, series
from aphora.plans import logs, profile, recommend
from aphora.queries import QUERIES
from aphora.sources.model import Model
from tests.conftest import DATA
from tests.helpers import tuples

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WRITES = ("stream_", "sink_", "stored_")
IN_PYTHON = {"mask_json_deep", "breaker_fold", "breaker_status", "completion_udf", "text_search_english", "text_search_english_index", "validate_custom"}


def plan_of(df, final=False):
    if final:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(WRITES)))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name].run(Model(spark, DATA)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    python = re.search(r"EvalPython|InPandas|InArrow|BatchEvalPython", plan)
    assert bool(python) == (name in IN_PYTHON)


def sources():
    for folder, inner, files in os.walk(os.path.join(ROOT, "aphora")):
        inner[:] = [name for name in inner if name != "llm"]  # the text operators have rules and tests of their own
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf-8") as f:
                    yield file, f.read()


def test_nothing_is_brought_to_the_driver():
    for file, text in sources():
        for word in (".collect()", ".toPandas(", ".toLocalIterator(", "localCheckpoint", "crossJoin", ".rdd", ".cache()", ".sample("):
            assert word not in text, (file, word)
        assert "W.orderBy" not in text, f"{file}: a window without a partition"
        for use in re.findall(r"F\.broadcast\((\w+)", text):
            assert use in ("dimension", "totals"), f"{file}: broadcast of {use}"


def test_filters_and_columns_reach_the_scan(spark):
    model = Model(spark, DATA)
    plan = plan_of(ranking.count_by(model.favorites, ["user_id"]))
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:" not in plan and "value:double" not in plan
    day = recommend.quote_of_the_day(model.quotes, 1, mood="calm")
    assert "EqualTo(doc_id,ScalarSubquery" in plan_of(day)


def test_ranking_prunes_before_the_shuffle(spark, model):
    plan = plan_of(ranking.latest_per_key(model.favorites, ["user_id"], "created_at", "quote_id", 5))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


@pytest.fixture
def small_skew_limits(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_favorites(spark, n=60000):
    """Favorites of which a third name one quote and a third belong to one user."""
    i = F.col("id")
    return spark.range(0, n, 1, 16).select(
        F.when(i % 3 == 1, 7).otherwise(i % 997).cast("bigint").alias("user_id"),
        F.when(i % 3 == 0, 42).otherwise(i % 1009).cast("bigint").alias("quote_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=i)).alias("created_at"),
    )


def test_hot_quote_is_split(spark, small_skew_limits):
    quotes = spark.range(1009).select(F.col("id").alias("quote_id"), F.lit("x").alias("author"))
    found = relations.find(hot_favorites(spark), quotes, "quote_id")
    assert found.where("found").count() == 60000
    assert "skew=true" in plan_of(found, final=True)


def test_hot_user_sends_few_rows(spark):
    favorites = hot_favorites(spark)
    quotes = spark.range(1009).select(F.col("id").alias("quote_id"), F.lit("t").alias("text"), F.lit("c").alias("category"), F.lit("en").alias("lang"))
    latest = profile.favorites_with_quotes(favorites, quotes, 10)
    mine = sorted(r.created_at for r in latest.where("user_id = 7").collect())
    want = sorted(r.created_at for r in favorites.where("user_id = 7").orderBy(F.desc("created_at")).limit(10).collect())
    assert mine == want


def test_hot_key_of_rolling_counts_is_spread(spark):
    """The rows of one key end up in many partitions, and none holds much of them."""
    events = spark.range(0, 30000, 1, 8).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"),
                                                (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = series.rolling_counts(events, "user_id", "ts", "event_id")
        shares = counted.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) == 8 and max(r["count"] for r in shares) < 30000 / 4


def test_latency_of_a_hot_route(spark):
    """Exact percentiles though only a few milliseconds are looked into; a missing key is a key of its own."""
    import numpy as np

    rows = spark.range(0, 30000, 1, 8).select(F.when(F.col("id") % 10 > 0, F.lit("GET")).alias("method"), (F.pmod(F.xxhash64("id"), F.lit(250_000)) / 1000).alias("response_ms"))
    for row in logs.latency(rows.union(spark.createDataFrame([("GET", None)], rows.schema)), ["method"]).collect():
        t = np.array([r.response_ms for r in rows.collect() if r.method == row.method])
        assert row.requests == len(t) and row.max_ms == t.max()
        assert np.allclose([row.mean_ms, row.p50_ms, row.p95_ms], [t.mean(), np.percentile(t, 50), np.percentile(t, 95)])
    few = spark.createDataFrame([("a", 1.2), ("a", 2.7), ("a", 12.9)], "method string, response_ms double")
    row = logs.latency(few, ["method"]).first()
    assert (row.p50_ms, row.p95_ms, row.max_ms) == (2.7, pytest.approx(11.88), 12.9)


def test_latency_of_any_spread(spark):
    """Percentiles among times that lie close together and among those many powers of ten apart."""
    import numpy as np

    rng = np.random.default_rng(3)
    for times in (100 + rng.random(3000) * 1e-9, 10.0 ** rng.uniform(-300, 14, 3000), -(10.0 ** rng.uniform(-3, 3, 999)), np.zeros(5), np.array([7.5])):
        rows = spark.createDataFrame([("a", float(t)) for t in times], "method string, response_ms double")
        row = logs.latency(rows, ["method"]).first()
        assert row.requests == len(times) and row.max_ms == times.max()
        assert np.allclose([row.p50_ms, row.p95_ms], np.percentile(times, [50, 95]), rtol=1e-12, atol=0)


@pytest.mark.parametrize("name", ["user_profile", "recommendation_prompt"])
def test_quote_texts_are_read_once(spark, name):
    plan = plan_of(QUERIES[name].run(Model(spark, DATA)))
    assert len(re.findall(r"documents\.parquet[^\n]*ReadSchema: struct<[^\n]*\btext:string", plan)) == 1


def test_log_text_is_parsed_once(spark):
    """All figures come from one stored table of counts; nothing of the plan reads or parses the lines again."""
    plan = plan_of(QUERIES["route_latency"].run(Model(spark, DATA)))
    assert "events.parquet" not in plan and "regexp_extract" not in plan and "route-times" in plan


def test_top_values_count_first(spark):
    hot = hot_favorites(spark)
    plan = plan_of(ranking.top_values(hot, "user_id", "quote_id", 3))
    assert "partial_count" in plan
    top = tuples(ranking.top_values(hot, "user_id", "quote_id", 1).where("user_id = 5"), "quote_id")
    assert len(top) == 1


def test_dashboard_reads_views_once(spark):
    from aphora.plans.dashboard import dashboard

    m = Model(spark, DATA)
    plan = plan_of(dashboard(m.users, m.views, m.audio, m.favorites, F.lit("2024-01-30").cast("date")), final=True)
    final = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet [^\n]*?/(\w+)\.parquet", final)
    assert scans.count("events") <= 3 and scans.count("documents") <= 1
