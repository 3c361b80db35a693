import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from aphora.operators import series
from tests.helpers import ntz, tuples

EVENTS = "user_id bigint, event_id bigint, ts timestamp_ntz"


def hot_events(spark, n=1500, seed=3, spread=6000):
    """Events of which one user has well over a third, with equal times and times on window ends."""
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), i, ntz(rng.choice([rng.randint(0, spread), rng.randint(0, spread // 60) * 60])))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("span, bucket", [(900, 60), (900, 7), (60, 3600), (1, 1)])
def test_rolling_counts(spark, span, bucket):
    rows, df = hot_events(spark)
    by_user = defaultdict(list)
    for user, _, ts in rows:
        by_user[user].append(ts)
    want = sorted((i, sum(1 for x in by_user[u] if 0 <= (t - x).total_seconds() <= span)) for u, i, t in rows)
    assert tuples(series.rolling_counts(df, "user_id", "ts", "event_id", span, bucket), "event_id", "attempts") == want


def test_rolling_counts_of_one_key(spark):
    rows = spark.range(20000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"),
                                     (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    counted = series.rolling_counts(rows, "user_id", "ts", "event_id")
    assert counted.agg(F.max("attempts")).first()[0] == 901


def test_brute_force_threshold(spark):
    rows = [(1, i, ntz(i * 200)) for i in range(6)] + [(2, 10 + i, ntz(i * 300)) for i in range(6)]
    found = series.brute_force(spark.createDataFrame(rows, EVENTS), "user_id", "ts", "event_id", threshold=5)
    assert tuples(found, "user_id", "event_id", "attempts") == [(1, 4, 5), (1, 5, 5)]


@pytest.mark.parametrize("gap", [30, 300, 1800])
def test_sessions(spark, gap):
    rows, df = hot_events(spark, n=600, spread=40000)
    want = []
    for user in {r[0] for r in rows}:
        times = sorted(r[2] for r in rows if r[0] == user)
        start, last, n = times[0], times[0], 0
        for t in times:
            if (t - last).total_seconds() >= gap:
                want.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((user, start, last, n))
    found = series.activity_sessions(df, "user_id", "ts", gap)
    assert tuples(found, "user_id", "session_start", "last_event", "events") == sorted(want)


def test_streaks(spark):
    days = {1: [1, 2, 3, 5, 6], 2: [4], 3: [1, 2, 3, 4, 5, 6, 7, 9]}
    rows = [(u, u * 100 + d, ntz(50 * k, d)) for u, ds in days.items() for d in ds for k in range(3)]
    found = series.streaks(spark.createDataFrame(rows, EVENTS), "user_id", "ts")
    assert tuples(found, "user_id", "current_streak", "longest_streak") == [(1, 2, 3), (2, 1, 1), (3, 1, 7)]
    badges = found.select("user_id", series.streak_badges(F.col("longest_streak")).alias("b"))
    assert dict(badges.collect()) == {1: ["Streak 3"], 2: [], 3: ["Streak 3", "Streak 7"]}


def test_calendar_is_dense(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    rows = spark.createDataFrame([(1, 0, ntz(0, 10)), (1, 1, ntz(9, 10)), (1, 2, ntz(0, 4)), (1, 3, ntz(0, 3)), (1, 4, ntz(0, 11))], EVENTS)
    last = F.lit("2024-01-10").cast("date")
    daily = series.daily_counts(rows, "user_id", "ts", last)
    grid = series.dense_calendar(users, daily, "user_id", last)
    assert grid.count() == 14
    counts = {(r.user_id, r.day.day): r.n for r in grid.collect()}
    assert counts[(1, 10)] == 2 and counts[(1, 4)] == 1 and sum(counts.values()) == 3
    total = series.daily_counts(rows, "user_id", "ts", last, total="all").first()
    assert total["all"] == 5 and total["daily"] == [1, 0, 0, 0, 0, 0, 2]


def test_rates(spark):
    rows = [(1, i, ntz(i)) for i in range(61)]
    found = series.over_rate(spark.createDataFrame(rows, EVENTS), "user_id", "ts", limit=59)
    assert tuples(found, "user_id", "window_start", "n") == [(1, ntz(0), 60)]


def test_last_value_with_ids_of_all_sizes(spark):
    from decimal import Decimal

    ids = [1_150_000_000_000_000_000, -(2**63), 2**63 - 1, 5]
    rows = spark.createDataFrame([("m", Decimal(n), ntz(60 + n // 10), i) for n, i in zip((1, 2, 3, 4), ids)], "metric_name string, metric_value decimal(15,4), metric_ts timestamp_ntz, id bigint")
    assert series.metric_buckets(rows).first().last_value == 3
    later = rows.union(spark.createDataFrame([("m", Decimal(9), ntz(61), -(2**63))], rows.schema))
    assert series.metric_buckets(later).first().last_value == 9
