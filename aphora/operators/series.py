"""Time-series operators: daily calendars, streaks, sessions, rolling counts and buckets.

A user can own a third of all events, so none of these sorts a user's raw events in one task. Each first
reduces them to days, gap-sized buckets or minutes, with partial aggregation before the shuffle; what is
left per user is bounded by the calendar, not by the traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, user: str, at: str, last_day: Column, days: int = 7, total: str | None = None) -> DataFrame:
    """One row per user with the counts of the last days, oldest first, zeros included, as a list.

    With ``total`` the same pass also counts all events of the user; without it older events are not read.
    """
    age = F.date_diff(last_day, F.to_date(at))
    aged = events.select(user, age.alias("age"))
    counts = [F.array(*[F.count_if(F.col("age") == days - 1 - i) for i in range(days)]).alias("daily")]
    if total:
        counts.append(F.count("*").alias(total))
    else:
        first = F.date_sub(last_day, days - 1)
        aged = events.where(F.col(at).between(first, F.date_add(last_day, 1))).select(user, age.alias("age"))
    return aged.groupBy(user).agg(*counts)


def dense_calendar(users: DataFrame, daily: DataFrame, user: str, last_day: Column, days: int = 7) -> DataFrame:
    """The lists of :func:`daily_counts` as one row per user and day, for every user."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), days)
    joined = users.select(user).join(daily, user, "left")
    rows = joined.select(user, F.posexplode(F.coalesce("daily", zeros)).alias("_i", "n"))
    return rows.select(user, F.date_add(last_day, F.col("_i") - (days - 1)).alias("day"), "n")


def streak_islands(events: DataFrame, user: str, at: str) -> DataFrame:
    """Runs of consecutive active days per user."""
    days = events.select(user, F.to_date(at).alias("d")).distinct()
    run = F.date_sub("d", F.row_number().over(W.partitionBy(user).orderBy("d")))
    return days.withColumn("_run", run).groupBy(user, "_run").agg(
        F.count("*").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"),
    ).drop("_run")


def streaks(events: DataFrame, user: str, at: str) -> DataFrame:
    """The current streak (the run that ends on the last active day) and the longest one."""
    return streak_islands(events, user, at).groupBy(user).agg(
        F.max_by("days", "last_day").alias("current_streak"),
        F.max("days").alias("longest_streak"),
        F.max("last_day").alias("last_active_day"),
    )


# Streak lengths that earn a badge.
BADGE_DAYS = [3, 7, 30]


def streak_badges(longest: Column, thresholds: list[int] = BADGE_DAYS) -> Column:
    """``Streak n`` for every threshold reached."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= longest)
    return F.transform(reached, lambda t: F.concat(F.lit("Streak "), t.cast("string")))


def _micros(at: str | Column) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def _seconds(gap_seconds: int) -> int:
    return gap_seconds * 1_000_000


def activity_sessions(events: DataFrame, user: str, at: str, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of activity: a new one starts after an idle gap of at least the given length.

    Events inside one bucket of the gap's width always share a session, so the buckets, not the events,
    are sorted per user.
    """
    gap = _seconds(gap_seconds)
    stamped = events.select(user, F.col(at).alias("_t"), F.floor(_micros(at) / gap).alias("_bucket"))
    buckets = stamped.groupBy(user, "_bucket").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n"),
    )
    by_time = W.partitionBy(user).orderBy("_bucket")
    idle = _micros("_first") - _micros(F.lag("_last").over(by_time))
    starts = F.when(idle < gap, 0).otherwise(1)
    numbered = buckets.withColumn("_start", starts).withColumn("session_no", F.sum("_start").over(by_time))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_first").alias("session_start"), F.max("_last").alias("last_event"), F.sum("_n").alias("events"),
    )


def tumbling_counts(events: DataFrame, key: str, at: str, width: str = "1 minute") -> DataFrame:
    """Events per key and window."""
    window = F.window(F.col(at), width)
    return events.groupBy(key, window.alias("_w")).agg(F.count("*").alias("n")).select(
        key, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n"
    )


def over_rate(events: DataFrame, key: str, at: str, limit: int = 100, width: str = "1 minute") -> DataFrame:
    """Windows in which a key exceeded the rate."""
    return tumbling_counts(events, key, at, width).where(F.col("n") > limit)


def rolling_counts(events: DataFrame, key: str, at: str, identifier: str, span_seconds: int = 900,
                   bucket_seconds: int = 60) -> DataFrame:
    """For every event, how many events its key had in the span that ends with it, itself included.

    That number is arrivals so far minus arrivals that have left the span. Both are running totals: every
    event adds one at its time and takes one away when the span has passed. Totals per bucket are carried
    forward over the (few) buckets of a key; within a bucket rows are sorted on their own, so a hot key is
    spread over as many tasks as it has busy buckets.
    """
    span, width = _seconds(span_seconds), _seconds(bucket_seconds)
    arrivals = events.select(key, identifier, F.col(at), _micros(at).alias("_t"), F.lit(1).alias("_step"))
    departures = arrivals.select(key, identifier, at, (F.col("_t") + span).alias("_t"), F.lit(-1).alias("_step"))
    steps = arrivals.unionByName(departures).withColumn("_bucket", F.floor(F.col("_t") / width))

    totals = steps.groupBy(key, "_bucket").agg(F.sum("_step").alias("_total"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(key, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))

    # Arrivals sort before departures of the same instant: the span includes both of its ends.
    inside = W.partitionBy(key, "_bucket").orderBy(F.col("_t"), F.col("_step").desc())
    running = steps.withColumn("_running", F.sum("_step").over(inside)).where("_step = 1")
    return running.join(carried, [key, "_bucket"]).select(
        key, identifier, at, (F.col("_running") + F.col("_carried")).alias("attempts")
    )


def brute_force(events: DataFrame, key: str, at: str, identifier: str, threshold: int = 5,
                span_seconds: int = 900, bucket_seconds: int = 60) -> DataFrame:
    """Events that bring their key to the threshold within the span."""
    counted = rolling_counts(events, key, at, identifier, span_seconds, bucket_seconds)
    return counted.where(F.col("attempts") >= threshold)


def metric_buckets(metrics: DataFrame, width: str = "1 hour") -> DataFrame:
    """Minimum, maximum, mean and last value per metric and time bucket; the last by time, then id.

    Time and id form one number: ordering by a struct would replace the hash aggregation by a sort of all rows.
    """
    window = F.window("metric_ts", width)
    # Ids use all 64 bits: shifted to be positive, they stay below the factor of the time.
    shifted = F.col("id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    place = _micros("metric_ts").cast("decimal(17,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + shifted
    grouped = metrics.groupBy("metric_name", window.alias("_w")).agg(
        F.min("metric_value").alias("min_value"), F.max("metric_value").alias("max_value"),
        F.sum("metric_value").alias("_sum"), F.count("metric_value").alias("n"),
        F.max_by("metric_value", place.cast("decimal(38,0)")).alias("last_value"),
    )
    mean = F.col("_sum").cast("double") / F.col("n")
    return grouped.select("metric_name", F.col("_w.start").alias("bucket_start"), "min_value", "max_value",
                          mean.alias("avg_value"), "last_value", "n")
