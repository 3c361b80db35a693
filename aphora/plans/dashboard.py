"""The engagement dashboard: one row per user, every number computed from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.functions.text import ok_envelope
from aphora.functions.voice import feature_level
from aphora.operators import ranking, relations, series


def voice_habits(audio: DataFrame) -> DataFrame:
    """Audio total and most used voice per user, ties by voice; counted by voice before users are compared."""
    by_voice = ranking.count_by(audio, ["user_id", "voice_id"])
    ranked = F.min(F.struct((-F.col("n")).alias("rank"), F.col("voice_id").alias("voice")))
    return by_voice.groupBy("user_id").agg(
        F.sum("n").alias("audio_generated"), ranked["voice"].alias("most_used_voice")
    )


def preferred_categories(views: DataFrame, n: int = 3) -> DataFrame:
    top = ranking.top_values(views.where(F.col("category").isNotNull()), "user_id", "category", n)
    return ranking.ranked_list(top, "user_id", "position", F.col("category"), "preferred_categories")


def weekly_progress(users: DataFrame, views: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Views per user and day for the last days, zeros included."""
    daily = series.daily_counts(views, "user_id", "created_at", last_day, days)
    return series.dense_calendar(users, daily, "user_id", last_day, days)


def dashboard(users: DataFrame, views: DataFrame, audio: DataFrame, favorites: DataFrame, last_day: Column,
              days: int = 7, n_categories: int = 3) -> DataFrame:
    """Counts, streak, habits, weekly progress and subscription of every user.

    Views are read once and counted by user, day and category; totals, the calendar, streaks and categories all come from
    that small table (its exchange is reused). Views of unknown quotes count, without a category. Every part is reduced to
    one row per user before it joins, and all of them are partitioned by user, so the joins shuffle no events.
    """
    active = views.groupBy("user_id", F.to_date("created_at").alias("day"), "category").agg(F.count("*").alias("n")).where("n > 0")
    age = F.date_diff(last_day, F.col("day"))
    on_day = [F.coalesce(F.sum(F.when(age == days - 1 - i, F.col("n"))), F.lit(0).cast("bigint")) for i in range(days)]
    viewed = active.groupBy("user_id").agg(F.array(*on_day).alias("daily"), F.sum("n").alias("quotes_viewed"))
    liked = ranking.count_by(favorites, ["user_id"], "favorites")
    streak = series.streaks(active, "user_id", "day").select(
        "user_id", F.col("current_streak").alias("streak_days"), "longest_streak"
    )
    # A filter on the category itself would move below the counting, which could then not be shared.
    by_category = active.groupBy("user_id", "category").agg(F.sum(F.when(F.col("category").isNotNull(), F.col("n"))).alias("n")).where("n > 0")
    top = ranking.first_per_key(by_category, ["user_id"], [F.col("n").desc(), F.col("category").asc()], n_categories, "position")
    preferred = ranking.ranked_list(top, "user_id", "position", F.col("category"), "preferred_categories")
    out = users.select("user_id", "subscription_tier", "subscription_status")
    for part in (viewed, voice_habits(audio), liked, streak, preferred):
        out = out.join(part, "user_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "user_id",
        F.coalesce("quotes_viewed", zero).alias("quotes_viewed"),
        F.coalesce("audio_generated", zero).alias("audio_generated"),
        F.coalesce("favorites", zero).alias("favorites"),
        F.coalesce("streak_days", zero).alias("streak_days"),
        F.coalesce("longest_streak", zero).alias("longest_streak"),
        "most_used_voice",
        F.coalesce("preferred_categories", F.array().cast("array<string>")).alias("preferred_categories"),
        F.coalesce("daily", F.array_repeat(zero, days)).alias("weekly_progress"),
        F.col("subscription_tier").alias("tier"),
        F.col("subscription_status").alias("status"),
        feature_level(F.col("subscription_tier")).alias("features"),
    )


def dashboard_response(board: DataFrame) -> DataFrame:
    """The dashboard of each user as the JSON a client receives."""
    analytics = F.struct(
        F.col("quotes_viewed").alias("quotesViewed"), F.col("audio_generated").alias("audioGenerated"), "favorites",
        F.col("streak_days").alias("streakDays"), F.col("most_used_voice").alias("mostUsedVoice"),
        F.col("preferred_categories").alias("preferredCategories"), F.col("weekly_progress").alias("weeklyProgress"),
    )
    return board.select("user_id", ok_envelope(analytics=analytics, subscription=F.struct("tier", "status", "features")).alias("response"))


def plan_usage(users: DataFrame, favorites: DataFrame, audio: DataFrame, plans: DataFrame) -> DataFrame:
    """Use of favorites and audio against the plan's limits; a limit of -1 is unlimited."""
    liked = ranking.count_by(favorites, ["user_id"], "favorites_used")
    heard = ranking.count_by(audio, ["user_id"], "audio_used")
    people = users.select("user_id", F.col("subscription_tier").alias("tier"))
    with_plan = relations.with_dimension(people, plans.select("tier", "max_favorites", "max_audio"), "tier")
    used = with_plan.join(liked, "user_id", "left").join(heard, "user_id", "left")
    used = used.fillna(0, ["favorites_used", "audio_used"])

    def over(limit: str, amount: str) -> Column:
        return (F.col(limit) >= 0) & (F.col(amount) > F.col(limit))

    return used.select(
        "user_id", "tier", "favorites_used", "audio_used", "max_favorites", "max_audio",
        over("max_favorites", "favorites_used").alias("over_favorites"),
        over("max_audio", "audio_used").alias("over_audio"),
        (F.col("tier") != "free").alias("audio_allowed"),
    )
