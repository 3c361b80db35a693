"""Reports over engagement, mood, audio, cache and subscription tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.operators import filters, ranking, relations


def recent_quote_count(quotes: DataFrame, as_of: Column, interval: str = "24 HOURS") -> DataFrame:
    return filters.within(quotes, "created_at", as_of, interval).agg(F.count("*").alias("quote_count"))


def recent_audit(audit: DataFrame, as_of: Column, n: int, interval: str = "24 HOURS") -> DataFrame:
    """The newest audit rows of the last day."""
    return ranking.newest(filters.within(audit, "created_at", as_of, interval), "created_at", "id", n)


def users_by_tier(users: DataFrame) -> DataFrame:
    return ranking.count_by(users, ["subscription_tier", "subscription_status"], "users")


def likes_per_quote(likes: DataFrame) -> DataFrame:
    return ranking.count_by(likes, ["quote_id"], "likes")


def clicks_per_platform(shares: DataFrame) -> DataFrame:
    return shares.groupBy("platform").agg(F.count("*").alias("shares"), F.sum("click_count").alias("clicks"))


def quote_metrics(analytics: DataFrame) -> DataFrame:
    """Metric totals per quote, one column per metric type; the types are known, so none has to be looked up."""
    total = F.sum("metric_value")
    pivoted = analytics.groupBy("quote_id").pivot("metric_type", dimensions.METRIC_TYPES).agg(total)
    return pivoted.select("quote_id", *[
        F.coalesce(F.col(m), F.lit(0).cast("decimal(25,4)")).alias(m) for m in dimensions.METRIC_TYPES
    ])


def voice_usage(audio: DataFrame) -> DataFrame:
    """Generations, characters and estimated seconds per voice."""
    seconds = F.ceil(F.col("text_length") / 12)
    return audio.groupBy("voice_id").agg(
        F.count("*").alias("generations"), F.sum("text_length").alias("characters"),
        F.sum(seconds).cast("bigint").alias("seconds"),
        (F.sum("text_length").cast("double") / F.count("text_length")).alias("avg_length"),
    )


def audio_by_user(audio: DataFrame) -> DataFrame:
    return audio.groupBy("user_id").agg(F.count("*").alias("generations"), F.sum("text_length").alias("characters"))


def mood_distribution(moods: DataFrame) -> DataFrame:
    """Entries and mean energy per user and mood."""
    return moods.groupBy("user_id", "mood").agg(
        F.count("*").alias("entries"),
        (F.sum("energy_level").cast("double") / F.count("energy_level")).alias("avg_energy"),
    )


def mood_triggers(moods: DataFrame) -> DataFrame:
    """How often each trigger was named per mood."""
    return ranking.count_by(moods.select("mood", F.explode("triggers").alias("trigger")), ["mood", "trigger"], "entries")


def cache_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits, misses and hit rates of a cache log; a rate without any access is zero.

    A hit counts as an AI hit when the entry is flagged so; a miss counts as an AI miss by its key prefix.
    """
    hit = F.col("hit")
    counts = log.groupBy(*(by or [])).agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
        F.count_if(hit & F.col("is_ai")).alias("ai_hits"),
        F.count_if(~hit & F.col("cache_key").startswith("ai:")).alias("ai_misses"),
    )

    def rate(hits: str, misses: str) -> Column:
        return F.col(hits) / F.greatest(F.col(hits) + F.col(misses), F.lit(1))

    return counts.withColumns({"hit_rate": rate("hits", "misses"), "ai_hit_rate": rate("ai_hits", "ai_misses")})


def collection_quotes(collections: DataFrame, members: DataFrame, quotes: DataFrame, public_only: bool = True) -> DataFrame:
    """The quotes of each (public) collection."""
    shown = filters.public_collections(collections) if public_only else collections
    return shown.select("collection_id").join(members, "collection_id").join(
        quotes.select("quote_id", "author", "lang"), "quote_id"
    )


def collection_items(collections: DataFrame, quotes: DataFrame, items: str = "items", key: str = "id") -> DataFrame:
    """Collections that list their quotes in a column, one row per quote."""
    listed = collections.select(F.col(key).alias("collection_id"), F.explode(items).alias("quote_id"))
    return listed.join(quotes, "quote_id")


def quotes_with_category(quotes: DataFrame, categories: DataFrame) -> DataFrame:
    """Quotes with the display name of their category; unknown categories keep an empty name."""
    return relations.with_dimension(quotes, categories, "category")
