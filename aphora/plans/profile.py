"""User statistics, subscriptions and the profile used for recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.functions.text import account_age_days
from aphora.operators import filters, ranking


def user_stats(users: DataFrame, favorites: DataFrame, audio: DataFrame) -> DataFrame:
    """Favorites and audio totals per user.

    Each side is counted on its own before it meets the users: joining both first would multiply a user's
    favorites with their audio rows only to count them distinctly again.
    """
    liked = ranking.count_by(favorites, ["user_id"], "total_favorites")
    heard = audio.groupBy("user_id").agg(
        F.count("*").alias("total_audio_generated"), F.max("created_at").alias("last_audio_generated")
    )
    joined = users.join(liked, "user_id", "left").join(heard, "user_id", "left")
    return joined.select(
        "user_id", "email", "subscription_tier", F.col("created_at").alias("registered_at"),
        F.coalesce("total_favorites", F.lit(0)).alias("total_favorites"),
        F.coalesce("total_audio_generated", F.lit(0)).alias("total_audio_generated"),
        "last_audio_generated",
    )


def active_subscriptions(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Active users, one row per subscription, also those without one."""
    return filters.with_status(users).join(subscriptions, "user_id", "left")


def favorites_with_quotes(favorites: DataFrame, quotes: DataFrame, n: int = 10) -> DataFrame:
    """The newest favorites of each user with text and category.

    Favorites of unknown quotes do not count, so they are dropped by id before the newest are chosen; the
    texts join only the few rows that remain.
    """
    known = favorites.join(quotes.select("quote_id"), "quote_id", "left_semi")
    latest = ranking.latest_per_key(known, ["user_id"], "created_at", "quote_id", n, "position")
    return latest.join(quotes.select("quote_id", "text", "category", F.col("lang").alias("language")), "quote_id")


def personalized_history(quotes: DataFrame, n: int = 20) -> DataFrame:
    """The newest quotes made for each user, with their number."""
    own = filters.user_generated(quotes).select("user_id", "quote_id", "text", "category", "lang", "created_at")
    latest = ranking.latest_per_key(own, ["user_id"], "created_at", "quote_id", n, "position")
    return ranking.with_group_size(latest, "user_id", "quote_count")


def category_views(audit: DataFrame, strict: bool = False) -> DataFrame:
    """User and category of every quote view in the audit log.

    Views without a category do not count. ``strict`` keeps those whose category is JSON null, as a bare
    key-presence test would; their category is then null.
    """
    present = filters.has_json_key_strict if strict else filters.has_json_key
    seen = audit.where((F.col("action") == "quote_view") & present(F.col("details"), "category"))
    return seen.select("user_id", F.get_json_object("details", "$.category").alias("category"), "created_at")


def top_categories(views: DataFrame, n: int = 5) -> DataFrame:
    return ranking.top_values(views.where(F.col("category").isNotNull()), "user_id", "category", n, count="views")


def list_rows(favorites: DataFrame, quotes: DataFrame, n_favorites: int = 10, n_personalized: int = 5) -> DataFrame:
    """The quotes of a profile by id: user_id, list, position, quote_id. No text is read."""
    known = favorites.join(quotes.select("quote_id"), "quote_id", "left_semi")
    liked = ranking.latest_per_key(known, ["user_id"], "created_at", "quote_id", n_favorites, "position")
    made = filters.user_generated(quotes).select("user_id", "quote_id", "created_at")
    own = ranking.latest_per_key(made, ["user_id"], "created_at", "quote_id", n_personalized, "position")
    named = [rows.select("user_id", F.lit(name).alias("list"), "position", "quote_id") for name, rows in (("favorite_quotes", liked), ("personalized_quotes", own))]
    return named[0].unionByName(named[1])


def quote_lists(rows: DataFrame, quotes: DataFrame, lists: list[str]) -> DataFrame:
    """One row per user with the named lists of quotes in order. The texts of all lists are read, and joined, once."""
    texts = quotes.select("quote_id", "text", "category", F.col("lang").alias("language"))
    placed = F.struct("position", F.struct("text", "category", "language").alias("quote"))

    def listed(name: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("list") == name, placed)))
        return F.transform(found, lambda x: x["quote"]).alias(name)

    return rows.join(texts, "quote_id").groupBy("user_id").agg(*[listed(name) for name in lists])


def user_facts(users: DataFrame, views: DataFrame, as_of: Column, n_categories: int = 5) -> DataFrame:
    """Users with account age and favorite categories."""
    categories = ranking.ranked_list(top_categories(views, n_categories), "user_id", "position", F.col("category"), "favorite_categories")
    return users.join(categories, "user_id", "left").withColumns({
        "account_age": account_age_days("created_at", as_of),
        "favorite_categories": F.coalesce("favorite_categories", F.array().cast("array<string>")),
    })


def with_lists(facts: DataFrame, rows: DataFrame, quotes: DataFrame, lists: list[str]) -> DataFrame:
    """Users with the named lists of quotes, empty where they have none."""
    none = F.array().cast("array<struct<text:string,category:string,language:string>>")
    joined = facts.join(quote_lists(rows, quotes, lists), "user_id", "left")
    return joined.withColumns({name: F.coalesce(name, none) for name in lists})


def user_profile(users: DataFrame, favorites: DataFrame, quotes: DataFrame, views: DataFrame, as_of: Column,
                 n_favorites: int = 10, n_personalized: int = 5, n_categories: int = 5) -> DataFrame:
    """One row per user: account age, favorite categories, newest favorites and newest personal quotes."""
    facts = user_facts(users, views, as_of, n_categories)
    return with_lists(facts, list_rows(favorites, quotes, n_favorites, n_personalized), quotes, ["favorite_quotes", "personalized_quotes"])
