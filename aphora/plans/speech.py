"""Voice assignment for audio requests and the voice catalogue per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.functions import voice as v
from aphora.functions.text import display_name, utf16_length
from aphora.operators import filters, ranking, relations


def quote_moods(quotes: DataFrame, rules: v.MoodRules = v.EXTENDED_RULES) -> DataFrame:
    """Mood and text length of each quote. Texts are read here once and travel no further."""
    lowered = quotes.withColumn("_lower", F.lower("text"))
    mood = v.classify_mood(F.col("_lower"), F.col("tags") if rules.tags else None, rules)
    return lowered.select("quote_id", mood.alias("mood"), utf16_length("text").alias("text_length"))


def voice_assignment(requests: DataFrame, quotes: DataFrame, users: DataFrame, request_id: str = "id",
                     rules: v.MoodRules = v.EXTENDED_RULES, seed: int = 42, fmt: str = "mp3") -> DataFrame:
    """Voice, speech model and estimated duration of every audio request; free users are refused.

    A request may name its voice in ``voice_id``; otherwise the mood of the quote decides, and the fallback voice speaks for
    a quote that is not known. Requests of unknown users are refused.
    """
    people = filters.audio_entitlement(users).select("user_id", F.col("subscription_tier").alias("tier"), "audio_allowed",
                                                     "audio_denial")
    moods = quote_moods(quotes, rules)
    asked = requests.select(F.col(request_id).alias("request_id"), "user_id", "quote_id",
                            *(["voice_id"] if "voice_id" in requests.columns else []))
    joined = asked.join(moods, "quote_id", "left").join(people, "user_id", "left")
    chosen = v.select_voice(F.col("mood"), F.col("tier"), "request_id", seed=seed)
    if "voice_id" in requests.columns:
        chosen = F.coalesce(F.nullif(F.col("voice_id"), F.lit("")), chosen)
    allowed = F.coalesce("audio_allowed", F.lit(False))
    voiced = joined.withColumn("voice", F.when(allowed, chosen))
    denial = F.when(F.col("audio_allowed").isNull(), F.lit("unknown_user")).otherwise(F.col("audio_denial"))
    return voiced.select(
        "request_id", "user_id", "quote_id", "tier", "mood", "voice",
        F.when(allowed, v.speech_voice(F.col("voice"))).alias("tts_voice"),
        F.when(allowed, v.speech_model(F.col("tier"))).alias("model"),
        v.duration_seconds(F.col("text_length")).alias("duration_seconds"),
        v.content_type(F.lit(fmt)).alias("content_type"),
        denial.alias("audio_denial"),
    )


def voice_catalogue(users: DataFrame, voices: DataFrame) -> DataFrame:
    """The voices each user may choose: all for pro, the standard ones for standard, none for free."""
    offers = voices.withColumn("tier", F.explode(
        F.when(F.col("in_standard"), F.array(F.lit("pro"), F.lit("standard"))).otherwise(F.array(F.lit("pro")))
    ))
    # The total depends on the tier alone, so it is counted over the fixed table, not per user.
    totals = ranking.count_by(offers, ["tier"], "total_count")
    offers = offers.join(F.broadcast(totals), "tier")
    people = users.select("user_id", F.col("subscription_tier").alias("tier"))
    return relations.with_dimension(people, offers, "tier", "inner").select(
        "user_id", "voice_id", display_name("voice_id").alias("name"), "description",
        v.tier_label(F.col("tier")).alias("tier_label"), F.col("tier").alias("user_tier"), "total_count",
    )


def voice_details(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests with the speech voice and description of their voice, defaults for unknown ones."""
    known = voices.select("voice_id", "tts_voice", "description")
    joined = relations.with_dimension(requests, known, "voice_id")
    return joined.withColumns({
        "tts_voice": F.coalesce("tts_voice", F.lit(dimensions.DEFAULT_SPEECH_VOICE)),
        "description": F.coalesce("description", F.lit(dimensions.DEFAULT_VOICE_DESCRIPTION)),
    })
