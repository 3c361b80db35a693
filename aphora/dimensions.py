"""Small fixed dimensions and constants. Everything here has a size fixed in this file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fifteen quote categories with display name and premium flag.
CATEGORIES = [
    ("motivation", "Motivation", False),
    ("focus", "Focus & Productivity", False),
    ("calm", "Calm & Mindfulness", False),
    ("gratitude", "Gratitude", False),
    ("success", "Success & Growth", True),
    ("love", "Love & Relationships", True),
    ("wisdom", "Wisdom & Philosophy", True),
    ("hustle", "Hustle & Ambition", True),
    ("stoicism", "Stoicism", True),
    ("mindset", "Positive Mindset", False),
    ("healing", "Healing & Recovery", True),
    ("life", "Life Lessons", False),
    ("discipline", "Discipline & Consistency", False),
    ("courage", "Courage & Resilience", True),
    ("creativity", "Creativity & Innovation", True),
]
CATEGORY_IDS = [c[0] for c in CATEGORIES]

# Voices in catalogue order as
# (voice, speech engine voice, gender, mood, place among the voices of that gender and mood, on the
# standard plan, description).
VOICES = [
    ("sophia_calm", "nova", "feminine", "peaceful", 1, True, "Calm and nurturing feminine voice"),
    ("maria_energetic", "shimmer", "feminine", "motivational", 1, True, "Energetic and motivational feminine voice"),
    ("elena_wise", "alloy", "feminine", "wise", 1, True, "Wise and thoughtful feminine voice"),
    ("anna_confident", "nova", "feminine", "confident", 1, False, "Confident and strong feminine voice"),
    ("julia_nurturing", "shimmer", "feminine", "wise", 2, False, "Warm and caring feminine voice"),
    ("clara_inspiring", "alloy", "feminine", "confident", 2, False, "Inspiring and uplifting feminine voice"),
    ("luna_peaceful", "nova", "feminine", "peaceful", 2, False, "Peaceful and serene feminine voice"),
    ("maya_powerful", "shimmer", "feminine", "motivational", 2, False, "Powerful and dynamic feminine voice"),
    ("zara_gentle", "alloy", "feminine", "peaceful", 3, False, "Gentle and soothing feminine voice"),
    ("nova_dynamic", "nova", "feminine", "motivational", 3, False, "Dynamic and versatile feminine voice"),
    ("david_strong", "onyx", "masculine", "wise", 2, True, "Strong and authoritative masculine voice"),
    ("marcus_motivational", "echo", "masculine", "motivational", 1, True, "Motivational and inspiring masculine voice"),
    ("alex_calm", "fable", "masculine", "peaceful", 1, True, "Calm and reassuring masculine voice"),
    ("erik_confident", "onyx", "masculine", "confident", 1, False, "Confident and bold masculine voice"),
    ("leo_inspiring", "echo", "masculine", "motivational", 2, False, "Inspiring and uplifting masculine voice"),
    ("noah_grounded", "fable", "masculine", "peaceful", 2, False, "Grounded and stable masculine voice"),
    ("kai_energetic", "echo", "masculine", "motivational", 3, False, "Energetic and enthusiastic masculine voice"),
    ("finn_wise", "onyx", "masculine", "wise", 1, False, "Wise and thoughtful masculine voice"),
    ("zane_powerful", "echo", "masculine", "confident", 2, False, "Powerful and commanding masculine voice"),
    ("ace_gentle", "fable", "masculine", "peaceful", 3, False, "Gentle and warm masculine voice"),
]

# Answers of the voice lookups for an unknown voice, and for a failed selection.
DEFAULT_SPEECH_VOICE = "alloy"
DEFAULT_VOICE_DESCRIPTION = "Human-like AI voice"
FALLBACK_VOICE = "sophia_calm"

# Plans as (tier, name, monthly price, currency, features, favorites, audio quotes, voices,
# premium content, analytics level); a limit of -1 means unlimited.
PLANS = [
    ("free", "Free", "0.00", "USD",
     ["Basic daily quotes", "Limited favorites (50)", "Basic categories", "Community access", "Standard support"],
     50, 0, 0, False, "basic"),
    ("standard", "Standard", "6.49", "USD",
     ["Unlimited daily quotes", "Unlimited favorites", "All categories & moods", "Audio quotes (6 voices)",
      "Social features", "Basic analytics", "Priority support"],
     -1, 50, 6, False, "standard"),
    ("pro", "Pro", "9.49", "USD",
     ["Everything in Standard", "Premium AI voices (20 total)", "HD audio quality", "Premium content library",
      "Advanced analytics & insights", "Mood tracking", "Personal dashboard", "Priority support",
      "Early access to new features"],
     -1, -1, 20, True, "advanced"),
]

# Subscription vocabularies.
TIERS = ["free", "standard", "pro"]
STATUSES = ["inactive", "active", "past_due", "canceled", "unpaid"]
METRIC_TYPES = ["view", "audio_request", "share_click", "time_spent"]

# Log levels from lowest to highest.
LOG_LEVELS = ["debug", "info", "warn", "error", "fatal"]

# Columns of the dimensions, in the order of the rows above.
VOICE_COLUMNS = ["voice_id", "tts_voice", "gender", "mood", "pos_in_mood", "in_standard", "description",
                 "catalogue_pos"]
CATEGORY_COLUMNS = ["category", "category_name", "category_premium"]
PLAN_COLUMNS = ["tier", "name", "price", "currency", "features", "max_favorites", "max_audio", "max_voices",
                "premium_content", "analytics"]


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return f"array({', '.join(_literal(v) for v in value)})"
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return str(value)


def _inline(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal table inside the plan, so that Catalyst knows its exact size."""
    values = ", ".join(f"({', '.join(_literal(v) for v in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def voices(spark: SparkSession) -> DataFrame:
    return _inline(spark, [(*v, pos) for pos, v in enumerate(VOICES)], VOICE_COLUMNS)


def categories(spark: SparkSession) -> DataFrame:
    return _inline(spark, CATEGORIES, CATEGORY_COLUMNS)


def plans(spark: SparkSession) -> DataFrame:
    return _inline(spark, PLANS, PLAN_COLUMNS).withColumn("price", F.col("price").cast("decimal(10,2)"))
