"""Mood rules and voice choice for reading a text aloud."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.functions.text import hashed_position, lookup


@dataclass(frozen=True)
class MoodRules:
    """Moods in order of precedence, each with its word pattern and, if any, the tag that also selects it."""

    patterns: dict[str, str]
    tags: dict[str, str] = field(default_factory=dict)
    default: str = "motivational"


# Word patterns of the moods, short and extended form; the first that matches decides.
SHORT_RULES = MoodRules({
    "peaceful": "peace|calm|serene",
    "wise": "wisdom|understand|learn",
    "confident": "confident|strong|powerful",
})
EXTENDED_RULES = MoodRules(
    {
        "peaceful": "peace|calm|serene|tranquil|quiet|gentle",
        "wise": "wisdom|understand|learn|reflect|think",
        "confident": "confident|strong|powerful|bold|courage",
    },
    {"peaceful": "peace", "wise": "wisdom", "confident": "confidence"},
)


def _mentions(lowered: Column, pattern: str) -> Column:
    """Whether the pattern occurs. Plain alternatives become substring tests, which beat a regular expression."""
    if not re.fullmatch(r"\w+(\|\w+)*", pattern):
        return lowered.rlike(pattern)
    hit = F.lit(False)
    for word in pattern.split("|"):
        hit = hit | lowered.contains(word)
    return hit


def classify_mood(lowered: Column, tags: Column | None = None, rules: MoodRules = EXTENDED_RULES) -> Column:
    """The mood of a text. It must be in lower case: that is done once per text, not once per pattern."""
    mood = F.lit(rules.default)
    for name, pattern in reversed(rules.patterns.items()):
        hit = _mentions(lowered, pattern)
        if tags is not None and name in rules.tags:
            hit = hit | F.coalesce(F.array_contains(tags, rules.tags[name]), F.lit(False))
        mood = F.when(hit, F.lit(name)).otherwise(mood)
    return F.when(lowered.isNotNull(), mood)


def _voice_lists() -> dict[str, list[str]]:
    lists: dict[str, list[str]] = {}
    for voice in sorted(dimensions.VOICES, key=lambda v: v[4]):
        lists.setdefault(f"{voice[2]}/{voice[3]}", []).append(voice[0])
    return lists


def select_voice(mood: Column, tier: Column, *key: Column | str, seed: int = 42) -> Column:
    """A voice of the mood: gender and place in the list follow from the key; below pro the list has two places.

    A missing mood (no text) gives the fallback voice.
    """
    gender = F.when(hashed_position(2, F.lit(f"{seed}g"), *key) == 1, "feminine").otherwise("masculine")
    lists = F.create_map(*[x for name, ids in _voice_lists().items()
                           for x in (F.lit(name), F.array(*[F.lit(i) for i in ids]))])
    options = F.try_element_at(lists, F.concat_ws("/", gender, mood))
    offered = F.when(tier == "pro", options).otherwise(F.slice(options, 1, 2))
    place = hashed_position(F.greatest(F.size(offered), F.lit(1)), F.lit(f"{seed}v"), *key) + 1
    picked = F.when(mood.isNotNull(), F.try_element_at(offered, place))
    return F.coalesce(picked, F.lit(dimensions.FALLBACK_VOICE))


def speech_voice(voice: Column) -> Column:
    names = {v[0]: v[1] for v in dimensions.VOICES}
    return lookup(voice, names, dimensions.DEFAULT_SPEECH_VOICE)


def voice_description(voice: Column) -> Column:
    return lookup(voice, {v[0]: v[6] for v in dimensions.VOICES}, dimensions.DEFAULT_VOICE_DESCRIPTION)


def speech_model(tier: Column) -> Column:
    return F.when(tier == "pro", "tts-1-hd").otherwise("tts-1")


def duration_seconds(length: Column) -> Column:
    """Estimated reading time at twelve characters a second."""
    return F.ceil(length / 12).cast("bigint")


def content_type(fmt: Column) -> Column:
    return F.when(fmt == "mp3", "audio/mpeg").otherwise("audio/wav")


def tier_label(tier: Column) -> Column:
    return F.when(tier == "pro", "pro").otherwise("standard")


def feature_level(tier: Column) -> Column:
    return F.when(tier == "pro", "all").otherwise("limited")
