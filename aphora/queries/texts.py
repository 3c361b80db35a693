"""Queries about texts: moods, voices, sharing, sanitizing, search, generated quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.functions import prompts
from aphora.functions import text as t
from aphora.functions import voice as v
from aphora.functions.english import query_stems
from aphora.operators import filters
from aphora.plans import generation, search, sharing, speech
from aphora.queries.registry import AS_OF, SEED, SHARED_CTES, as_of, joined, query
from aphora.sources.model import Model
from aphora.sources.sinks import surrogate_id

# The supplied texts hardly hold the words of the standard patterns, so these queries bring their own.
PATTERNS = v.MoodRules({"peaceful": "hand|heart", "wise": "stand|rest|then", "confident": "the"},
                       {"peaceful": "calm", "wise": "wisdom", "confident": "courage"})
TERMS = ["hand", "rest"]
BASE_URL = "https://quotes.example.org"

_MOOD = """CASE WHEN regexp_matches(lower(text), 'hand|heart') OR list_contains(tags, 'calm') THEN 'peaceful'
    WHEN regexp_matches(lower(text), 'stand|rest|then') OR list_contains(tags, 'wisdom') THEN 'wise'
    WHEN regexp_matches(lower(text), 'the') OR list_contains(tags, 'courage') THEN 'confident' ELSE 'motivational' END"""


def _hex(text: str, size: str) -> str:
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) % {size})"


SHARED_CTES["voiced"] = f"""
  SELECT a.id AS request_id, a.user_id, a.quote_id, u.subscription_tier AS tier, q.mood,
    CASE WHEN {_hex(f"concat('{SEED}g:', CAST(a.id AS STRING))", "2")} = 1 THEN 'feminine' ELSE 'masculine' END AS gender,
    CAST(ceil(length(q.text) / 12) AS BIGINT) AS duration_seconds
  FROM audio a JOIN (SELECT quote_id, text, {_MOOD} AS mood FROM quotes) q ON q.quote_id = a.quote_id
  JOIN users u ON u.user_id = a.user_id"""


@query("mood_classify", f"""
  SELECT quote_id, {_MOOD} AS mood, CASE WHEN regexp_matches(lower(text), 'peace|calm|serene') THEN 'peaceful'
    WHEN regexp_matches(lower(text), 'wisdom|understand|learn') THEN 'wise'
    WHEN regexp_matches(lower(text), 'confident|strong|powerful') THEN 'confident' ELSE 'motivational' END AS short_mood,
    CASE WHEN regexp_matches(lower(text), 'peace|calm|serene|tranquil|quiet|gentle') OR list_contains(tags, 'peace') THEN 'peaceful'
    WHEN regexp_matches(lower(text), 'wisdom|understand|learn|reflect|think') OR list_contains(tags, 'wisdom') THEN 'wise'
    WHEN regexp_matches(lower(text), 'confident|strong|powerful|bold|courage') OR list_contains(tags, 'confidence') THEN 'confident'
    ELSE 'motivational' END AS extended_mood FROM quotes""")
def mood_classify(m: Model) -> DataFrame:
    text, tags = F.col("lowered"), F.col("tags")
    return m.quotes.select("quote_id", "tags", F.lower("text").alias("lowered")).select(
        "quote_id", v.classify_mood(text, tags, PATTERNS).alias("mood"),
        v.classify_mood(text, rules=v.SHORT_RULES).alias("short_mood"),
        v.classify_mood(text, tags, v.EXTENDED_RULES).alias("extended_mood"),
    )


@query("voice_assignment", f"""
  SELECT x.request_id, x.user_id, x.quote_id, x.tier, x.mood, CASE WHEN x.tier <> 'free' THEN o.voice_id END AS voice,
    CASE WHEN x.tier <> 'free' THEN o.tts_voice END AS tts_voice,
    CASE WHEN x.tier = 'pro' THEN 'tts-1-hd' WHEN x.tier = 'standard' THEN 'tts-1' END AS model, x.duration_seconds,
    'audio/mpeg' AS content_type, CASE WHEN x.tier = 'free' THEN 'audio_requires_subscription' END AS audio_denial
  FROM voiced x JOIN (SELECT gender, mood, count(*) AS n FROM voices GROUP BY gender, mood) s ON s.gender = x.gender AND s.mood = x.mood
  JOIN voices o ON o.gender = x.gender AND o.mood = x.mood AND o.pos_in_mood = 1 + {_hex(
      f"concat('{SEED}v:', CAST(x.request_id AS STRING))", "(CASE WHEN x.tier = 'pro' THEN s.n ELSE least(s.n, 2) END)")}""")
def voice_assignment(m: Model) -> DataFrame:
    requests = m.audio.select("id", "user_id", "quote_id")
    return speech.voice_assignment(requests, m.quotes, m.users, rules=PATTERNS, seed=SEED)


@query("voice_catalogue", """
  SELECT u.user_id, o.voice_id, CASE o.voice_id WHEN '' THEN '' ELSE array_to_string(list_transform(string_split(o.voice_id, '_'),
      lambda w: concat(upper(w[1]), w[2:])), ' ') END AS name, o.description,
    CASE WHEN u.subscription_tier = 'pro' THEN 'pro' ELSE 'standard' END AS tier_label, u.subscription_tier AS user_tier,
    CAST(CASE WHEN u.subscription_tier = 'pro' THEN 20 ELSE 6 END AS BIGINT) AS total_count
  FROM users u JOIN voices o ON u.subscription_tier = 'pro' OR (u.subscription_tier = 'standard' AND o.in_standard)""")
def voice_catalogue(m: Model) -> DataFrame:
    return speech.voice_catalogue(m.users, dimensions.voices(m.spark))


@query("voice_details", """
  SELECT a.id, a.voice AS voice_id, coalesce(o.tts_voice, 'alloy') AS tts_voice, coalesce(o.description, 'Human-like AI voice') AS description
  FROM (SELECT a.id, CASE WHEN a.quote_id % 2 = 0 THEN p.voice_id ELSE a.voice_id END AS voice
    FROM audio a JOIN voices p ON p.catalogue_pos = a.quote_id % 20) a LEFT JOIN voices o ON o.voice_id = a.voice""")
def voice_details(m: Model) -> DataFrame:
    """Audio rows, half of which name a catalogue voice, with that voice's details."""
    names = F.array(*[F.lit(row[0]) for row in dimensions.VOICES])
    known = F.element_at(names, (F.col("quote_id") % 20 + 1).cast("int"))
    requests = m.audio.select("id", F.when(F.col("quote_id") % 2 == 0, known).otherwise(F.col("voice_id")).alias("voice_id"))
    return speech.voice_details(requests, dimensions.voices(m.spark))


def _encoded(text: str) -> str:
    for code, mark in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        text = f"replace({text}, '{code}', '{mark}')"
    return text


@query("share_feed", f"""
  SELECT id, user_id, quote_id, platform, found, md5(share_text) AS share_text_md5, share_url,
    md5(CASE platform WHEN 'twitter' THEN 'https://twitter.com/intent/tweet?text=' || et || '&url=' || eu
      WHEN 'facebook' THEN 'https://www.facebook.com/sharer/sharer.php?u=' || eu
      WHEN 'whatsapp' THEN 'https://wa.me/?text=' || et || '%20' || eu ELSE share_url END) AS share_link_md5,
    CASE WHEN NOT found THEN 'quote_not_found' END AS error
  FROM (SELECT *, {_encoded('url_encode(share_text)')} AS et, {_encoded('url_encode(share_url)')} AS eu
    FROM (SELECT s.id, s.user_id, s.quote_id * 13 AS quote_id, s.platform, q.quote_id IS NOT NULL AS found,
      CASE WHEN q.quote_id IS NOT NULL THEN concat('"', q.text, '" - ', q.author) END AS share_text,
      CASE WHEN q.quote_id IS NOT NULL THEN concat('{BASE_URL}/quote/', CAST(s.quote_id * 13 AS STRING)) END AS share_url
    FROM shares s LEFT JOIN quotes q ON q.quote_id = s.quote_id * 13) x) y""")
def share_feed(m: Model) -> DataFrame:
    requests = m.shares.select("id", "user_id", (F.col("quote_id") * 13).alias("quote_id"), "platform")
    feed = sharing.share_feed(requests, m.quotes, BASE_URL)
    return feed.select("id", "user_id", "quote_id", "platform", "found", F.md5("share_text").alias("share_text_md5"), "share_url",
                       F.md5("share_link").alias("share_link_md5"), "error")


@query("encode_texts", f"SELECT doc_id, md5({_encoded('url_encode(text)')}) AS encoded_md5 FROM documents")
def encode_texts(m: Model) -> DataFrame:
    return m.raw("documents").select("doc_id", F.md5(t.encode_component("text")).alias("encoded_md5"))


@query("sanitize_text", """
  SELECT page_id, length(s) AS n_chars, md5(s) AS clean_md5 FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(
    html, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '`', '&#96;'), '$', '&#36;') AS s FROM pages) x""")
def sanitize_text(m: Model) -> DataFrame:
    clean = m.raw("pages").select("page_id", t.sanitize("html").alias("s"))
    return clean.select("page_id", F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("clean_md5"))


@query("endpoint_host", """
  SELECT page_id, concat('GET-', regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS endpoint FROM pages""")
def endpoint_host(m: Model) -> DataFrame:
    return m.raw("pages").select("page_id", t.endpoint_key(F.lit(""), "url").alias("endpoint"))


@query("vector_parse", """
  SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first_value,
    CAST(embedding[len(embedding)] AS DOUBLE) AS last_value FROM embeddings WHERE len(embedding) = 64""")
def vector_parse(m: Model) -> DataFrame:
    """Vectors stored as JSON text, read back."""
    parsed = m.raw("embeddings").select("vec_id", t.vector(F.to_json("embedding"), 64).alias("v")).where(F.col("v").isNotNull())
    return parsed.select("vec_id", F.size("v").alias("n"), F.col("v")[0].cast("double").alias("first_value"),
                         F.element_at("v", -1).cast("double").alias("last_value"))


@query("labels_and_defaults", """
  SELECT quote_id, CASE WHEN score <= 33 THEN '30-50 caractere' WHEN score <= 66 THEN '80-120 caractere' ELSE '150-200 caractere' END
      AS length_label, CASE lang WHEN 'en' THEN 'engleză' ELSE lang END AS language_label,
    CASE WHEN premium THEN array_to_string(tags, ', ') ELSE 'Necunoscute' END AS tag_text FROM quotes""")
def labels_and_defaults(m: Model) -> DataFrame:
    size = F.when(F.col("score") <= 33, "short").when(F.col("score") <= 66, "medium").otherwise("long")
    tags = F.when(F.col("premium"), F.col("tags")).otherwise(F.array().cast("array<string>"))
    return m.quotes.select("quote_id", t.length_label(size).alias("length_label"), t.language_label("lang").alias("language_label"),
                           t.join_or(tags, "Necunoscute").alias("tag_text"))


@query("audio_scalars", """
  SELECT id, CAST(ceil(text_length / 12) AS BIGINT) AS duration_seconds, CASE WHEN quote_id % 2 = 0 THEN 'audio/mpeg' ELSE 'audio/wav' END
    AS content_type, CASE WHEN quote_id % 3 = 0 THEN 'tts-1-hd' ELSE 'tts-1' END AS model,
    CASE WHEN quote_id % 3 = 0 THEN 'all' ELSE 'limited' END AS features FROM audio""")
def audio_scalars(m: Model) -> DataFrame:
    fmt = F.when(F.col("quote_id") % 2 == 0, "mp3").otherwise("wav")
    tier = F.when(F.col("quote_id") % 3 == 0, "pro").otherwise("standard")
    return m.audio.select("id", v.duration_seconds(F.col("text_length")).alias("duration_seconds"), v.content_type(fmt).alias("content_type"),
                          v.speech_model(tier).alias("model"), v.feature_level(tier).alias("features"))


@query("text_search", """
  SELECT quote_id FROM (SELECT quote_id, string_split_regex(lower(concat(text, ' ', author)), '[^\\p{L}\\p{N}]+') AS w FROM quotes) x
  WHERE list_contains(w, 'hand') AND list_contains(w, 'rest')""")
def text_search(m: Model) -> DataFrame:
    return search.search(m.quotes, TERMS).select("quote_id")


@query("text_search_index", """
  SELECT quote_id FROM (SELECT quote_id, string_split_regex(lower(concat(text, ' ', author)), '[^\\p{L}\\p{N}]+') AS w FROM quotes) x
  WHERE list_contains(w, 'hand') AND list_contains(w, 'rest')""")
def text_search_index(m: Model) -> DataFrame:
    return search.search_index(search.inverted_index(m.quotes), TERMS)


# All forms of the two words that share their stems, also such as nobody writes.
_FORMS = {
    "hand": "hand(s|ed|eds|edly|ing|ings|ingly|li|ly|ful|fuls|fulli|fully|fulness|ness|ment)?",
    "rest": "rest(s|ed|eds|edly|ing|ings|ingly|li|ly|ful|fuls|fulli|fully|fulness|ness|ment)?"}
_STEMMED = "SELECT quote_id FROM quotes WHERE " + " AND ".join(
    f"regexp_matches(lower(concat(text, ' ', author)), '(^|[^\\p{{L}}\\p{{N}}])({forms})([^\\p{{L}}\\p{{N}}]|$)')" for forms in _FORMS.values())


@query("text_search_english", _STEMMED)
def text_search_english(m: Model) -> DataFrame:
    """Words in any of their forms; the query's own stop words do not count."""
    return search.search_english(m.quotes, "the hands that rested").select("quote_id")


@query("text_search_english_index", _STEMMED)
def text_search_english_index(m: Model) -> DataFrame:
    return search.search_index(search.inverted_index(m.quotes, english=True), query_stems("Handing, and resting"))


@query("term_frequencies", """
  SELECT term, count(DISTINCT quote_id) AS quotes FROM (SELECT quote_id,
    unnest(string_split_regex(lower(concat(text, ' ', author)), '[^\\p{L}\\p{N}]+')) AS term FROM quotes) x
  WHERE term <> '' GROUP BY term""")
def term_frequencies(m: Model) -> DataFrame:
    return search.inverted_index(m.quotes).groupBy("term").agg(F.count("*").alias("quotes"))


@query("json_needles", """
  SELECT event_id, CAST(k % 4 = 1 AND event_type = 'click' AS BOOLEAN) AS nested, k % 4 = 2 AS number, true AS twice, event_type = 'view' AS item,
    k % 4 = 3 AS broken FROM ev""")
def json_needles(m: Model) -> DataFrame:
    """Which rows' JSON holds needles of objects and lists, in any order and beside anything else."""
    rest = F.col("k") % 4
    tag = F.struct(F.lit("x").alias("a"), F.col("event_type").alias("kind"), F.struct(F.lit(1.5).alias("w"), rest.alias("r")).alias("in"))
    other = F.struct(F.lit("y").alias("a"), F.lit("none").alias("kind"), F.struct(F.lit(2.0).alias("w"), (rest + 10).alias("r")).alias("in"))
    whole = F.struct(F.array(other, tag).alias("tags"), F.array(rest + 0.0, F.lit(7.0)).alias("numbers"), F.lit(None).cast("string").alias("gap"))
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    broken = F.when(rest == 3, F.concat(F.lit("{"), text)).otherwise(text)
    holds = lambda needle: filters.json_contains(text, needle)
    kinds = F.to_json(F.array("event_type", F.lit("z")))
    return m.ev.select(
        "event_id", holds({"tags": [{"kind": "click", "in": {"r": 1}}]}).alias("nested"), holds({"numbers": [2, 7.0]}).alias("number"),
        holds({"tags": [{"a": "y"}, {"a": "x", "in": {}}, {"a": "y"}], "numbers": []}).alias("twice"),
        filters.json_contains(kinds, "view").alias("item"), (~filters.json_contains(broken, {})).alias("broken"))


@query("tag_containment", "SELECT quote_id FROM quotes WHERE list_has_all(tags, ['wisdom', 'src1'])")
def tag_containment(m: Model) -> DataFrame:
    return m.quotes.where(filters.tags_include(F.col("tags"), ["wisdom", "src1"])).select("quote_id")


_PLACE = _hex(f"concat('{SEED}:', CAST(conv_id AS STRING), ':', CAST(turn AS STRING))", "15")
_CATEGORY = f"CASE {_PLACE} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(dimensions.CATEGORY_IDS)) + " END"


@query("category_assign", f"""
  SELECT conv_id, turn, {_CATEGORY} AS category,
    md5(concat('Write an original motivational quote under 120 chars in EN. No author names.', chr(10), 'Theme: ', {_CATEGORY}, ', Tone: inspiring'))
      AS prompt_md5 FROM conversations""")
def category_assign(m: Model) -> DataFrame:
    slots = generation.generation_requests(m.raw("conversations"), ["conv_id", "turn"], seed=SEED)
    message = F.concat_ws("\n", "prompt.system", "prompt.user")
    return slots.select("conv_id", "turn", "category", F.md5(message).alias("prompt_md5"))


@query("generated_batch", f"""
  SELECT CAST(concat('0x', substr(md5(concat(CAST(conv_id AS STRING), '|', CAST(turn AS STRING), '|', body)), 1, 15)) AS BIGINT) AS quote_id,
    body AS text, {_CATEGORY} AS category, 'EN' AS lang, TIMESTAMP '{AS_OF}' AS created_at
  FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM conversations WHERE role = 'assistant') x
  WHERE body <> ''
  UNION ALL SELECT quote_id, text, category, lang, created_at FROM quotes""")
def generated_batch(m: Model) -> DataFrame:
    """Existing quotes and a batch of new ones."""
    answers = m.raw("conversations").where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("completion"))
    new = generation.generated_batch(answers, ["conv_id", "turn"], as_of(), seed=SEED)
    return new.unionByName(m.quotes.select("quote_id", "text", "category", "lang", "created_at"))


@query("surrogate_ids", """
  SELECT event_id, CAST(concat('0x', substr(md5(concat(CAST(user_id AS STRING), '|', event_type)), 1, 15)) AS BIGINT) AS id FROM ev""")
def surrogate_ids(m: Model) -> DataFrame:
    return m.ev.select("event_id", surrogate_id("user_id", "event_type").alias("id"))


@query("completion_udf", """
  SELECT item_id, concat('> ', text) AS completion FROM benchmark""")
def completion_udf(m: Model) -> DataFrame:
    """Texts from an injected function, batch by batch."""
    return generation.complete_with(m.raw("benchmark"), "item_id", "text", lambda texts: [f"> {x}" for x in texts])


@query("mood_prompt", """
  SELECT id, md5(concat('Generate a personalized inspirational quote for someone who:', chr(10), '- Current mood: ', mood, chr(10),
    '- Preferences: {"energy":', CAST(energy_level AS STRING), '}', chr(10), '- Goals: ', array_to_string(triggers, ', '), chr(10),
    '- Make it uplifting and relevant to their situation.')) AS prompt_md5, array_to_string(triggers, ',') AS goals FROM mood_tracking""")
def mood_prompt(m: Model) -> DataFrame:
    prompt = prompts.mood_prompt(F.col("mood"), F.struct(F.col("energy_level").alias("energy")), F.col("triggers"))
    return m.mood_tracking.select("id", F.md5(prompt).alias("prompt_md5"), joined("triggers").alias("goals"))
