"""Queries about users: statistics, profile, dashboard, candidates, recommendations, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.operators import filters, ranking, relations, series
from aphora.plans import dashboard as boards
from aphora.plans import profile, recommend
from aphora.queries.registry import AS_OF, LAST_DAY, SEED, SHARED_CTES, as_of, joined, last_day, query
from aphora.sources.model import Model

DEFAULT_CATEGORIES = ["motivation"]
DEFAULT_LANG = "fr"

SHARED_CTES.update({
    "liked_quotes": """
      SELECT f.user_id, q.quote_id, q.text, q.category, q.lang AS language,
        row_number() OVER (PARTITION BY f.user_id ORDER BY f.created_at DESC, f.quote_id) AS position
      FROM favorites f JOIN quotes q ON f.quote_id = q.quote_id""",
    "own_quotes": """
      SELECT user_id, quote_id, text, category, lang, created_at,
        row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, quote_id) AS position
      FROM quotes WHERE user_generated""",
    "category_rank": """
      SELECT user_id, category, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS position
      FROM (SELECT user_id, category, count(*) AS n FROM views GROUP BY user_id, category) c""",
    "wanted_categories": f"""
      SELECT u.user_id, coalesce(u.lang, '{DEFAULT_LANG}') AS lang, coalesce(c.category, '{DEFAULT_CATEGORIES[0]}') AS category
      FROM users u LEFT JOIN (SELECT * FROM category_rank WHERE position <= 5) c ON u.user_id = c.user_id""",
    "candidates": f"""
      SELECT * FROM (SELECT w.user_id, q.quote_id, q.category, q.lang, row_number() OVER (PARTITION BY w.user_id
        ORDER BY md5(concat('{SEED}:', CAST(q.quote_id AS STRING))), q.quote_id) AS position
      FROM wanted_categories w JOIN quotes q ON q.category = w.category AND q.lang = w.lang) c WHERE position <= 20""",
    "activity_runs": """
      SELECT user_id, count(*) AS days, max(d) AS last_day FROM (
        SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS run
        FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM ev) x) y
      GROUP BY user_id, run""",
    "view_runs": """
      SELECT user_id, count(*) AS days, max(d) AS last_day FROM (
        SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS run
        FROM (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS d FROM views) x) y
      GROUP BY user_id, run""",
    "week_days": f"SELECT CAST(unnest(generate_series(DATE '{LAST_DAY}' - 6, DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS day",
    "week_counts": """
      SELECT u.user_id, w.day, count(v.event_id) AS n FROM users u JOIN week_days w ON true
      LEFT JOIN views v ON v.user_id = u.user_id AND CAST(v.created_at AS DATE) = w.day GROUP BY u.user_id, w.day""",
    "boards": """
      SELECT u.user_id, coalesce(a.n, 0) AS quotes_viewed, coalesce(b.n, 0) AS audio_generated,
        coalesce(f.n, 0) AS favorites, coalesce(s.streak, 0) AS streak_days, coalesce(s.longest, 0) AS longest_streak,
        b.voice AS most_used_voice, c.categories AS preferred_categories, k.week AS weekly_progress,
        u.subscription_tier AS tier, u.subscription_status AS status,
        CASE WHEN u.subscription_tier = 'pro' THEN 'all' ELSE 'limited' END AS features
      FROM users u
      LEFT JOIN (SELECT user_id, count(*) AS n FROM views GROUP BY user_id) a ON a.user_id = u.user_id
      LEFT JOIN (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, first(voice_id ORDER BY n DESC, voice_id) AS voice FROM (
        SELECT user_id, voice_id, count(*) AS n FROM audio GROUP BY user_id, voice_id) x GROUP BY user_id) b
        ON b.user_id = u.user_id
      LEFT JOIN (SELECT user_id, count(*) AS n FROM favorites GROUP BY user_id) f ON f.user_id = u.user_id
      LEFT JOIN (SELECT user_id, first(days ORDER BY last_day DESC) AS streak, max(days) AS longest FROM view_runs
        GROUP BY user_id) s ON s.user_id = u.user_id
      LEFT JOIN (SELECT user_id, list(category ORDER BY position) AS categories FROM category_rank WHERE position <= 3
        GROUP BY user_id) c ON c.user_id = u.user_id
      JOIN (SELECT user_id, list(n ORDER BY day) AS week FROM week_counts GROUP BY user_id) k ON k.user_id = u.user_id""",
    "profile_lists": """
      SELECT u.user_id, u.created_at, c.cats, f.liked, p.own, f.n_liked
      FROM users u
      LEFT JOIN (SELECT user_id, string_agg(category, ', ' ORDER BY position) AS cats FROM category_rank
        WHERE position <= 5 GROUP BY user_id) c ON c.user_id = u.user_id
      LEFT JOIN (SELECT user_id, count(*) AS n_liked,
          string_agg(concat('- "', text, '" (', category, ')'), chr(10) ORDER BY position) AS liked
        FROM liked_quotes WHERE position <= 10 GROUP BY user_id) f ON f.user_id = u.user_id
      LEFT JOIN (SELECT user_id, string_agg(concat('- "', text, '" (', category, ')'), chr(10) ORDER BY position) AS own
        FROM own_quotes WHERE position <= 5 GROUP BY user_id) p ON p.user_id = u.user_id""",
})


def _candidates(m: Model) -> DataFrame:
    return recommend.candidate_lists(m.users, m.views, m.quotes, SEED, default_categories=DEFAULT_CATEGORIES,
                                     default_lang=DEFAULT_LANG)


@query("user_stats", """
  SELECT u.user_id, u.email, u.subscription_tier, u.created_at AS registered_at,
    count(DISTINCT f.quote_id) AS total_favorites, count(DISTINCT a.id) AS total_audio_generated,
    max(a.created_at) AS last_audio_generated
  FROM users u LEFT JOIN favorites f ON u.user_id = f.user_id LEFT JOIN audio a ON u.user_id = a.user_id
  GROUP BY u.user_id, u.email, u.subscription_tier, u.created_at""")
def user_stats(m: Model) -> DataFrame:
    return profile.user_stats(m.users, m.favorites, m.audio)


@query("active_subscriptions", """
  SELECT u.user_id, u.email, u.subscription_tier, u.subscription_status, CAST(s.subscription_id AS STRING) AS subscription_id,
    s.status, s.tier, s.period_start
  FROM users u LEFT JOIN subscriptions s ON u.user_id = s.user_id WHERE u.subscription_status = 'active'""")
def active_subscriptions(m: Model) -> DataFrame:
    return profile.active_subscriptions(m.users, m.subscriptions).select(
        "user_id", "email", "subscription_tier", "subscription_status",
        F.col("subscription_id").cast("string").alias("subscription_id"), "status", "tier", "period_start",
    )


@query("favorites_with_quotes", """
  SELECT user_id, quote_id, text, category, language, CAST(position AS INT) AS position
  FROM liked_quotes WHERE position <= 10""")
def favorites_with_quotes(m: Model) -> DataFrame:
    return profile.favorites_with_quotes(m.favorites, m.quotes, 10).select(
        "user_id", "quote_id", "text", "category", "language", "position"
    )


@query("personalized_history", """
  SELECT user_id, quote_id, text, category, lang, created_at, CAST(position AS INT) AS position,
    count(*) OVER (PARTITION BY user_id) AS quote_count
  FROM own_quotes WHERE position <= 20""")
def personalized_history(m: Model) -> DataFrame:
    return profile.personalized_history(m.quotes, 20)


@query("top_categories", """
  SELECT user_id, category, n AS views, CAST(position AS INT) AS position FROM category_rank WHERE position <= 5""")
def top_categories(m: Model) -> DataFrame:
    return profile.top_categories(profile.category_views(m.view_audit), 5)


@query("json_key_presence", """
  SELECT count(*) AS with_key, CAST(count(q.quote_id) AS BIGINT) AS with_value
  FROM ev e LEFT JOIN quotes q ON e.k = q.quote_id WHERE e.event_type = 'view'""")
def json_key_presence(m: Model) -> DataFrame:
    """Views whose category key is there, and those where it also holds a value."""
    strict = profile.category_views(m.view_audit, strict=True)
    return strict.agg(F.count("*").alias("with_key"), F.count("category").alias("with_value"))


@query("user_profile", f"""
  SELECT p.user_id,
    coalesce(CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(p.created_at) // 1000) / 86400000) AS BIGINT), -1) AS account_age,
    coalesce(p.cats, '') AS favorite_categories, coalesce(p.n_liked, 0) AS n_favorites,
    md5(coalesce(p.liked, '')) AS favorites_md5, md5(coalesce(p.own, '')) AS personalized_md5
  FROM profile_lists p""")
def user_profile(m: Model) -> DataFrame:
    found = profile.user_profile(m.users, m.favorites, m.quotes, m.views, as_of())

    def listed(name: str):
        return joined(F.transform(name, lambda q: F.concat(F.lit('- "'), q["text"], F.lit('" ('), q["category"], F.lit(")"))), "\n")

    return found.select(
        "user_id", F.coalesce("account_age", F.lit(-1)).alias("account_age"),
        joined("favorite_categories", ", ").alias("favorite_categories"),
        F.size("favorite_quotes").cast("bigint").alias("n_favorites"),
        F.md5(listed("favorite_quotes")).alias("favorites_md5"), F.md5(listed("personalized_quotes")).alias("personalized_md5"),
    )


@query("candidate_quotes", "SELECT user_id, quote_id, category, lang, CAST(position AS INT) AS position FROM candidates")
def candidate_quotes(m: Model) -> DataFrame:
    return recommend.candidate_rows(_candidates(m))


_ANSWERS = """
  SELECT c.user_id, i, regexp_extract(line, '^(\\d+)\\.\\s+(\\d+)\\s+-\\s+(.+)$', 2) AS number,
    trim(regexp_extract(line, '^(\\d+)\\.\\s+(\\d+)\\s+-\\s+(.+)$', 3)) AS explanation
  FROM (SELECT user_id, unnest(string_split(completion, chr(10))) AS line,
    generate_subscripts(string_split(completion, chr(10)), 1) AS i FROM completions) c
  WHERE regexp_matches(line, '^(\\d+)\\.\\s+(\\d+)\\s+-\\s+(.+)$')"""
SHARED_CTES["answers"] = _ANSWERS
SHARED_CTES["recommended"] = f"""
  SELECT user_id, quote_id, category, lang, explanation, CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, i) AS INT) AS place, part FROM (
    SELECT a.user_id, 0 AS part, a.i, c.quote_id, c.category, c.lang, a.explanation
    FROM answers a JOIN candidates c ON c.user_id = a.user_id AND c.position = TRY_CAST(a.number AS INT)
    UNION ALL
    SELECT c.user_id, 1, c.position, c.quote_id, c.category, c.lang, '{recommend.FILL_EXPLANATION}'
    FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM answers a JOIN candidates d
      ON d.user_id = a.user_id AND d.position = TRY_CAST(a.number AS INT)
      WHERE a.user_id = c.user_id AND d.quote_id = c.quote_id)) r"""


@query("recommendations", """
  SELECT user_id, place, quote_id, category, lang AS language, explanation FROM recommended WHERE part = 0 OR place <= 5""")
def recommendations(m: Model) -> DataFrame:
    return recommend.recommendations(_candidates(m), m.completions, F.lit(5))


@query("recommendation_audit", f"""
  SELECT user_id, 'quote_recommendations' AS action,
    concat('{{"count":5,"recommendationIds":[', string_agg(CAST(quote_id AS STRING), ',' ORDER BY place), ']}}') AS details,
    TIMESTAMP '{AS_OF}' AS created_at
  FROM recommended WHERE part = 0 OR place <= 5 GROUP BY user_id""")
def recommendation_audit(m: Model) -> DataFrame:
    recommended = recommend.recommendations(_candidates(m), m.completions, F.lit(5))
    return recommend.recommendation_audit(recommended, 5, as_of())


# The wording of the request in the statement below.
@query("recommendation_prompt", f"""
  SELECT user_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM (SELECT p.user_id, concat(
    'Analizează profilul utilizatorului și recomandă 5 citate motivaționale care s-ar potrivi cel mai bine cu preferințele și comportamentul său.',
    chr(10), chr(10), 'Profil utilizator:', chr(10), '- Zile consecutive de login: ', CAST(s.streak AS STRING),
    chr(10), '- Total login-uri: ', CAST(s.logins AS STRING), chr(10), '- Vechime cont: ',
    CAST(coalesce(CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(p.created_at) // 1000) / 86400000) AS BIGINT), 0) AS STRING),
    ' zile', chr(10), '- Categorii preferate: ', coalesce(p.cats, 'Necunoscute'),
    chr(10), chr(10), 'Citate favorite anterioare:', chr(10), coalesce(p.liked, ''),
    chr(10), chr(10), 'Citate personalizate generate anterior:', chr(10), coalesce(p.own, ''),
    chr(10), chr(10), 'Citate disponibile pentru recomandare:', chr(10), coalesce(c.listed, ''), chr(10), chr(10),
    'Răspunde cu numerele citatelor recomandate (din lista de citate disponibile) și o scurtă explicație pentru fiecare recomandare. Formatul răspunsului trebuie să fie:',
    chr(10), '1. <număr citat> - <explicație>', chr(10), '2. <număr citat> - <explicație>', chr(10), '...') AS prompt
  FROM profile_lists p
  JOIN (SELECT user_id, first(days ORDER BY last_day DESC) AS streak, CAST(sum(days) AS BIGINT) AS logins
    FROM activity_runs GROUP BY user_id) s ON s.user_id = p.user_id
  LEFT JOIN (SELECT c.user_id, string_agg(concat(CAST(c.position AS STRING), '. "', q.text, '" (', c.category, ')'), chr(10)
    ORDER BY c.position) AS listed FROM candidates c JOIN quotes q ON q.quote_id = c.quote_id GROUP BY c.user_id) c
    ON c.user_id = p.user_id) x""")
def recommendation_prompt(m: Model) -> DataFrame:
    """The prompt of every user that was ever active."""
    islands = series.streak_islands(m.ev, "user_id", "ts")
    logins = islands.groupBy("user_id").agg(F.max_by("days", "last_day").alias("login_streak"), F.sum("days").alias("total_logins"))
    active = m.users.join(logins, "user_id")
    facts = profile.user_facts(active, m.views, as_of()).withColumn("account_age", F.coalesce("account_age", F.lit(0)))
    asked = recommend.candidate_lists(active, m.views, m.quotes, SEED, default_categories=DEFAULT_CATEGORIES,
                                      default_lang=DEFAULT_LANG)
    prompts = recommend.recommendation_prompts(facts, m.favorites, recommend.candidate_rows(asked), m.quotes, 5)
    return prompts.select("user_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


# The wording of the request in the statement below.
@query("personalize_prompt", """
  SELECT request_id, cache_key, md5(prompt) AS prompt_md5 FROM (SELECT r.request_id,
    concat('personalize-', CAST(r.user_id AS STRING), '-["', r.preferences[1], '"]-["', r.topics[1], '","', r.topics[2], '"]-',
      r.style, '-', r.length, '-', r.language) AS cache_key,
    concat('Generează un citat motivațional personalizat cu următoarele caracteristici:', chr(10),
      '- Preferințe utilizator: ', array_to_string(r.preferences, ', '), chr(10), '- Teme de interes: ', array_to_string(r.topics, ', '),
      chr(10), '- Stil: ', r.style, chr(10), '- Lungime: ', CASE r.length WHEN 'short' THEN '30-50 caractere'
        WHEN 'medium' THEN '80-120 caractere' END, chr(10), '- Limba: ',
      CASE r.language WHEN 'ro' THEN 'română' WHEN 'en' THEN 'engleză' ELSE r.language END, chr(10), chr(10),
      CASE WHEN f.texts IS NULL THEN '' ELSE concat('Citate favorite ale utilizatorului (pentru context):', chr(10), f.texts) END,
      chr(10), chr(10), 'Răspunde doar cu citatul generat, fără ghilimele sau alte explicații.') AS prompt
  FROM (SELECT * REPLACE (CASE WHEN style = 'playful' THEN 'motivational' ELSE style END AS style,
    CASE WHEN language = 'ro' THEN 'ro' ELSE language END AS language) FROM personalize_requests WHERE length <> 'long') r LEFT JOIN (SELECT user_id,
    string_agg(concat(CAST(position AS STRING), '. "', text, '"'), chr(10) ORDER BY position) AS texts
    FROM liked_quotes WHERE position <= 5 GROUP BY user_id) f ON f.user_id = r.user_id) x""")
def personalize_prompt(m: Model) -> DataFrame:
    """Requests that lack topics are rejected; style and language may be left to their defaults."""
    body = F.struct(
        "preferences", F.when(F.col("length") != "long", F.col("topics")).alias("topics"),
        F.nullif(F.col("style"), F.lit("playful")).alias("style"), "length", F.nullif(F.col("language"), F.lit("ro")).alias("language"),
    )
    accepted, _ = recommend.accepted_requests(m.personalize_requests.select("request_id", "user_id", body.alias("body")))
    prompts = recommend.personalize_prompts(accepted, m.favorites, m.quotes, 5)
    return prompts.select("request_id", "cache_key", F.md5("prompt").alias("prompt_md5"))


@query("feedback_apply", """
  SELECT user_id, quote_id, coalesce(min(old), min(new)) AS created_at, count(old) = 0 AS is_new FROM (
    SELECT user_id, quote_id, created_at AS old, NULL AS new FROM favorites
    UNION ALL
    SELECT f.user_id, f.quote_id, NULL, f.created_at FROM feedback f JOIN quotes q ON q.quote_id = f.quote_id
    WHERE f.feedback = 'like') x GROUP BY user_id, quote_id""")
def feedback_apply(m: Model) -> DataFrame:
    return recommend.feedback_apply(m.feedback, m.quotes, m.favorites)[1]


@query("feedback_audit", """
  SELECT f.user_id, 'quote_recommendation_feedback' AS action,
    concat('{"quote_id":', CAST(f.quote_id AS STRING), ',"feedback":"', f.feedback, '"}') AS details, f.created_at
  FROM feedback f WHERE f.quote_id IN (SELECT quote_id FROM quotes)""")
def feedback_audit(m: Model) -> DataFrame:
    return recommend.feedback_apply(m.feedback, m.quotes, m.favorites)[0]


@query("feedback_rejected", """
  SELECT event_id, user_id, quote_id FROM feedback WHERE quote_id NOT IN (SELECT quote_id FROM quotes)""")
def feedback_rejected(m: Model) -> DataFrame:
    return recommend.feedback_rows(m.feedback, m.quotes)[1].select("event_id", "user_id", "quote_id")


@query("personal_quotes", """
  SELECT CAST(concat('0x', substr(md5(concat(CAST(user_id AS STRING), '|', CAST(request_id AS STRING), '|', text)), 1, 15)) AS BIGINT)
    AS quote_id, text, category, lang, 0 AS score, user_id, created_at
  FROM (SELECT r.user_id, r.request_id, r.topics[1] AS category, r.language AS lang, r.created_at,
    concat(upper(r.style), ' ', r.topics[1]) AS text FROM personalize_requests r) x""")
def personal_quotes(m: Model) -> DataFrame:
    """Requests answered by an injected text function, stored under their first topic."""
    answers = m.personalize_requests.select(
        "request_id", F.concat(F.lit("  "), F.upper("style"), F.lit(" "), F.try_element_at("topics", F.lit(1)), F.lit("\n")).alias("completion")
    )
    made = recommend.personal_quotes(m.personalize_requests, answers)
    return made.select("quote_id", "text", "category", "lang", "score", "user_id", "created_at")


@query("invalidated_keys", """
  SELECT DISTINCT c.cache_key FROM (SELECT DISTINCT concat('recommendations-', CAST(user_id AS STRING), '-5') AS cache_key,
    CAST(user_id AS STRING) AS u FROM users) c
  JOIN (SELECT DISTINCT CAST(user_id AS STRING) AS p FROM feedback) f ON starts_with(c.u, f.p)""")
def invalidated_keys(m: Model) -> DataFrame:
    keys = m.users.select(F.concat(F.lit("recommendations-"), F.col("user_id").cast("string"), F.lit("-5")).alias("cache_key"))
    return recommend.invalidated_keys(keys, m.feedback.select("user_id").distinct())


@query("quote_of_day", f"""
  SELECT quote_id, text, author FROM quotes WHERE NOT premium AND list_contains(tags, 'wisdom') AND mood = 'calm'
  ORDER BY md5(concat('{SEED}:', CAST(quote_id AS STRING))), quote_id LIMIT 1""")
def quote_of_day(m: Model) -> DataFrame:
    picked = recommend.quote_of_the_day(m.quotes, SEED, category="wisdom", mood="calm", exclude_premium=True)
    return picked.select("quote_id", "text", "author")


@query("quote_of_day_fallback", "SELECT quote_id, text, author FROM quotes ORDER BY quote_id LIMIT 1")
def quote_of_day_fallback(m: Model) -> DataFrame:
    return recommend.quote_of_the_day(m.quotes, SEED, category="no such tag").select("quote_id", "text", "author")


@query("quote_lookup", """
  SELECT f.event_id, f.quote_id, q.author, q.quote_id IS NOT NULL AS found
  FROM feedback f LEFT JOIN quotes q ON q.quote_id = f.quote_id""")
def quote_lookup(m: Model) -> DataFrame:
    asked = m.feedback.select("event_id", "quote_id")
    return relations.find(asked, m.quotes.select("quote_id", "author"), "quote_id")


@query("best_quotes", "SELECT quote_id, author, score FROM quotes ORDER BY score DESC, quote_id LIMIT 100")
def best_quotes(m: Model) -> DataFrame:
    return ranking.highest(m.quotes.select("quote_id", "author", "score"), "score", "quote_id", 100)


@query("quote_sample", f"""
  SELECT category, lang, quote_id, CAST(position AS INT) AS position FROM (SELECT category, lang, quote_id, row_number() OVER (
    PARTITION BY category, lang ORDER BY md5(concat('{SEED}:', CAST(quote_id AS STRING))), quote_id) AS position FROM quotes) x
  WHERE position <= 5""")
def quote_sample(m: Model) -> DataFrame:
    """A repeatable sample of each category and language."""
    ids = m.quotes.select("category", "lang", "quote_id")
    return ranking.sample_per_key(ids, ["category", "lang"], "quote_id", 5, SEED)


@query("dashboard", """
  SELECT user_id, quotes_viewed, audio_generated, favorites, streak_days, longest_streak, most_used_voice,
    coalesce(array_to_string(preferred_categories, ','), '') AS preferred_categories,
    array_to_string(weekly_progress, ',') AS weekly_progress, tier, status, features FROM boards""")
def dashboard(m: Model) -> DataFrame:
    board = boards.dashboard(m.users, m.views, m.audio, m.favorites, last_day())
    return board.withColumns({
        "preferred_categories": joined("preferred_categories"),
        "weekly_progress": joined(F.col("weekly_progress").cast("array<string>")),
    })


@query("dashboard_response", """
  SELECT user_id, concat('{"ok":true,"analytics":{"quotesViewed":', CAST(quotes_viewed AS STRING), ',"audioGenerated":',
    CAST(audio_generated AS STRING), ',"favorites":', CAST(favorites AS STRING), ',"streakDays":', CAST(streak_days AS STRING),
    ',"mostUsedVoice":', coalesce('"' || most_used_voice || '"', 'null'), ',"preferredCategories":[',
    coalesce('"' || array_to_string(preferred_categories, '","') || '"', ''), '],"weeklyProgress":[',
    array_to_string(weekly_progress, ','), ']},"subscription":{"tier":"', tier, '","status":"', status, '","features":"',
    features, '"}}') AS response FROM boards""")
def dashboard_response(m: Model) -> DataFrame:
    return boards.dashboard_response(boards.dashboard(m.users, m.views, m.audio, m.favorites, last_day()))


@query("weekly_progress", "SELECT user_id, CAST(day AS STRING) AS day, n FROM week_counts")
def weekly_progress(m: Model) -> DataFrame:
    return boards.weekly_progress(m.users, m.views, last_day()).withColumn("day", F.col("day").cast("string"))


@query("most_used_voice", """
  SELECT user_id, CAST(sum(n) AS BIGINT) AS audio_generated, first(voice_id ORDER BY n DESC, voice_id) AS most_used_voice
  FROM (SELECT user_id, voice_id, count(*) AS n FROM audio GROUP BY user_id, voice_id) x GROUP BY user_id""")
def most_used_voice(m: Model) -> DataFrame:
    return boards.voice_habits(m.audio)


@query("preferred_categories", """
  SELECT user_id, string_agg(category, ',' ORDER BY position) AS preferred_categories FROM category_rank
  WHERE position <= 3 GROUP BY user_id""")
def preferred_categories(m: Model) -> DataFrame:
    found = boards.preferred_categories(m.views)
    return found.select("user_id", joined("preferred_categories").alias("preferred_categories"))


@query("activity_streak", """
  SELECT user_id, first(days ORDER BY last_day DESC) AS current_streak, max(days) AS longest_streak,
    CAST(max(last_day) AS STRING) AS last_active_day FROM activity_runs GROUP BY user_id""")
def activity_streak(m: Model) -> DataFrame:
    found = series.streaks(m.ev, "user_id", "ts")
    return found.withColumn("last_active_day", F.col("last_active_day").cast("string"))


@query("streak_badges", """
  SELECT user_id, array_to_string(list_transform(list_filter([3, 7, 30], lambda t: t <= longest),
    lambda t: concat('Streak ', CAST(t AS STRING))), ',') AS badges
  FROM (SELECT user_id, max(days) AS longest FROM view_runs GROUP BY user_id) x""")
def streak_badges(m: Model) -> DataFrame:
    found = series.streaks(m.views, "user_id", "created_at")
    return found.select("user_id", joined(series.streak_badges(F.col("longest_streak"))).alias("badges"))


@query("plan_usage", """
  SELECT u.user_id, u.subscription_tier AS tier, coalesce(f.n, 0) AS favorites_used, coalesce(a.n, 0) AS audio_used,
    p.max_favorites, p.max_audio, p.max_favorites >= 0 AND coalesce(f.n, 0) > p.max_favorites AS over_favorites,
    p.max_audio >= 0 AND coalesce(a.n, 0) > p.max_audio AS over_audio, u.subscription_tier <> 'free' AS audio_allowed
  FROM users u JOIN plans p ON p.tier = u.subscription_tier
  LEFT JOIN (SELECT user_id, count(*) AS n FROM favorites GROUP BY user_id) f ON f.user_id = u.user_id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM audio GROUP BY user_id) a ON a.user_id = u.user_id""")
def plan_usage(m: Model) -> DataFrame:
    return boards.plan_usage(m.users, m.favorites, m.audio, dimensions.plans(m.spark))


@query("audio_entitlement", """
  SELECT user_id, subscription_tier <> 'free' AS audio_allowed,
    CASE WHEN subscription_tier = 'free' THEN 'audio_requires_subscription' END AS audio_denial FROM users""")
def audio_entitlement(m: Model) -> DataFrame:
    return filters.audio_entitlement(m.users).select("user_id", "audio_allowed", "audio_denial")
