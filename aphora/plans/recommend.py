"""Quote of the day, candidates, recommendations, feedback and personal quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.functions import prompts
from aphora.functions.text import SPACE, cache_key, completion_text, hashed_order, non_empty_or, text_or, trim
from aphora.operators import filters, lifecycle, quality, ranking, relations
from aphora.plans import profile
from aphora.sources import sinks

# Category and language for users without any, and the explanation of a filled-up place.
DEFAULT_CATEGORIES = ["Motivation"]
DEFAULT_LANG = "ro"
FILL_EXPLANATION = "Recomandat pe baza preferințelor tale"

# Fixed value: the form of one answer line, "place. quote number - explanation". A line break of any kind
# ends the explanation, and nothing may follow it.
ANSWER_LINE = (
    rf"^([0-9]+)\.{SPACE}+([0-9]+){SPACE}+-{SPACE}+([^\n\r\x{{2028}}\x{{2029}}]+)\z"
)


def quote_of_the_day(quotes: DataFrame, seed: int, category: str | None = None, mood: str | None = None,
                     exclude_premium: bool = False) -> DataFrame:
    """One repeatable pick among the quotes that pass the filters, or the first quote if none does.

    The pick sees ids only. Its id is a scalar subquery of the final read, so it reaches the scan as a filter and
    only the row group that holds the quote is read with its text.
    """
    ids = filters.quote_filter(quotes, category, mood, exclude_premium).select("quote_id")
    pick = ids.orderBy(hashed_order(seed, "quote_id"), "quote_id").limit(1).withColumn("priority", F.lit(0))
    fallback = quotes.select("quote_id").orderBy("quote_id").limit(1).withColumn("priority", F.lit(1))
    winner = pick.unionByName(fallback).orderBy("priority").limit(1)
    return quotes.where(F.col("quote_id") == winner.select("quote_id").scalar())


def candidate_lists(users: DataFrame, views: DataFrame, quotes: DataFrame, seed: int, n: int = 20,
                    n_categories: int = 5, default_categories: list[str] = DEFAULT_CATEGORIES,
                    default_lang: str = DEFAULT_LANG) -> DataFrame:
    """Up to n quotes per user, drawn from the user's top categories in the user's language, as one list.

    The draw orders quotes by a hash that does not depend on the user. A user's n smallest are therefore among
    the n smallest of each (category, language), and keeping only those before the join changes nothing: the
    pool is one list of n ids per category and language, whatever the size of a category. A user merges at most
    ``n_categories`` such lists.
    """
    top = ranking.ranked_list(profile.top_categories(views, n_categories), "user_id", "position", F.col("category"), "top")
    wanted = users.select("user_id", text_or("lang", default_lang).alias("lang")).join(top, "user_id", "left")
    wanted = wanted.select("user_id", "lang", F.explode(non_empty_or("top", default_categories)).alias("category"))

    keyed = quotes.select("quote_id", "category", "lang", hashed_order(seed, "quote_id").alias("draw"))
    drawn = ranking.first_per_key(keyed, ["category", "lang"], ["draw", "quote_id"], n)
    pool = drawn.groupBy("category", "lang").agg(F.collect_list(F.struct("draw", "quote_id", "category", "lang")).alias("pool"))

    merged = wanted.join(pool, ["category", "lang"]).groupBy("user_id").agg(F.flatten(F.collect_list("pool")).alias("drawn"))
    chosen = F.slice(F.sort_array("drawn"), 1, n)
    item = lambda c: F.struct(c["quote_id"].alias("quote_id"), c["category"].alias("category"), c["lang"].alias("lang"))
    return merged.select("user_id", F.transform(chosen, item).alias("candidates"))


def candidate_rows(lists: DataFrame) -> DataFrame:
    """The lists of :func:`candidate_lists` as one row per candidate."""
    rows = lists.select("user_id", F.posexplode("candidates").alias("_i", "c"))
    return rows.select("user_id", "c.quote_id", "c.category", "c.lang", (F.col("_i") + 1).alias("position"))


def parse_answer(completion: Column) -> Column:
    """Quote number and explanation of every well-formed line of an answer, in order."""
    def read(line: Column) -> Column:
        return F.struct(
            F.regexp_extract(line, ANSWER_LINE, 2).try_cast("int").alias("number"),
            trim(F.regexp_extract(line, ANSWER_LINE, 3)).alias("explanation"),
        )

    lines = F.split(trim(completion), "\n")
    return F.transform(F.filter(lines, lambda line: line.rlike(ANSWER_LINE)), read)


def recommendations(candidates: DataFrame, completions: DataFrame, count: Column) -> DataFrame:
    """Turn answers into recommendation lists, given the candidate lists.

    Named candidates keep the order of the answer; they may repeat and may exceed the count. A list that is
    shorter is filled with candidates not named yet, as long as there are any. Candidates (at most n) and the
    lines of one answer are short lists, so after one join by user everything happens within a row.
    """
    joined = candidates.join(completions, "user_id", "left")
    named = F.filter(
        F.coalesce(parse_answer(F.col("completion")), F.array().cast("array<struct<number:int,explanation:string>>")),
        lambda a: (a["number"] >= 1) & (a["number"] <= F.size("candidates")),
    )
    joined = joined.withColumn("_named", named)

    def pick(a: Column) -> Column:
        return F.struct(F.element_at("candidates", a["number"]).alias("quote"), a["explanation"].alias("explanation"))

    joined = joined.withColumn("_parsed", F.transform("_named", pick))
    rest = F.filter("candidates", lambda c: ~F.exists("_parsed", lambda p: p["quote"]["quote_id"] == c["quote_id"]))
    needed = F.greatest(count - F.size("_parsed"), F.lit(0)).cast("int")
    filled = F.transform(
        F.slice(rest, F.lit(1), needed),
        lambda c: F.struct(c.alias("quote"), F.lit(FILL_EXPLANATION).alias("explanation")),
    )
    rows = joined.select("user_id", F.posexplode(F.concat("_parsed", filled)).alias("_i", "r"))
    return rows.select(
        "user_id", (F.col("_i") + 1).alias("place"), F.col("r.quote.quote_id").alias("quote_id"),
        F.col("r.quote.category").alias("category"), F.col("r.quote.lang").alias("language"),
        F.col("r.explanation").alias("explanation"),
    )


def recommendation_audit(recommended: DataFrame, count: int, at: Column) -> DataFrame:
    """The audit row of each user's recommendations."""
    ids = ranking.ranked_list(recommended, "user_id", "place", F.col("quote_id"), "recommendationIds")
    rows = ids.withColumns({"count": F.lit(count), "created_at": at})
    return sinks.audit_rows(rows, "quote_recommendations", ["count", "recommendationIds"])


def recommendation_prompts(facts: DataFrame, favorites: DataFrame, candidates: DataFrame, quotes: DataFrame, count: int = 5) -> DataFrame:
    """The request text of each user, with the quotes of the profile and the candidates.

    ``facts`` are users as ``profile.user_facts`` gives them, with ``login_streak`` and ``total_logins`` besides. The texts of
    all three lists come from one join.
    """
    offered = candidates.select("user_id", F.lit("candidates").alias("list"), "position", "quote_id")
    rows = profile.list_rows(favorites, quotes).unionByName(offered)
    lists = ["favorite_quotes", "personalized_quotes", "candidates"]
    joined = profile.with_lists(facts, rows.join(facts.select("user_id"), "user_id", "left_semi"), quotes, lists)
    prompt = prompts.recommendation_prompt(
        F.lit(count), F.col("login_streak"), F.col("total_logins"), F.col("account_age"), F.col("favorite_categories"),
        *[F.col(name) for name in lists],
    )
    return joined.select("user_id", prompt.alias("prompt"))


def accepted_requests(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Personalisation requests that meet the rules, with defaults filled in, and the rejected ones with reasons."""
    good, rejected = quality.split_valid(quality.validate(requests, {body: quality.PERSONALIZE_RULES}))
    fields = quality.PERSONALIZE_RULES.properties
    others = [c for c in requests.columns if c != body]
    return good.select(*others, *[F.col(f"{body}__clean.{f}").alias(f) for f in fields]), rejected.select(*others, "errors")


def personalize_prompts(requests: DataFrame, favorites: DataFrame, quotes: DataFrame, n: int = 5) -> DataFrame:
    """The request text of each personalisation request, with the user's newest favorites as context."""
    latest = profile.favorites_with_quotes(favorites, quotes, n)
    texts = ranking.ranked_list(latest, "user_id", "position", F.col("text"), "favorite_texts")
    joined = requests.join(texts, "user_id", "left")
    prompt = prompts.personalize_prompt(
        F.col("preferences"), F.col("topics"), F.col("style"), F.col("length"), F.col("language"),
        F.coalesce("favorite_texts", F.array().cast("array<string>")),
    )
    key = cache_key(F.lit("personalize"), F.col("user_id"), F.to_json("preferences"), F.to_json("topics"), "style",
                    "length", "language")
    return joined.withColumns({"prompt": prompt, "cache_key": key}).drop("favorite_texts")


def personal_quotes(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Quotes made for users: answers joined to their requests, stored under the first topic."""
    answered = requests.join(completions, "request_id").withColumn("text", completion_text("completion"))
    answered = answered.where(F.col("text").isNotNull())
    return answered.select(
        sinks.surrogate_id("user_id", "request_id", "text").alias("quote_id"), "text",
        F.try_element_at("topics", F.lit(1)).alias("category"), F.col("language").alias("lang"), F.lit(0).alias("score"),
        F.lit(True).alias("user_generated"), "user_id", "created_at",
    )


def feedback_rows(feedback: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on quotes that exist, and feedback that is rejected because its quote does not."""
    return relations.existing(feedback, quotes, "quote_id"), relations.missing(feedback, quotes, "quote_id")


def feedback_apply(feedback: DataFrame, quotes: DataFrame, favorites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows of the accepted feedback, and the favorites after likes were added."""
    accepted, _ = feedback_rows(feedback, quotes)
    audit = sinks.audit_rows(accepted, "quote_recommendation_feedback", ["quote_id", "feedback"])
    likes = relations.existing(feedback.where(F.col("feedback") == "like"), quotes, "quote_id")
    return audit, lifecycle.insert_if_absent(favorites, likes, ["user_id", "quote_id"], "created_at")


def invalidated_keys(cache: DataFrame, users: DataFrame, key: str = "cache_key") -> DataFrame:
    """Cached recommendations of users who gave feedback.

    The prefix ``recommendations-<user>`` also matches users whose id merely starts with the same digits; every
    leading part of the number in a key is tried, which keeps the join an equality.
    """
    digits = F.regexp_extract(F.col(key), r"^recommendations-([0-9]+)", 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.length("_digits")), lambda i: F.substring(F.col("_digits"), F.lit(1), i))
    numbered = cache.withColumn("_digits", digits).where(F.length("_digits") > 0)
    tried = numbered.select(key, F.explode(prefixes).alias("_user"))
    wanted = users.select(F.col("user_id").cast("string").alias("_user"))
    return tried.join(wanted, "_user", "left_semi").select(key).distinct()
