import pytest
from pyspark.sql import functions as F

from aphora.plans import dashboard, profile, recommend
from tests.helpers import ntz

CANDIDATES = "user_id bigint, candidates array<struct<quote_id:bigint,category:string,lang:string>>"


def recommend_for(spark, n, completion, count):
    items = [(100 + i, "c", "en") for i in range(1, n + 1)]
    lists = spark.createDataFrame([(1, items)], CANDIDATES)
    answers = spark.createDataFrame([(1, completion)] if completion is not None else [], "user_id bigint, completion string")
    rows = recommend.recommendations(lists, answers, F.lit(count)).orderBy("place").collect()
    fill = recommend.FILL_EXPLANATION
    return [(r.quote_id - 100, "fill" if r.explanation == fill else r.explanation) for r in rows]


@pytest.mark.parametrize("completion, want", [
    ("1. 3 - good one", [(3, "good one")]),
    ("1.  2  -  two  \n2. 1 - one", [(2, "two"), (1, "one")]),
    ("1. 9 - out of range\n2. 0 - none\nnoise\n3. 1 - in", [(1, "in")]),
    ("1. 2 - a\n2. 2 - again", [(2, "a"), (2, "again")]),
    ("1. 2 - a\r\n2. 1 - b", [(1, "b")]),
    ("x 1. 2 - a\n1 2 - b\n1. 2 c", []),
    ("1. 99999999999999999999 - huge", []),
    ("", []),
])
def test_answer_lines(spark, completion, want):
    assert recommend_for(spark, 3, completion, 0) == want


def test_lists_are_filled_up(spark):
    assert recommend_for(spark, 5, "1. 4 - x", 3) == [(4, "x"), (1, "fill"), (2, "fill")]
    assert recommend_for(spark, 2, None, 5) == [(1, "fill"), (2, "fill")]


def test_named_quotes_may_exceed_the_count(spark):
    assert recommend_for(spark, 3, "1. 1 - a\n2. 2 - b\n3. 3 - c", 2) == [(1, "a"), (2, "b"), (3, "c")]
    assert recommend_for(spark, 3, "1. 1 - a", -4) == [(1, "a")]


def test_capped_pool_equals_full_draw(spark, model):
    capped = recommend.candidate_rows(recommend.candidate_lists(model.users, model.views, model.quotes, 7, n=4,
                                                                default_categories=["motivation"], default_lang="fr"))
    top = profile.top_categories(model.views, 5).groupBy("user_id").agg(F.collect_set("category").alias("top"))
    wanted = model.users.join(top, "user_id", "left").select(
        "user_id", F.coalesce("lang", F.lit("fr")).alias("lang"),
        F.explode(F.coalesce("top", F.array(F.lit("motivation")))).alias("category"))
    full = wanted.join(model.quotes.select("quote_id", "category", "lang"), ["category", "lang"])
    from aphora.operators.ranking import sample_per_key
    full = sample_per_key(full, ["user_id"], "quote_id", 4, 7)
    columns = ["user_id", "position", "quote_id"]
    assert capped.count() > 0
    assert sorted(map(tuple, capped.select(columns).collect())) == sorted(map(tuple, full.select(columns).collect()))


QUOTES = "quote_id bigint, text string, author string, tags array<string>, mood string, premium boolean"


def test_quote_of_the_day(spark):
    quotes = spark.createDataFrame([
        (1, "first", "a", None, None, True), (2, "second", "b", ["x"], "calm", False), (3, "third", "c", ["x"], "calm", True),
    ], QUOTES)
    pick = lambda **kw: recommend.quote_of_the_day(quotes, 1, **kw).collect()
    assert [r.quote_id for r in pick(category="x", exclude_premium=True)] == [2]
    assert [r.quote_id for r in pick(mood="sad")] == [1]
    assert pick(category="x")[0].quote_id in (2, 3)
    assert len(pick()) == 1


def test_feedback(spark):
    quotes = spark.createDataFrame([(1,), (2,)], "quote_id bigint")
    favorites = spark.createDataFrame([(7, 1, ntz(1))], "user_id bigint, quote_id bigint, created_at timestamp_ntz")
    given = spark.createDataFrame([
        (7, 1, "like", ntz(5)), (7, 2, "like", ntz(4)), (7, 2, "like", ntz(3)), (8, 2, "dislike", ntz(2)), (8, 9, "like", ntz(2)),
    ], "user_id bigint, quote_id bigint, feedback string, created_at timestamp_ntz")
    audit, after = recommend.feedback_apply(given, quotes, favorites)
    assert sorted(map(tuple, after.collect())) == [(7, 1, ntz(1), False), (7, 2, ntz(3), True)]
    assert audit.count() == 4
    assert after.count() == after.select("user_id", "quote_id").distinct().count()
    _, rejected = recommend.feedback_rows(given, quotes)
    assert [r.quote_id for r in rejected.collect()] == [9]


def test_cache_invalidation_is_a_prefix_match(spark):
    cache = spark.createDataFrame([("recommendations-1-5",), ("recommendations-12-5",), ("recommendations-2-5",), ("other-1",)], "cache_key string")
    users = spark.createDataFrame([(1,)], "user_id bigint")
    assert sorted(r.cache_key for r in recommend.invalidated_keys(cache, users).collect()) == ["recommendations-1-5", "recommendations-12-5"]


def test_stats_equal_the_joined_form(spark, model):
    joined = model.users.join(model.favorites.select("user_id", "quote_id"), "user_id", "left").join(
        model.audio.select("user_id", F.col("id").alias("audio_id")), "user_id", "left")
    literal = joined.groupBy("user_id").agg(F.countDistinct("quote_id").alias("f"), F.countDistinct("audio_id").alias("a"))
    ours = profile.user_stats(model.users, model.favorites, model.audio).select(
        "user_id", F.col("total_favorites").alias("f"), F.col("total_audio_generated").alias("a"))
    assert ours.exceptAll(literal).count() == 0 and literal.exceptAll(ours).count() == 0


@pytest.mark.parametrize("tier, used, over", [("free", 50, False), ("free", 51, True), ("pro", 51, False)])
def test_plan_limits(spark, tier, used, over):
    from aphora import dimensions

    users = spark.createDataFrame([(1, tier)], "user_id bigint, subscription_tier string")
    favorites = spark.range(used).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("quote_id"))
    audio = spark.createDataFrame([], "user_id bigint, voice_id string")
    row = dashboard.plan_usage(users, favorites, audio, dimensions.plans(spark)).first()
    assert (row.favorites_used, row.over_favorites, row.audio_used, row.over_audio) == (used, over, 0, False)
