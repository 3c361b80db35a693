import pytest
from pyspark.sql import functions as F

from aphora.operators import filters, lifecycle, relations
from aphora.plans import generation, reports
from tests.helpers import ntz, tuples

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_keep_first_and_duplicates(spark):
    rows = spark.createDataFrame([("a", 1, ntz(5)), ("a", 1, ntz(2)), ("a", 2, ntz(9))], "k string, t int, ts timestamp_ntz")
    assert tuples(lifecycle.keep_first(rows, ["k", "t"], ["ts"])) == [("a", 1, ntz(2)), ("a", 2, ntz(9))]
    assert tuples(lifecycle.duplicates(rows, ["k", "t"])) == [("a", 1, 2)]


def test_unseen_events(spark):
    schema = "event_id string, event_type string, ts timestamp_ntz"
    events = spark.createDataFrame([("e1", "x", ntz(1)), ("e1", "x", ntz(0)), ("e1", "y", ntz(3)), ("e2", "x", ntz(4))], schema)
    consumed = spark.createDataFrame([("e2", "x", ntz(0))], schema)
    found = lifecycle.unseen_events(events, consumed, ["event_id", "event_type"], ["ts"])
    assert tuples(found) == [("e1", "x", ntz(0)), ("e1", "y", ntz(3))]


def test_upsert(spark):
    base = spark.createDataFrame([(1, "free", "x", ntz(0)), (2, "pro", "y", ntz(1))], "id int, tier string, note string, created_at timestamp_ntz")
    updates = spark.createDataFrame([(2, "free", None, ntz(7), 1), (2, "standard", None, ntz(7), 2), (3, "pro", "z", ntz(2), 3)],
                                    "id int, tier string, note string, ts timestamp_ntz, n int")
    merged = lifecycle.upsert(base, updates, "id", "ts", "n", ["tier", "note"], F.lit(ntz(100)).cast("timestamp_ntz"))
    assert tuples(merged, "id", "tier", "note", "created_at", "updated_at") == [
        (1, "free", "x", ntz(0), ntz(0)), (2, "standard", "y", ntz(1), ntz(100)), (3, "pro", "z", ntz(100), ntz(100)),
    ]


@pytest.mark.parametrize("expires, active, used, kept", [
    (ntz(0, 30), True, ntz(0), False), (ntz(1, 31), True, None, True), (ntz(1, 31), False, None, True),
    (None, False, ntz(0), False), (None, None, ntz(0), True), (ntz(1, 31), False, ntz(2), True), (None, True, ntz(0), True),
])
def test_session_retention(spark, expires, active, used, kept):
    now = F.lit("2024-01-31 00:00:01").cast("timestamp_ntz")
    rows = spark.createDataFrame([(expires, active, used)], "expires_at timestamp_ntz, is_active boolean, last_used_at timestamp_ntz")
    assert lifecycle.purge(rows, lifecycle.session_expired(now)).count() == int(kept)
    report = lifecycle.sweep_report("s", rows, lifecycle.session_expired(now)).first()
    assert (report.kept, report.purged) == (int(kept), int(not kept))


def test_last_write_decides(spark):
    writes = spark.createDataFrame([
        ("a", ntz(1), 1, None), ("a", ntz(2), 2, ntz(0, 30)), ("b", ntz(1), 3, ntz(0, 30)), ("b", ntz(1), 4, None), ("c", ntz(1), 5, ntz(1, 31)),
    ], "k string, ts timestamp_ntz, n int, expires_at timestamp_ntz")
    assert [r.k for r in lifecycle.live_entries(writes, ["k"], "ts", "n", as_of()).orderBy("k").collect()] == ["b", "c"]


@pytest.mark.parametrize("ttl, want", [(60, ntz(60)), (0, None), (-5, None), (None, None)])
def test_expiry(spark, ttl, want):
    rows = spark.createDataFrame([(ntz(0), ttl)], "ts timestamp_ntz, ttl int")
    assert rows.select(lifecycle.expiry(F.col("ts"), F.col("ttl")).alias("x")).first().x == want


def test_append_and_defaults(spark):
    old = spark.createDataFrame([(1, "a")], "id int, x string")
    new = spark.createDataFrame([(2, True)], "id int, y boolean")
    both = lifecycle.append(old, new)
    assert tuples(lifecycle.with_defaults(both, {"x": "d", "y": False, "z": 7})) == [(1, "a", False, 7), (2, "d", True, 7)]


def test_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(10,)], "parent int")
    assert [r.id for r in relations.orphans(child, "parent", parent, "parent").collect()] == [2]
    assert sorted(r.id for r in relations.cascade_delete(child, parent, "parent").collect()) == [2, 3]
    assert tuples(relations.set_null(child, parent.unionAll(parent), "parent").fillna(0)) == [(1, 0), (2, 11), (3, 0)]
    assert tuples(relations.find(child, parent, "parent").select("id", "found")) == [(1, True), (2, False), (3, False)]


def test_optional_lists_in_filters(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, tags array<string>")
    assert [r.id for r in rows.where(filters.tags_include(F.col("tags"), ["b", "a"])).collect()] == [1]
    details = spark.createDataFrame([('{"c":"x"}',), ('{"c":null}',), ('{}',), (None,), ("bad",)], "d string")
    assert details.where(filters.has_json_key(F.col("d"), "c")).count() == 1
    assert details.where(filters.has_json_key_strict(F.col("d"), "c")).count() == 2


@pytest.mark.parametrize("minimum, want", [("debug", 4), ("info", 4), ("warn", 3), ("fatal", 1)])
def test_levels(spark, minimum, want):
    rows = spark.createDataFrame([("INFO",), ("warn",), ("Error",), ("custom",)], "level string")
    assert filters.at_least_level(rows, minimum).count() == want


def test_cache_rates_without_access(spark):
    empty = spark.createDataFrame([], "cache_key string, hit boolean, is_ai boolean")
    row = reports.cache_stats(empty).first()
    assert (row.hits, row.misses, row.hit_rate, row.ai_hit_rate) == (0, 0, 0.0, 0.0)
    log = spark.createDataFrame([("ai:1", True, False), ("k", True, True), ("ai:2", False, None), ("k", False, None)],
                                "cache_key string, hit boolean, is_ai boolean")
    row = reports.cache_stats(log).first()
    assert (row.hits, row.misses, row.ai_hits, row.ai_misses, row.hit_rate, row.ai_hit_rate) == (2, 2, 1, 1, 0.5, 0.5)


def test_generated_quotes(spark):
    answers = spark.createDataFrame([(1, " one \n"), (2, "  "), (3, None)], "slot int, completion string")
    made = generation.generated_batch(answers, ["slot"], as_of())
    assert [r.text for r in made.collect()] == ["one"]
    again = generation.generated_batch(answers, ["slot"], as_of())
    assert made.exceptAll(again).count() == 0
    spread = spark.range(3000).select(generation.assigned_category("id").alias("c")).groupBy("c").count()
    assert spread.count() == 15


def test_insert_keeps_rows_without_a_time_and_other_columns(spark):
    held = spark.createDataFrame([(1, 1, None, "old"), (1, 2, ntz(5), "b")], "user_id int, quote_id int, created_at timestamp_ntz, note string")
    new = spark.createDataFrame([(1, 1, ntz(9)), (2, 2, ntz(8)), (2, 2, ntz(7)), (3, 3, None)], "user_id int, quote_id int, created_at timestamp_ntz")
    found = lifecycle.insert_if_absent(held, new, ["user_id", "quote_id"], "created_at")
    assert found.columns == ["user_id", "quote_id", "created_at", "note", "is_new"]
    assert tuples(found.orderBy("user_id", "quote_id")) == [(1, 1, None, "old", False), (1, 2, ntz(5), "b", False), (2, 2, ntz(7), None, True), (3, 3, None, None, True)]
