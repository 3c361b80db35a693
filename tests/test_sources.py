import glob
import json

import pytest
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.plans import logs, search
from aphora.sources import sinks, tables
from tests.helpers import ntz, tuples

COMMENTED = """[
  {"text": "A", "category": "focus", "lang": "EN", "createdAt": 1726650000000},
  {"text": "B", "category": "calm", "lang": "EN", "createdAt": 1726650001000}
  // more to come
]"""


def test_commented_json(spark, tmp_path):
    (tmp_path / "quotes.json").write_text(COMMENTED)
    rows = tables.generated_quotes(spark, str(tmp_path / "quotes.json"))
    assert [r.text for r in rows.orderBy("text").collect()] == ["A", "B"]
    assert rows.schema["created_at"].dataType.typeName() == "timestamp"
    assert rows.select(F.unix_millis("created_at")).orderBy("text").first()[0] == 1726650000000


def test_broken_json_fails(spark, tmp_path):
    (tmp_path / "quotes.json").write_text('[{"text": "A"}, {"text": ]')
    with pytest.raises(Exception):
        tables.generated_quotes(spark, str(tmp_path / "quotes.json")).collect()


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "text": "t", "author": "a", "source": "s", "year": -550, "premium": True}]))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "c1", "name": "C", "items": ["q1", "q9"]}]))
    (tmp_path / "k.json").write_text(json.dumps([{"id": i, "name": n, "premium": p} for i, n, p in dimensions.CATEGORIES]))
    quotes = tables.quote_file(spark, str(tmp_path / "q.json"))
    assert quotes.first().year == -550
    from aphora.plans.reports import collection_items
    found = collection_items(tables.collection_file(spark, str(tmp_path / "c.json")), quotes.withColumnRenamed("id", "quote_id"))
    assert [(r.collection_id, r.quote_id) for r in found.collect()] == [("c1", "q1")]
    assert tuples(tables.category_file(spark, str(tmp_path / "k.json"))) == sorted(map(tuple, dimensions.CATEGORIES))


def test_canonical_table(spark, tmp_path):
    path = str(tmp_path / "favorites")
    spark.createDataFrame([(1, 2, ntz(3))], "user_id bigint, quote_id bigint, created_at timestamp_ntz").write.parquet(path)
    assert tuples(tables.canonical(spark, path, "favorites")) == [(1, 2, ntz(3))]


def test_dimensions(spark):
    assert dimensions.voices(spark).count() == 20 and dimensions.voices(spark).where("in_standard").count() == 6
    assert dimensions.categories(spark).count() == 15
    assert {r.tier: (r.max_favorites, r.max_audio, r.max_voices) for r in dimensions.plans(spark).collect()} == {
        "free": (50, 0, 0), "standard": (-1, 50, 6), "pro": (-1, -1, 20)}


def test_append_keeps_history(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(1, "a", ntz(0)), (2, "b", ntz(0, 2))], "user_id int, x string, created_at timestamp_ntz")
    audit = sinks.audit_rows(rows, "act", ["x"])
    sinks.append_by_day(audit, path)
    sinks.append_by_day(audit, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("dt").distinct().count() == 2
    assert stored.first().details in ('{"x":"a"}', '{"x":"b"}')


def test_files_are_bounded(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.bounded_files(spark.range(25).select(F.col("id").cast("string").alias("value")).coalesce(1), path, 10)
    sizes = sorted(sum(1 for _ in open(f)) for f in glob.glob(path + "/part-*"))
    assert sizes == [5, 10, 10]


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_export(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    sinks.export(spark.range(7).selectExpr("id", "'a,\"b' AS text"), path, fmt)
    back = spark.read.schema("id bigint, text string").format(fmt).option("escape", "\\").load(path)
    assert tuples(back) == [(i, 'a,"b') for i in range(7)]
    with pytest.raises(Exception):
        sinks.export(spark.range(1), path, fmt)
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), path + "x", "xml")


LINES = [
    '[2024-01-31T10:00:00.123Z] [INFO] [req-1] GET /x done {"a":{"b":1},"token":"t"}',
    "[2024-01-31T10:00:00.123Z] [WARN] no request",
    "[2024-01-31T10:00:00.123Z] [ERROR] [r] braces { inside",
    "[2024-01-31T10:00:00.123Z] [DEBUG] message {x} and {\"y\":2}",
    "=== Log opened ===",
    "",
]


def test_log_lines(spark):
    rows = spark.createDataFrame([(line,) for line in LINES], "value string")
    good, bad = logs.split_malformed(logs.parse_logs(rows))
    found = {(r.level, r.request_id, r.message, r.meta) for r in good.collect()}
    assert found == {
        ("INFO", "req-1", "GET /x done", '{"a":{"b":1},"token":"t"}'), ("WARN", None, "no request", None),
        ("ERROR", "r", "braces { inside", None), ("DEBUG", None, "message {x} and", '{"y":2}'),
    }
    assert {r.line for r in bad.collect()} == {"=== Log opened ===", ""}


def test_lines_can_be_read_back(spark):
    rows = spark.createDataFrame([(ntz(1), "info", "req-1", "m", '{"secret":"s","n":1}'), (ntz(2), "warn", "", "m", "{}"),
                                  (ntz(3), "error", None, "m", None)], "at timestamp_ntz, level string, req string, msg string, meta string")
    lines = rows.select(logs.format_line(F.col("at"), F.col("level"), F.col("req"), F.col("msg"), F.col("meta")).alias("value"))
    assert [r.value for r in lines.orderBy("value").collect()] == [
        '[2024-01-01T00:00:01.000Z] [INFO] [req-1] m {"secret":"********","n":1}', "[2024-01-01T00:00:02.000Z] [WARN] m",
        "[2024-01-01T00:00:03.000Z] [ERROR] m",
    ]
    parsed, _ = logs.split_malformed(logs.parse_logs(lines))
    assert tuples(parsed, "logged_at", "level") == [(ntz(1), "INFO"), (ntz(2), "WARN"), (ntz(3), "ERROR")]


@pytest.mark.parametrize("rest, message, meta", [
    ('GET /a?x=[1] start {"a" done {"statusCode":200}', 'GET /a?x=[1] start {"a" done', '{"statusCode":200}'),
    ('m {"a": {"b": 1}}', "m", '{"a": {"b": 1}}'), ('m {"a":"x {}"}', "m", '{"a":"x {}"}'), ('m {"a":1} {"b":2}', 'm {"a":1}', '{"b":2}'),
    ("m {x}", "m {x}", None), ("m { {", "m { {", None), ("m", "m", None),
    ('m" {"a":" {","b":" } {"}', 'm"', '{"a":" {","b":" } {"}'), ('m {"a":"\\\\"}', "m", '{"a":"\\\\"}'), ('m { {"a":"\\" {"}', "m {", '{"a":"\\" {"}'),
    ('m {"a":{"b":1}} }', 'm {"a":{"b":1}} }', None), ('m {"a": {"b":1}', 'm {"a":', '{"b":1}'), ('m{"a":1}', 'm{"a":1}', None), ('m {{"a":1}', 'm {{"a":1}', None),
    ("m" + " {" * 100_000 + ' {"a":1}', "m" + " {" * 100_000, '{"a":1}'), ("m" + ' {"' * 50_001 + ' {"a":1}', "m" + ' {"' * 50_001, '{"a":1}'),
    ("m {" + '"a": {' * 900 + "}" * 901, "m", "{" + '"a": {' * 900 + "}" * 901),
])
def test_metadata_is_the_last_json(spark, rest, message, meta):
    rows = spark.createDataFrame([(f"[2024-01-31T10:00:00.123Z] [INFO] {rest}",)], "value string")
    row = logs.parse_logs(rows).first()
    assert (row.message, row.meta) == (message, meta)


def test_times_that_are_none_do_not_end_the_report(spark):
    lines = [f'GET /a done {{"statusCode":200,"responseTime":{x}}}' for x in ("1e30", '"NaN"', '"Infinity"', "1e999", "null", "1.25", "-0.5", "0")]
    rows = spark.createDataFrame([(f"[2024-01-31T10:00:00.123Z] [INFO] {x}",) for x in lines], "value string")
    row = logs.route_latency(logs.parse_logs(rows)).first()
    assert (row.requests, row.mean_ms, row.p50_ms, row.max_ms) == (3, 0.25, 0.0, 1.25)


def test_a_bad_status_line_does_not_end_the_report(spark):
    lines = ['GET /a done {"statusCode":"n/a","responseTime":1.5}', 'GET /a done {"statusCode":200,"responseTime":2.5}', "GET /a done"]
    rows = spark.createDataFrame([(f"[2024-01-31T10:00:00.123Z] [INFO] {x}",) for x in lines], "value string")
    found = {r.status: (r.requests, r.p50_ms) for r in logs.route_latency(logs.parse_logs(rows)).collect()}
    assert found == {None: (1, 1.5), 200: (1, 2.5)}


def test_request_pairs(spark):
    rows = spark.createDataFrame([("a", "start", ntz(1.0)), ("a", "end", ntz(1.25)), ("b", "start", ntz(2))],
                                 "request_id string, phase string, ts timestamp_ntz")
    rows = rows.withColumns({"method": F.lit("GET"), "url": F.lit("/"), "status_code": F.lit(200)})
    assert {r.request_id: r.response_ms for r in logs.pair_requests(rows).collect()} == {"a": 250.0, "b": None}


def test_search_paths_agree(spark, tmp_path):
    quotes = spark.createDataFrame([(1, "The hand, the REST", "Ann"), (2, "hands and rest", "Bob"), (3, "hand", "rest"), (4, "rest hand", None)],
                                   "quote_id bigint, text string, author string")
    search.write_index(search.inverted_index(quotes), str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for terms in (["hand", "rest"], ["Hand"], ["nothing"], ["ann"]):
        direct = tuples(search.search(quotes, terms).select("quote_id"))
        assert direct == tuples(search.search_index(search.inverted_index(quotes), terms)) == tuples(search.search_index(stored, terms))
    assert tuples(search.search(quotes, ["hand", "rest"]).select("quote_id")) == [(1,), (3,), (4,)]
    # Appended once more, with another number of buckets.
    search.write_index(search.inverted_index(quotes), str(tmp_path / "index"), buckets=7)
    again = spark.read.parquet(str(tmp_path / "index"))
    for terms in (["hand", "rest"], ["Hand"], ["nothing"], ["ann"]):
        assert tuples(search.search_index(again, terms)) == tuples(search.search(quotes, terms).select("quote_id"))


def test_parameters_are_not_text(spark):
    rows = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "v string")
    assert tables.query(spark, "SELECT v FROM {t} WHERE v = :v", {"v": "x' OR '1'='1"}, t=rows).count() == 1
