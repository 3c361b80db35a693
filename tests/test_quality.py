import pytest
from pyspark.sql import functions as F

from aphora.operators import quality as q


def check(spark, rule, *raws, kind="string", strict=False):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], f"i int, raw {kind}")
    found = q.validate(rows, {"raw": rule}, strict).orderBy("i").collect()
    return [([e.removeprefix("raw:") for e in r.errors], r.raw__clean) for r in found]


@pytest.mark.parametrize("raw, want", [
    ("", 0.0), (" 5 ", 5.0), ("0x10", 16.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("-7", -7.0), ("0b11", 3.0), ("0o17", 15.0),
    ("Infinity", float("inf")), ("-Infinity", float("-inf")),
    ("5d", None), ("1_000", None), ("abc", None), ("-0x10", None), ("--1", None), ("1 2", None), ("NaN", None), ("5f", None),
])
def test_numbers_from_text(spark, raw, want):
    errors, clean = check(spark, q.Rule("number"), raw)[0]
    assert (errors, clean) == (([], want) if want is not None else (["not_number"], None))


@pytest.mark.parametrize("raw, want", [
    ("0x1ffffffffffffffffff", float(0x1FFFFFFFFFFFFFFFFFF)), ("0x" + "0" * 40 + "10", 16.0), ("0b" + "1" * 70, float(2**70 - 1)), ("0o" + "7" * 30, float(8**30 - 1)),
    ("0x" + "f" * 400, float("inf")), ("9" * 400, float("inf")), ("1e999", float("inf")),
])
def test_long_numbers_do_not_fail(spark, raw, want):
    _, clean = check(spark, q.Rule("number"), raw)[0]
    assert clean == pytest.approx(want)


HOSTILE = ["0x" + "f" * 60, "9" * 60, "1e400", "-" * 50, "\0", "\U0001f600" * 12, "{" * 200, "2024-99-99", "0001-01-01", "NaN", "1e", "٣", " ", "//", "http://[", "a@b@c", "%", "\\", '"']


@pytest.mark.parametrize("kind", ["string", "number", "boolean", "email", "date", "uuid", "url", "enum"])
def test_no_text_ends_a_job(spark, kind):
    rule = q.Rule(kind, **({"values": ["a"]} if kind == "enum" else {}))
    rows = spark.createDataFrame([(x,) for x in (*HOSTILE, None)], "raw string")
    assert len(q.validate(rows, {"raw": rule}).select("errors", F.col("raw__clean").cast("string")).collect()) == len(HOSTILE) + 1


@pytest.mark.parametrize("kind, values", [("double", [1e30, -1e30, 9e18, float("inf"), float("nan"), 8.64e15, 1e12]), ("bigint", [2**63 - 1, -(2**63), 0]), ("decimal(38,0)", [10**37])])
def test_numeric_dates_outside_of_time(spark, kind, values):
    from decimal import Decimal

    rows = [Decimal(v) if "decimal" in kind else v for v in values]
    frame = spark.createDataFrame(list(enumerate(rows)), f"i int, raw {kind}")
    found = q.validate(frame, {"raw": q.Rule("date")}).orderBy("i").select("errors", F.col("raw__clean").cast("string")).collect()
    assert [not r.errors for r in found] == [abs(v) <= 8.64e15 for v in values]


def test_number_bounds_are_inclusive(spark):
    rule = q.Rule("number", minimum=1, maximum=10, integer=True)
    got = [e for e, _ in check(spark, rule, "1", "10", "0", "11", "2.5", "0.5", "Infinity")]
    assert got == [[], [], ["min"], ["max"], ["integer"], ["min", "integer"], ["max", "integer"]]


def test_numbers_from_columns(spark):
    assert check(spark, q.Rule("number"), 3, kind="bigint") == [([], 3.0)]
    assert check(spark, q.Rule("number"), True, kind="boolean") == [([], 1.0)]
    assert check(spark, q.Rule("number"), float("nan"), kind="double") == [(["not_number"], None)]
    assert check(spark, q.Rule("number"), ["1"], kind="array<string>") == [(["not_number"], None)]


def test_booleans(spark):
    got = check(spark, q.Rule("boolean"), "true", "1", "false", "0", "TRUE", "yes", "", None)
    assert [c for _, c in got] == [True, True, False, False, None, None, None, None]
    assert [e for e, _ in got] == [[]] * 4 + [["not_boolean"]] * 3 + [[]]
    assert [c for _, c in check(spark, q.Rule("boolean"), 1, 0, 2, kind="int")] == [True, False, None]


def test_required_stops_other_rules(spark):
    rule = q.Rule("string", required=True, min_length=3)
    assert [e for e, _ in check(spark, rule, None, "", "ab", "abc")] == [["required"], ["required"], ["min_length"], []]
    assert check(spark, q.Rule("string", min_length=3), None) == [([], None)]


def test_strings(spark):
    rule = q.Rule("string", min_length=3, max_length=2, pattern="x", sanitize=True)
    assert check(spark, rule, "<b>") == [(["max_length", "pattern"], "&lt;b&gt;")]
    assert check(spark, q.Rule("string"), 5, kind="int")[0][0] == ["type"]
    vocabulary = q.Rule("string", values=("a", "b"))
    assert check(spark, vocabulary, "c")[0][0] == []
    assert check(spark, vocabulary, "c", strict=True)[0][0] == ["enum"]
    assert check(spark, q.Rule("string", pattern=q.SAFE_STRING), "ok", "a;b")[1][0] == ["pattern"]


@pytest.mark.parametrize("kind, good, bad", [
    ("email", ["a.b+c@x-y.org"], ["a@b", "a b@c.de", "a@b.c", "a@b.org\n"]),
    ("uuid", ["123e4567-E89B-12d3-a456-426614174000"], ["123e4567-e89b-62d3-a456-426614174000", "123e4567e89b12d3a456426614174000"]),
    ("url", ["https://x.y/z?q", "HTTP://a.b"], ["ftp://x.y", "https://", "http://ab c", "https://ab\u00a0c"]),
    ("date", ["2024-01-31", "2024-01-31T10:00:00Z", "2024-01-31T10:00:00.123+02:00", "2024-01", "2024"], ["2024-13-01", "soon", "31.01.2024"]),
])
def test_formats(spark, kind, good, bad):
    got = check(spark, q.Rule(kind), *good, *bad)
    assert [e for e, _ in got] == [[]] * len(good) + [[kind]] * len(bad)


def test_dates(spark):
    rule = q.Rule("date", min_date="2024-01-02 00:00:00", max_date="2024-01-03 00:00:00")
    assert [e for e, _ in check(spark, rule, "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")] == [["min_date"], [], [], ["max_date"]]
    assert check(spark, q.Rule("date"), 86_400_000, kind="bigint")[0][1].day == 2


def test_arrays(spark):
    rule = q.Rule("array", items=q.Rule("number", maximum=5), min_items=1, max_items=3)
    got = check(spark, rule, ["1", "x", "9"], [], ["1"] * 4, ["2"], None, kind="array<string>")
    assert [e for e, _ in got] == [["item[1]:not_number", "item[2]:max"], ["min_items"], ["max_items"], [], []]
    assert got[3][1] == [2.0]
    assert check(spark, rule, "x")[0][0] == ["not_array"]


def test_objects_as_maps(spark):
    rule = q.Rule("object", required_keys=("a",), additional=False, properties={
        "a": q.Rule("number"), "b": q.Rule("string", required=True), "c": q.Rule("string", default="d"),
    })
    rows = [{"a": "1", "b": "x"}, {"b": ""}, {"a": "x", "z": "1"}]
    got = check(spark, rule, *rows, kind="map<string,string>")
    assert got[0][0] == [] and got[0][1].a == 1.0 and got[0][1].c == "d"
    assert sorted(got[1][0]) == ["b:required", "missing:a"]
    assert sorted(got[2][0]) == ["a:not_number", "not_allowed:z"]
    # A property that is required on its own is only missed in strict mode.
    assert sorted(check(spark, rule, {"a": "1"}, kind="map<string,string>", strict=True)[0][0]) == ["b:required"]
    open_rule = q.Rule("object", properties={"a": q.Rule("number")})
    assert check(spark, open_rule, {"a": "1", "z": "2"}, kind="map<string,string>")[0][1].additional == {"z": "2"}


def test_objects_as_structs(spark):
    kind = "struct<a:string,inner:struct<n:string>,extra:string>"
    rule = q.Rule("object", required_keys=("a", "gone"), additional=False, properties={
        "a": q.Rule("string", min_length=2), "inner": q.Rule("object", properties={"n": q.Rule("number")}),
    })
    got = check(spark, rule, ("x", ("y",), "e"), ("xx", ("1",), None), kind=kind)
    assert sorted(got[0][0]) == ["a:min_length", "inner:n:not_number", "missing:gone", "not_allowed:extra"]
    assert got[1][0] == ["missing:gone"] and got[1][1].inner.n == 1.0
    assert check(spark, rule, "text")[0][0] == ["not_object"]


def test_enum_custom_and_unknown_kind(spark):
    assert [e for e, _ in check(spark, q.Rule("enum", values=("a", "b")), "a", "c", None)] == [[], ["enum"], []]
    assert check(spark, q.Rule("enum"), "a")[0][0] == ["enum"]
    custom = q.Rule("number", minimum=2, check=lambda c: c % 2 == 0)
    assert [e for e, _ in check(spark, custom, "4", "3", "1", None)] == [[], ["custom"], ["min"], []]
    assert check(spark, q.Rule("colour"), "red")[0][0] == ["type"]


def test_cleaned_rows_are_clean(spark):
    rules = {"raw": q.Rule("string", min_length=1, sanitize=True), "n": q.Rule("number", minimum=0)}
    rows = spark.createDataFrame([("<a>", "0x1f"), ("b", "7"), ("", "-1"), (None, "x")], "raw string, n string")
    good, bad = q.split_valid(q.validate(rows, rules))
    assert good.count() == 2 and bad.count() == 2 and "errors" in bad.columns
    again = good.select(F.col("raw__clean").alias("raw"), F.col("n__clean").alias("n"))
    assert q.validate(again, rules).where("NOT valid").count() == 0


def test_parts(spark):
    rows = spark.createDataFrame([("x", "1"), ("", "y")], "p string, n string")
    checked = q.validate_parts(rows, {"params": {"p": q.Rule("string", required=True)}, "query": {"n": q.Rule("number")}})
    found = [(r.errors, r.valid) for r in checked.orderBy(F.desc("p")).collect()]
    assert found == [({}, True), ({"params": ["p:required"], "query": ["n:not_number"]}, False)]


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("1",)], "raw string")
    plan = q.validate(rows, {"raw": q.Rule("number", minimum=1)})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("text, want", [
    ("Jan 5, 2024", "2024-01-05 00:00:00"), ("january 5 2024", "2024-01-05 00:00:00"), ("5 January 2024 10:00", "2024-01-05 10:00:00"),
    ("Fri, 05 Jan 2024 10:00:01 GMT", "2024-01-05 10:00:01"), ("2024/01/05", "2024-01-05 00:00:00"), ("2024/1/5 3:07 pm", "2024-01-05 15:07:00"),
    ("1/5/2024", "2024-01-05 00:00:00"), ("12/31/2023 12:00 AM", "2023-12-31 00:00:00"), ("Sept. 3rd, 2021 12:30:15.25 PM", "2021-09-03 12:30:15.25"),
    ("5-Jan-2024", "2024-01-05 00:00:00"), ("Jan 5, 2024 10:00 +0230", "2024-01-05 07:30:00"), ("Jan 5 2024 10:00 GMT-5:00", "2024-01-05 15:00:00"),
    ("Fri Jan 05 2024 10:00:00 GMT+0100 (Central European Time)", "2024-01-05 09:00:00"), (" feb 29 2024 ", "2024-02-29 00:00:00"), ("2024/01/05T23:59:59", "2024-01-05 23:59:59"),
    ("Feb 30, 2024", None), ("Feb 29, 2023", None), ("31 April 2024", None), ("13/13/2024", None), ("2024/01/05 24:00", None), ("2024/01/05 10:60", None),
    ("2024/01/05 10:00:60", None), ("Jan 5", None), ("Jan 5, 24", None), ("Janus 5, 2024", None), ("5 2024 Jan", None), ("1/5/2024 13:00 pm", None), ("1/5/2024 0:10 am", None),
    ("31.01.2024", None), ("Jan 5, 2024 x", None), ("", None),
])
def test_written_dates(spark, text, want):
    frame = spark.createDataFrame([(text,)], "raw string")
    row = frame.select(q.js_date(F.col("raw")).cast("timestamp_ntz").cast("string").alias("d")).first()
    assert row.d == want


def test_checks_in_python(spark):
    """A test sees the cleaned value of what is valid so far; what it raises is an error of that row."""
    seen = q.Rule("number", minimum=0, test=lambda v: 1 / v > 0.1 or "small")
    assert check(spark, seen, "2", "0", "20", "-1", "x", None) == [
        ([], 2.0), (["custom_failed:float division by zero"], 0.0), (["custom:small"], 20.0), (["min"], -1.0), (["not_number"], None), ([], None)]
    nested = q.Rule("object", properties={"a": q.Rule("string", test=lambda v: len(v) == 1), "b": q.Rule("array", test=lambda v: sum(v) > 3 or None)})
    rows = spark.createDataFrame([(1, ("x", [1, 2])), (2, ("xy", [4])), (3, None)], "i int, raw struct<a:string,b:array<int>>")
    found = q.validate(rows, {"raw": nested}).orderBy("i").collect()
    assert [r.errors for r in found] == [["raw:b:custom"], ["raw:a:custom"], []]
    whole = q.Rule("object", test=lambda v: v["a"] == "x" or "not x")
    assert [r.errors for r in q.validate(rows, {"raw": whole}).orderBy("i").collect()] == [[], ["raw:custom:not x"], []]
    with pytest.raises(ValueError):
        q.validate(rows.select("raw.b"), {"b": q.Rule("array", items=q.Rule("number", test=bool))})
