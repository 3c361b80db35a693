import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from aphora.functions import masking, prompts, sharing, voice
from aphora.functions import text as t


@pytest.mark.parametrize("raw, want", [
    ("7", 7), (" 12px", 12), ("-3", -3), ("0", 5), ("abc", 5), ("", 5), (None, 5), ("0x10", 16), ("4.9", 4), ("+8", 8),
])
def test_limit_param(value, raw, want):
    assert value(t.limit_param("x"), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("  a b \n", "a b"), (" ﻿x　", "x"), (" \t\r\n", None), ("", None), (None, None), ("x", "x"),
])
def test_completion_text(value, raw, want):
    assert value(t.completion_text("x"), x=raw) == want


def test_lists_and_defaults(value):
    assert value(t.join_or("x", "none"), x=["a", "b"]) == "a, b"
    assert value(t.join_or("x", "none"), x=[]) == "none"
    assert value(t.non_empty_or("x", ["d"]), x=[]) == ["d"]
    assert value(t.text_or("x", "ro"), x="") == "ro"
    assert value(t.language_label("x"), x="en") == "engleză"
    assert value(t.language_label("x"), x="de") == "de"
    assert value(t.length_label("x"), x="huge") is None


def test_encode_component(value):
    assert value(t.encode_component("x"), x="a b!~*'()+é/&=") == "a%20b!~*'()%2B%C3%A9%2F%26%3D"


def test_encoding_can_be_undone(spark):
    seen = []

    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), min_size=1, max_size=30))
    def check(texts):
        rows = spark.createDataFrame([(x,) for x in texts], "x string")
        back = rows.select("x", F.url_decode(t.encode_component("x")).alias("y")).collect()
        seen.append(len(back))
        assert all(r.x == r.y for r in back)

    check()
    assert seen


def test_sanitize_leaves_ampersands(value):
    assert value(t.sanitize("x"), x="<a href=\"x\">'`$&") == "&lt;a href=&quot;x&quot;&gt;&#39;&#96;&#36;&"


@pytest.mark.parametrize("raw, want", [
    ('{"a": 1}', '{"a":1}'), ("[1, 2]", "[1,2]"), ('"x"', '"x"'), ("null", "null"), ('{"a": 1}}', '{"a": 1}}'), ("1,2", "1,2"),
    ("1] x", "1] x"), ("1} x", "1} x"), ("plain", "plain"), ("", ""), ("12", "12"),
])
def test_json_or_raw(value, raw, want):
    assert value(t.json_or_raw("x"), x=raw) == want


def test_keys_and_envelopes(value):
    assert value(t.endpoint_key(F.lit(None).cast("string"), "u"), u="https://API.example.org:8080/x?y#z") == "GET-api.example.org"
    assert value(t.endpoint_key(F.lit("POST"), "u"), u="not a url") is None
    assert value(t.cache_key(F.lit("p"), "x", F.to_json("y")), x=3, y=["a"]) == 'p-3-["a"]'
    good = json.loads(value(t.ok_envelope(n=F.lit(1), missing=F.lit(None).cast("string"))))
    assert good == {"ok": True, "n": 1, "missing": None}
    assert json.loads(value(t.error_envelope(F.lit("m"), F.lit("c")))) == {"ok": False, "error": {"message": "m", "code": "c", "details": {}}}


def test_display_name_and_age(value):
    assert value(t.display_name("x"), x="sophia_calm_voice") == "Sophia Calm_voice"
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert value(t.account_age_days(F.lit("2024-01-29 00:00:01").cast("timestamp_ntz"), as_of)) == 1


@pytest.mark.parametrize("attempt, want", [(0, 300.0), (1, 600.0), (5, 9600.0), (6, 10000.0), (9, 10000.0)])
def test_backoff(value, attempt, want):
    assert value(t.backoff_ms("n"), n=attempt) == want


def test_backoff_jitter_bounds(value):
    assert value(t.backoff_ms("n", jitter=0.8), n=2) == pytest.approx(300 * 1.6 * 1.6)
    assert value(t.backoff_ms("n", jitter=1.2), n=9) == pytest.approx(12000)
    assert value(t.doubling_backoff_ms("n"), n=3) == 3200.0


def test_vector(value):
    assert value(t.vector("x", 2), x="[1.5, -2]") == [1.5, -2.0]
    assert value(t.vector("x", 3), x="[1.5, -2]") is None
    assert value(t.vector("x"), x="nonsense") is None


MOODS = [
    ("Find PEACE within", [], "peaceful", "peaceful"),
    ("a quiet day", [], "motivational", "peaceful"),
    ("strong wisdom", [], "wise", "wise"),
    ("calm and strong", [], "peaceful", "peaceful"),
    ("be bold", [], "motivational", "confident"),
    ("powerful", [], "confident", "confident"),
    ("keep going", ["wisdom"], "motivational", "wise"),
    ("powerful", ["peace"], "confident", "peaceful"),
    ("keep going", None, "motivational", "motivational"),
]


@pytest.mark.parametrize("text, tags, short, extended", MOODS)
def test_moods(spark, text, tags, short, extended):
    row = spark.createDataFrame([(text, tags)], "x string, g array<string>").select(
        voice.classify_mood(F.lower("x"), rules=voice.SHORT_RULES).alias("short"),
        voice.classify_mood(F.lower("x"), F.col("g"), voice.EXTENDED_RULES).alias("extended"),
    ).first()
    assert (row.short, row.extended) == (short, extended)


def test_voice_choice(spark):
    rows = spark.range(400).select(
        "id", voice.select_voice(F.lit("motivational"), F.lit("pro"), "id").alias("pro"),
        voice.select_voice(F.lit("motivational"), F.lit("standard"), "id").alias("standard"),
        voice.select_voice(F.lit(None).cast("string"), F.lit("pro"), "id").alias("none"),
    ).collect()
    six = {"maria_energetic", "maya_powerful", "nova_dynamic", "marcus_motivational", "leo_inspiring", "kai_energetic"}
    assert {r.pro for r in rows} == six
    assert {r.standard for r in rows} == six - {"nova_dynamic", "kai_energetic"}
    assert {r.none for r in rows} == {"sophia_calm"}


def test_voice_lookups(value):
    assert value(voice.speech_voice(F.col("v")), v="ace_gentle") == "fable"
    assert value(voice.speech_voice(F.col("v")), v="nobody") == "alloy"
    assert value(voice.voice_description(F.col("v")), v="nobody") == "Human-like AI voice"
    assert value(voice.duration_seconds(F.col("n")), n=25) == 3
    assert value(voice.content_type(F.col("f")), f="ogg") == "audio/wav"


def test_share_links(value):
    def link(platform):
        return value(sharing.share_link(F.lit(platform), F.lit("a%20b"), F.lit("https://x/quote/1")))

    assert link("twitter") == "https://twitter.com/intent/tweet?text=a%20b&url=https%3A%2F%2Fx%2Fquote%2F1"
    assert link("whatsapp") == "https://wa.me/?text=a%20b%20https%3A%2F%2Fx%2Fquote%2F1"
    assert link("facebook") == "https://www.facebook.com/sharer/sharer.php?u=https%3A%2F%2Fx%2Fquote%2F1"
    assert link("pigeon") == "https://x/quote/1"


NESTED = Row(id=1, user=Row(password="p", apiKey="k", name="n", devices=[Row(kind="a", token="t")]), extra={"Secret": "s", "x": "y"})
NESTED_SCHEMA = ("id int, user struct<password:string,apiKey:string,name:string,devices:array<struct<kind:string,token:string>>>, "
                 "extra map<string,string>")


@pytest.mark.parametrize("parity, key", [(False, masking.MASK), (True, "k")])
def test_masking_structs(spark, parity, key):
    rows = spark.createDataFrame([NESTED, Row(id=2, user=None, extra=None)], NESTED_SCHEMA)
    first, second = masking.mask_columns(rows, ["id", "user", "extra"], parity=parity).orderBy("id").collect()
    assert first.user.password == masking.MASK and first.user.apiKey == key and first.user.name == "n"
    assert first.user.devices[0].token == masking.MASK and first.user.devices[0].kind == "a"
    assert first.extra == {"Secret": masking.MASK, "x": "y"}
    assert second.user is None and second.extra is None


def test_masking_json(spark):
    deep = '{"a":[{"token":{"x":1}},{"password":["q"]}],"b":{"Secret":"s","n":1}}'
    flat = '{"token":"a \\" b","n":1,"secret": 12,"password":null,"tokens":"t"}'
    rows = spark.createDataFrame([(deep, flat), ("not json", None)], "deep string, flat string")
    got = rows.select(masking.mask_json_deep()("deep").alias("d"), masking.mask_json_text(F.col("flat")).alias("f")).collect()
    assert json.loads(got[0].d) == {"a": [{"token": masking.MASK}, {"password": masking.MASK}], "b": {"Secret": masking.MASK, "n": 1}}
    assert json.loads(got[0].f) == {"token": masking.MASK, "n": 1, "secret": masking.MASK, "password": masking.MASK, "tokens": "t"}
    assert got[1].d == "not json" and got[1].f is None


@pytest.mark.parametrize("text, want", [("", 0), ("abc", 3), ("é中", 2), ("\U0001f600" * 12, 24), ("a\U0001f600é", 4), (None, None)])
def test_lengths_count_utf16_units(value, text, want):
    from aphora.functions.text import utf16_length

    assert value(utf16_length(F.col("t")), t=text) == want


@pytest.mark.parametrize("kind, values, want", [
    ("int", {"token": 5, "n": 6}, {"token": masking.MASK, "n": "6"}),
    ("array<string>", {"password": ["x"], "a": ["y"]}, {"password": masking.MASK, "a": '["y"]'}),
    ("struct<v:string,password:string>", {"token": ("a", "b"), "o": ("c", "d")}, {"token": masking.MASK, "o": '{"v":"c","password":"********"}'}),
    ("map<string,string>", {"secret": {"a": "b"}, "m": {"token": "t", "x": "y"}}, {"secret": masking.MASK, "m": '{"token":"********","x":"y"}'}),
])
def test_masking_maps_of_any_value(spark, kind, values, want):
    rows = spark.createDataFrame([(values,)], f"m map<string,{kind}>")
    plain = lambda v: json.loads(v) if v[0] in "{[" else v
    got = masking.mask_columns(rows, ["m"]).first().m
    assert {k: plain(v) for k, v in got.items()} == {k: plain(v) for k, v in want.items()}


@pytest.mark.parametrize("text, want", [
    ('{"token":{"v":"abc"},"password":["x","]"],"n":1}', '{"token":"********","password":"********","n":1}'),
    ('{"a":{"secret":{"b":[{"c":"}"}]}},"z":[1]}', '{"a":{"secret":"********"},"z":[1]}'),
    ('{"token":' + "[" * 30 + '"deep"' + "]" * 30 + "}", '{"token":"********"}'),
    ('{"token":' + "[" * 5000 + '{"a":"]"}' + "]" * 5000 + ',"n":[{"password":' + "[" * 700 + "]" * 700 + "}]}", '{"token":"********","n":[{"password":"********"}]}'),
    ('{"pass\\u0077ord":"x","n":1}', '{"pass\\u0077ord":"********","n":1}'), ('{"API\\u212aEY":[1],"to\u212aen":2}', '{"API\\u212aEY":"********","to\u212aen":"********"}'),
    ('{"a":"\\\\","token":{"b":"\\\\\\"}"}}', '{"a":"\\\\","token":"********"}'), ('{"a":"the \\"token\\":1"}', '{"a":"the \\"token\\":1"}'),
    ('{"x\\"token":[1]}', '{"x\\"token":[1]}'), ('{"token":{"a":1}', '{"token":"********"'), ('{"token":{"a":[}', '{"masked":"********"}'), ("", ""), ("no json", "no json"),
    ('{"token":["open', '{"masked":"********"}'), ('{"token":"open', '{"masked":"********"}'),
    ('{"password":"' + "x" * 50_000 + '","n":2}', '{"password":"********","n":2}'),
])
def test_no_secret_is_shown(value, text, want):
    assert value(masking.mask_json_text(F.col("t")), t=text) == want


def test_personalize_prompt_without_favorites(value):
    text = value(prompts.personalize_prompt(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("t")), F.lit("s"), F.lit("short"), F.lit("ro"),
                                            F.array().cast("array<string>")))
    assert text == ("Generează un citat motivațional personalizat cu următoarele caracteristici:\n- Preferințe utilizator: a, b\n"
                    "- Teme de interes: t\n- Stil: s\n- Lungime: 30-50 caractere\n- Limba: română\n\n\n\n"
                    "Răspunde doar cu citatul generat, fără ghilimele sau alte explicații.")


def brute_mask(text, hidden=("password", "token", "apikey", "secret", "credit_card")):
    """The same by a walk over characters, for texts that are JSON."""
    import json as parser

    out, at, stack = [], 0, 0
    scan = parser.JSONDecoder()
    while at < len(text):
        if text[at] != '"':
            out.append(text[at])
            at += 1
            continue
        word, end = scan.raw_decode(text, at)
        out.append(text[at:end])
        at = end
        rest = text[at:].lstrip()
        if rest.startswith(":") and word.lower() in hidden:
            value = len(text) - len(rest[1:].lstrip())
            out.append(text[at:value] + '"********"')
            _, at = scan.raw_decode(text, value)
    return "".join(out)


def test_masking_equals_a_walk_over_characters(spark):
    import random

    rng = random.Random(4)
    keys = ["token", "Token", "pass\\u0077ord", "a", 'x\\"token', "secret\\\\", "apiKey", "\\u0053ecret"]

    def some(depth):
        kind = rng.randrange(7 if depth < 6 else 4)
        if kind < 4:
            return rng.choice(['"v"', '"a\\"token\\":[{"', "12", "null", '"]}"', "true", '"\\\\"'])
        inner = [some(depth + 1) for _ in range(rng.randrange(4))]
        blank = rng.choice(["", " ", "\n"])
        if kind == 4:
            return "[" + f",{blank}".join(inner) + "]"
        return "{" + f",{blank}".join(f'"{rng.choice(keys)}"{blank}:{blank}{v}' for v in inner) + "}"

    texts = [some(0) for _ in range(400)] + ["[" + ",".join(some(2) for _ in range(900)) + "]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", masking.mask_json_text(F.col("t")).alias("m")).collect()
    for r in got:
        assert r.m == brute_mask(r.t)


def test_masking_takes_nested_values_by_one_pattern(value, monkeypatch):
    """Values of many levels need no walk over their tokens; deeper ones are still hidden by it."""
    deep = lambda n: '{"id":1,"token":' + '[{"a":"]}\\\\","b":' * (n // 2) + "1" + "}]" * (n // 2) + ',"n":[2]}'
    want = '{"id":1,"token":"********","n":[2]}'
    assert value(masking.mask_json_text(F.col("t")), t=deep(masking._LEVELS + 2)) == want
    monkeypatch.setattr(masking, "_hide_nested", lambda text, key: F.raise_error(F.lit("walked")))
    assert value(masking.mask_json_text(F.col("t")), t=deep(masking._LEVELS)) == want


def test_masking_of_any_text_equals_the_walk(spark, monkeypatch):
    """The patterns find what the walk over all tokens finds, also in texts that are not JSON and beyond their levels."""
    import random

    rng = random.Random(9)
    parts = ['"', "\\", '"token":', '"a":', "[", "{", "]", "}", ",", '"x"', '"\\"', "\n", ' "pass\\u0077ord" : ', '"secret":[', "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = lambda: [r.m for r in rows.select(masking.mask_json_text(F.col("t")).alias("m")).collect()]
    monkeypatch.setattr(masking, "_LEVELS", 2)
    two = shown()
    monkeypatch.setattr(masking, "_value", lambda levels: "(?!)")
    assert shown() == two


def test_masking_takes_linear_time(value):
    import time

    text = '{"token":[' + ",".join(['{"a":"b"}'] * 60_000) + '],"n":[' + ",".join(['{"password":{"x":[1]}}'] * 20_000) + "]}"
    start = time.time()
    got = value(masking.mask_json_text(F.col("t")), t=text)
    assert got == '{"token":"********","n":[' + ",".join(['{"password":"********"}'] * 20_000) + "]}"
    assert time.time() - start < 20


def test_deep_json_does_not_end_the_job(spark):
    rows = spark.createDataFrame([('{"a":' + "[" * 100_000 + "]" * 100_000 + "}",)], "t string")
    assert rows.select(masking.mask_json_deep()("t").alias("m")).first().m in (rows.first().t, '{"masked":"********"}')


def holds(whole, part, top=True):
    """JSON containment by a walk over parsed values."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and holds(whole[k], v, False) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(holds(w, p, False) for w in whole) for p in part)
    if top and isinstance(whole, list):
        return any(holds(w, part, False) for w in whole if not isinstance(w, (list, dict)))
    if isinstance(part, bool) or isinstance(whole, bool) or part is None or whole is None:
        return part is whole
    return type(whole) not in (list, dict) and isinstance(whole, str) == isinstance(part, str) and whole == part


def test_json_containment_equals_a_walk(spark):
    import json
    import random

    from aphora.operators.filters import json_contains

    rng = random.Random(8)

    def some(depth):
        kind = rng.randrange(9 if depth < 3 else 6)
        if kind < 6:
            return rng.choice([None, True, False, 1, 2.5, 1.0, "a", "1", "", "it's", 12345678901234567])
        if kind < 8:
            return {k: some(depth + 1) for k in rng.sample(["a", "b.c", "d'e", 'q"', ""], rng.randrange(4))}
        return [some(depth + 1) for _ in range(rng.randrange(4))]

    def smaller(v):
        if isinstance(v, dict):
            return {k: smaller(x) for k, x in v.items() if rng.random() < 0.7}
        if isinstance(v, list):
            return [smaller(x) for x in v if rng.random() < 0.7][::-1]
        return v

    values = [some(0) for _ in range(120)]
    needles = [smaller(rng.choice(values)) for _ in range(25)] + [{}, [], 1, "a", None, True, [[]], [{}]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{"), (-2, None)], "i int, t string")
    found = rows.select("i", *[json_contains(F.col("t"), n).alias(f"n{k}") for k, n in enumerate(needles)]).collect()
    for row in found:
        for k, needle in enumerate(needles):
            want = row.i >= 0 and holds(values[row.i], needle)
            assert row[f"n{k}"] == want, (values[row.i] if row.i >= 0 else None, needle)


# Words and their stems as the algorithm's description gives them.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory
consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling
consol consolingly consol consols consol knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish
knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
generate generat generic generic communication communic arsenal arsenal skies sky dying die news news happy happi cry cri by by say say
hoping hope hopping hop ties tie cries cri gas gas gaps gap kiwis kiwi abilities abil nationally nation sensibility sensibl
relational relat hopefulness hope rested rest hands hand agreed agre feed feed youth youth enjoy enjoy yes yes""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, want):
    from aphora.functions.english import stem

    assert stem(word) == want


def test_words_differ_from_their_stems_at_the_end_only():
    from aphora.functions.english import stem

    import itertools

    roots = ["hand", "rest", "happy", "gener", "ski", "abl", "lov", "run", "cry", "agre", "sensibl", "nation", "y", "ti", "logic", "gentl"]
    ends = ["", "s", "ed", "ing", "ly", "ies", "ied", "ational", "ization", "fulness", "iviti", "bility", "bli", "logi", "ement", "ion", "e", "ll", "eedly", "'s"]
    for parts in itertools.product(roots, ends, ends):
        word = "".join(parts)
        assert word.startswith(stem(word)[:-2]), word


def test_stems_of_lists(spark):
    from aphora.functions.english import query_stems, stems

    rows = spark.createDataFrame([(1, ["the", "hands", "", "rested", "hands"]), (2, []), (3, None), (4, ["and", None, "handing"])], "i int, w array<string>").repartition(1)
    got = {r.i: r.s for r in rows.select("i", stems(F.col("w")).alias("s")).collect()}
    assert got == {1: ["hand", "rest", "hand"], 2: [], 3: [], 4: ["hand"]}
    assert query_stems("The hands, resting!") == ["hand", "rest"] and query_stems("and the") == []


def test_english_search(spark):
    from aphora.plans import search

    quotes = spark.createDataFrame([(1, "Her hands rested.", None), (2, "Rest your hand", "x"), (3, "A handle restores", "y"), (4, "hand", "Restful Author"), (5, "the and", None)],
                                   "quote_id int, text string, author string")
    index = search.inverted_index(quotes, english=True)
    for query in ("hand rest", "the hands that rested"):
        direct = sorted(r.quote_id for r in search.search_english(quotes, query).collect())
        assert direct == [1, 2, 4]
        assert direct == sorted(r.quote_id for r in search.search_index(index, search.query_stems(query)).collect())
    assert search.search_english(quotes, "and the").count() == 0 == search.search_index(index, []).count()
