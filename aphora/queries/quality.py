"""Queries that validate rows. Each checks kinds of values against the code the value must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.operators import quality as q
from aphora.queries.registry import joined, query
from aphora.sources.model import Model


def _by_kind(**values):
    """A value per event type."""
    out = None
    for kind, value in values.items():
        value = F.lit(value) if not hasattr(value, "alias") else value
        test = F.col("event_type") == kind
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


@query("validate_numbers", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 'raw:not_number' ELSE array_to_string(list_filter([
      CASE WHEN v < 10 THEN 'raw:min' END, CASE WHEN v > 60 THEN 'raw:max' END,
      CASE WHEN v <> floor(v) THEN 'raw:integer' END], lambda e: e IS NOT NULL), ',') END AS errors,
    CASE WHEN event_type = 'error' THEN -1 ELSE v END AS clean
  FROM (SELECT event_id, event_type, CAST(CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k + 0.5
    WHEN 'purchase' THEN CAST(concat('0x', CAST(k AS STRING)) AS BIGINT) WHEN 'signup' THEN 0 END AS DOUBLE) AS v FROM ev) x""")
def validate_numbers(m: Model) -> DataFrame:
    k = F.col("k").cast("string")
    raw = _by_kind(click=F.concat(F.lit(" "), k, F.lit(" ")), view=F.concat(k, F.lit(".5")), purchase=F.concat(F.lit("0x"), k),
                   signup="", error=F.concat(k, F.lit("d")))
    rows = m.ev.select("event_id", raw.alias("raw"))
    checked = q.validate(rows, {"raw": q.Rule("number", minimum=10, maximum=60, integer=True)})
    return checked.select("event_id", joined("errors").alias("errors"), F.coalesce("raw__clean", F.lit(-1.0)).alias("clean"))


@query("validate_strings", """
  SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'text:min_length' END,
    CASE WHEN length(text) > 5000 THEN 'text:max_length' END, CASE WHEN NOT regexp_matches(text, 'the') THEN 'text:pattern' END],
    lambda e: e IS NOT NULL), ',') AS errors, md5(replace(replace(replace(replace(replace(replace(
    text, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '`', '&#96;'), '$', '&#36;')) AS clean_md5 FROM documents""")
def validate_strings(m: Model) -> DataFrame:
    rule = q.Rule("string", required=True, min_length=200, max_length=5000, pattern="the", sanitize=True)
    checked = q.validate(m.raw("documents").select("doc_id", "text"), {"text": rule})
    return checked.select("doc_id", joined("errors").alias("errors"), F.md5("text__clean").alias("clean_md5"))


@query("validate_booleans", """
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'raw:not_boolean' WHEN 'error' THEN 'raw:required' ELSE '' END AS errors,
    CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'true' WHEN 'purchase' THEN 'false' ELSE 'none' END AS clean FROM ev""")
def validate_booleans(m: Model) -> DataFrame:
    raw = _by_kind(click="true", view="1", purchase="0", signup="TRUE", error="")
    checked = q.validate(m.ev.select("event_id", raw.alias("raw")), {"raw": q.Rule("boolean", required=True)})
    clean = F.coalesce(F.col("raw__clean").cast("string"), F.lit("none"))
    return checked.select("event_id", joined("errors").alias("errors"), clean.alias("clean"))


@query("validate_dates", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 'raw:date' WHEN 'signup' THEN '' ELSE array_to_string(list_filter([
      CASE WHEN v < TIMESTAMP '2024-01-05 00:00:00' THEN 'raw:min_date' END,
      CASE WHEN v > TIMESTAMP '2024-01-25 00:00:00' THEN 'raw:max_date' END], lambda e: e IS NOT NULL), ',') END AS errors,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN v END AS clean
  FROM (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
    WHEN 'view' THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS v FROM ev) x""")
def validate_dates(m: Model) -> DataFrame:
    raw = _by_kind(
        click=F.date_format("ts", "yyyy-MM-dd"), view=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        purchase=F.date_format("ts", "yyyy-MM-dd HH:mm"), error=F.concat(F.lit("2024-13-"), F.col("k").cast("string")),
    )
    rule = q.Rule("date", min_date="2024-01-05 00:00:00", max_date="2024-01-25 00:00:00")
    checked = q.validate(m.ev.select("event_id", raw.alias("raw")), {"raw": rule})
    return checked.select("event_id", joined("errors").alias("errors"), F.col("raw__clean").cast("timestamp_ntz").alias("clean"))


@query("validate_date_forms", """
  SELECT event_id, CASE WHEN k % 9 = 7 THEN 'raw:date' WHEN k % 9 = 8 THEN 'raw:date' ELSE '' END AS errors,
    CASE k % 9 WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
      WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', ts) - INTERVAL 150 MINUTES WHEN 5 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
      WHEN 6 THEN date_trunc('millisecond', ts) END AS clean FROM ev""")
def validate_date_forms(m: Model) -> DataFrame:
    """Dates as people write them, and days and hours that do not exist."""
    shown = lambda form: F.date_format("ts", form)
    forms = [
        shown("MMM d, yyyy"), shown("d MMMM yyyy HH:mm"), shown("yyyy/MM/dd"), F.concat(shown("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.concat(shown("M/d/yyyy hh:mm a"), F.lit(" +0230")), F.concat(shown("EEEE, MMMM d"), F.lit("th "), shown("yyyy")),
        shown("yyyy.MM.dd HH:mm:ss.SSS"), F.concat(F.lit("Feb 30, "), shown("yyyy")), F.concat(shown("yyyy/MM/dd"), F.lit(" 24:10"))]
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(F.col("k") % 9 == i, form).otherwise(raw)
    checked = q.validate(m.ev.select("event_id", raw.alias("raw")), {"raw": q.Rule("date", required=True)})
    return checked.select("event_id", joined("errors").alias("errors"), F.col("raw__clean").cast("timestamp_ntz").alias("clean"))


def _even_share(count: float) -> object:
    """A check as a caller would write it: it passes, refuses with a text, refuses, or fails."""
    if 100 % count == 0:
        return True
    return "odd" if count % 2 else False


@query("validate_custom", """
  SELECT event_id, CASE WHEN k > 60 THEN 'k:max' WHEN k = 0 THEN 'k:custom_failed:float modulo by zero' WHEN 100 % k = 0 THEN ''
    WHEN k % 2 = 1 THEN 'k:custom:odd' ELSE 'k:custom' END AS errors, k <= 60 AND k > 0 AND 100 % greatest(k, 1) = 0 AS valid FROM ev""")
def validate_custom(m: Model) -> DataFrame:
    """A check written in Python, whose exceptions are errors of their rows. It does not see values above the maximum."""
    checked = q.validate(m.ev.select("event_id", "k"), {"k": q.Rule("number", maximum=60, test=_even_share)})
    return checked.select("event_id", joined("errors").alias("errors"), "valid")


@query("validate_arrays", """
  SELECT event_id, CASE k % 7 WHEN 0 THEN 'items:min_items' WHEN 1 THEN '' WHEN 2 THEN 'items:item[1]:required'
    WHEN 3 THEN 'items:item[1]:required' WHEN 4 THEN 'items:item[1]:required;items:item[3]:min_length'
    WHEN 5 THEN 'items:item[1]:required;items:item[3]:min_length' ELSE 'items:max_items' END AS errors FROM ev""")
def validate_arrays(m: Model) -> DataFrame:
    source = F.array(*[F.lit(x) for x in ("bb", "", "ccc", "d", "ee", "ff")])
    rows = m.ev.select("event_id", F.slice(source, F.lit(1), (F.col("k") % 7).cast("int")).alias("items"))
    rule = q.Rule("array", items=q.Rule("string", required=True, min_length=2), min_items=1, max_items=5)
    return q.validate(rows, {"items": rule}).select("event_id", joined("errors", ";").alias("errors"))


@query("validate_objects", """
  SELECT event_id, concat_ws(';', CASE WHEN event_type = 'error' THEN 'body:missing:kind' END,
    CASE WHEN event_type = 'click' THEN 'body:count:not_number' WHEN k > 50 THEN 'body:count:max' END,
    CASE WHEN event_type = 'view' THEN 'body:not_allowed:extra' END) AS errors,
    CASE event_type WHEN 'signup' THEN 'none' WHEN 'error' THEN 'unknown' ELSE event_type END AS kind FROM ev""")
def validate_objects(m: Model) -> DataFrame:
    """Objects as maps: a required key, a number, a default and a key that is not allowed."""
    k = F.col("k").cast("string")
    kind = F.when(F.col("event_type") == "signup", "none").otherwise(F.col("event_type"))
    count = F.when(F.col("event_type") == "click", "many").otherwise(k)
    body = F.map_filter(
        F.create_map(F.lit("kind"), kind, F.lit("count"), count, F.lit("extra"), F.lit("x")),
        lambda key, _: ((key != "extra") | (F.col("event_type") == "view")) & ((key != "kind") | (F.col("event_type") != "error")),
    )
    rule = q.Rule("object", required_keys=("kind",), additional=False, properties={
        "kind": q.Rule("string", default="unknown"), "count": q.Rule("number", maximum=50),
    })
    checked = q.validate(m.ev.select("event_id", body.alias("body")), {"body": rule})
    return checked.select("event_id", joined("errors", ";").alias("errors"), F.col("body__clean.kind").alias("kind"))


# The patterns of an address, an identifier, a link and a safe text in the statement below.
@query("validate_formats", r"""
  SELECT page_id, concat_ws(';', CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 'email:email' END,
    CASE WHEN NOT regexp_matches(code, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'code:uuid' END,
    CASE WHEN NOT regexp_matches(link, '(?i)^(https?)://[^\s$.?#].[^\s]*$') THEN 'link:url' END,
    CASE WHEN NOT regexp_matches(url, '^[^<>''"`;=]*$') THEN 'url:pattern' END) AS errors
  FROM (SELECT page_id, url, concat(regexp_extract(url, '://([a-z]+)', 1), CASE WHEN page_id % 3 = 0 THEN '' ELSE '@' END,
      'example.org') AS email, concat(substr(md5(url), 1, 8), '-', substr(md5(url), 9, 4), '-', substr(md5(url), 13, 4), '-',
      substr(md5(url), 17, 4), '-', substr(md5(url), 21, 12)) AS code, CASE WHEN page_id % 2 = 0 THEN url ELSE substr(url, 5) END AS link
    FROM pages) x""")
def validate_formats(m: Model) -> DataFrame:
    digest = F.md5("url")
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    host = F.regexp_extract("url", "://([a-z]+)", 1)
    rows = m.raw("pages").select(
        "page_id", "url", F.concat(host, F.when(F.col("page_id") % 3 == 0, "").otherwise("@"), F.lit("example.org")).alias("email"),
        F.concat_ws("-", *parts).alias("code"),
        F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.substring("url", 5, 100000)).alias("link"),
    )
    rules = {"email": q.Rule("email"), "code": q.Rule("uuid"), "link": q.Rule("url"), "url": q.Rule("string", pattern=q.SAFE_STRING)}
    return q.validate(rows, rules).select("page_id", joined("errors", ";").alias("errors"))


@query("quarantine", """
  SELECT user_id, CASE WHEN length(email) % 2 = 0 AND user_id % 4 = 0 THEN 'lang:required;email:custom'
    WHEN user_id % 4 = 0 THEN 'lang:required' ELSE 'email:custom' END AS errors FROM (
    SELECT user_id, concat(email, CASE WHEN user_id % 3 = 0 THEN 'x' ELSE '' END) AS email FROM users) x
  WHERE user_id % 4 = 0 OR length(email) % 2 = 0""")
def quarantine(m: Model) -> DataFrame:
    """Rejected accounts with their reasons; one rule is the caller's own."""
    people = m.users.select("user_id", "lang", "subscription_tier", "subscription_status",
                            F.concat("email", F.when(F.col("user_id") % 3 == 0, "x").otherwise("")).alias("email"))
    rules = {"lang": q.Rule("string", required=True), **q.USER_RULES}
    rules["email"] = q.Rule("string", required=True, max_length=255, check=lambda c: F.length(c) % 2 == 1)
    _, bad = q.split_valid(q.validate(people, rules))
    return bad.select("user_id", joined("errors", ";").alias("errors"))


@query("valid_moods", """
  SELECT id, mood, energy_level FROM (SELECT id, mood, energy_level * 2 AS energy_level FROM mood_tracking) x WHERE energy_level <= 10""")
def valid_moods(m: Model) -> DataFrame:
    """Rows that meet the table's constraints."""
    doubled = m.mood_tracking.select("id", "mood", (F.col("energy_level") * 2).alias("energy_level"))
    good, _ = q.split_valid(q.validate(doubled, q.MOOD_RULES))
    return good.select("id", "mood", "energy_level")


@query("validate_request", """
  SELECT event_id, concat_ws('|', CASE WHEN k < 5 THEN 'params=user_id:min' END,
    CASE WHEN event_type = 'error' THEN 'query=count:not_number' END,
    CASE WHEN event_type = 'signup' THEN 'body=kind:enum' END) AS errors, NOT (k < 5 OR event_type IN ('error', 'signup')) AS valid FROM ev""")
def validate_request(m: Model) -> DataFrame:
    """Parts of a request, each with its own errors; any error rejects the request."""
    rows = m.ev.select("event_id", F.col("k").alias("user_id"), F.col("event_type").alias("kind"),
                       F.when(F.col("event_type") == "error", "x").otherwise("3").alias("count"))
    parts = {
        "params": {"user_id": q.Rule("number", required=True, minimum=5)},
        "query": {"count": q.Rule("number", integer=True)},
        "body": {"kind": q.Rule("enum", values=("click", "view", "purchase", "error"))},
    }
    checked = q.validate_parts(rows, parts)
    listed = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return checked.select("event_id", joined(listed, "|").alias("errors"), "valid")


@query("personalize_rules", """
  SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 'body:missing:topics' WHEN request_id % 7 = 0 THEN 'body:topics:min_items'
      ELSE '' END AS errors, CASE WHEN request_id % 2 = 0 THEN style ELSE 'motivational' END AS style FROM personalize_requests""")
def personalize_rules(m: Model) -> DataFrame:
    n = F.col("request_id")
    none = F.array().cast("array<string>")
    topics = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, none).otherwise(F.col("topics"))
    body = F.struct("preferences", topics.alias("topics"), F.when(n % 2 == 0, F.col("style")).alias("style"), "length", "language")
    checked = q.validate(m.personalize_requests.select("request_id", body.alias("body")), {"body": q.PERSONALIZE_RULES})
    return checked.select("request_id", joined("errors", ";").alias("errors"), F.col("body__clean.style").alias("style"))


@query("feedback_rules", """
  SELECT event_id, concat_ws(';', CASE WHEN k % 10 = 0 THEN 'body:quoteId:required' END,
    CASE WHEN event_type = 'view' THEN 'body:feedback:enum' END) AS errors, k % 10 <> 0 AS valid_as_is FROM ev""")
def feedback_rules(m: Model) -> DataFrame:
    """The strict rules, and whether the row passes the lenient ones, which leave the vocabulary unchecked."""
    verdict = F.when(F.col("event_type") == "view", "meh").otherwise("like")
    quote = F.when(F.col("k") % 10 == 0, "").otherwise(F.col("k").cast("string"))
    rows = m.ev.select("event_id", F.struct(quote.alias("quoteId"), verdict.alias("feedback"), F.lit(None).cast("string").alias("details")).alias("body"))
    lenient = q.validate(rows, {"body": q.FEEDBACK_RULES}).select("event_id", "body", F.col("valid").alias("valid_as_is"))
    strict = q.validate(lenient, {"body": q.FEEDBACK_RULES}, strict=True)
    return strict.select("event_id", joined("errors", ";").alias("errors"), "valid_as_is")
