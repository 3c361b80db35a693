"""Text, JSON, URL and number-from-text column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a JavaScript regular expression counts as white space.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the same characters as a plain text.
SPACE_CHARACTERS = "\t\n\v\f\r \u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utf16_length(c: Column | str) -> Column:
    """The length as JavaScript counts it: characters beyond the basic plane, such as emoji, count as two."""
    text = _col(c)
    beyond = F.length(text) - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))
    # Few texts hold any; the others are measured without a search.
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(text) + beyond)


def trim(c: Column | str) -> Column:
    """Trim every white-space character, not only blanks."""
    return F.btrim(_col(c), F.lit(SPACE_CHARACTERS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def completion_text(c: Column | str) -> Column:
    """A completion without surrounding white space; empty ones become null."""
    return blank_to_null(trim(c))


def leading_integer(c: Column | str) -> Column:
    """The integer a text starts with (hexadecimal after ``0x``), null if there is none."""
    text = _col(c)
    sign = F.when(F.regexp_extract(text, rf"^{SPACE}*([+-]?)", 1) == "-", -1).otherwise(1)
    hexadecimal = blank_to_null(F.regexp_extract(text, rf"^{SPACE}*[+-]?0[xX]([0-9a-fA-F]+)", 1))
    decimal = blank_to_null(F.regexp_extract(text, rf"^{SPACE}*[+-]?([0-9]+)", 1))
    # Longer numbers than a bigint holds are none; ``conv`` would fail on them.
    digits = F.ltrim(hexadecimal, F.lit("0"))
    value = F.coalesce(F.when(F.length(digits) <= 16, F.conv(F.substring(F.concat(F.lit("0"), digits), 1, 17), 16, 10)), decimal)
    return sign * F.when(hexadecimal.isNull() | (F.length(digits) <= 16), value).try_cast("bigint")


def limit_param(c: Column | str, default: int = 5) -> Column:
    """A row limit from request text: anything that is not a number, and zero, gives the default."""
    return F.coalesce(F.nullif(leading_integer(c), F.lit(0)), F.lit(default)).cast("bigint")


def join_or(items: Column | str, default: str, separator: str = ", ") -> Column:
    """The list as one text, or the default where the list is empty or missing."""
    return F.coalesce(blank_to_null(F.array_join(_col(items), separator)), F.lit(default))


def non_empty_or(items: Column | str, default: list[str]) -> Column:
    """The list, or the default list where it is empty or missing."""
    c = _col(items)
    return F.when(F.size(F.coalesce(c, F.array())) > 0, c).otherwise(F.array(*[F.lit(d) for d in default]))


def text_or(c: Column | str, default: str) -> Column:
    """The text, or the default where it is empty or missing."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def lookup(c: Column | str, names: Mapping[str, str], default: Column | str | None = None) -> Column:
    """A label for each known value; the default (or null) for the others."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), _col(c))
    if default is None:
        return found
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


# What the prompt calls each length and language.
LENGTH_LABELS = {"short": "30-50 caractere", "medium": "80-120 caractere", "long": "150-200 caractere"}
LANGUAGE_LABELS = {"ro": "română", "en": "engleză"}


def length_label(c: Column | str) -> Column:
    return lookup(c, LENGTH_LABELS)


def language_label(c: Column | str) -> Column:
    return lookup(c, LANGUAGE_LABELS, _col(c))


def account_age_days(created: Column | str, as_of: Column) -> Column:
    """Whole periods of 24 hours since the account was made."""
    start, end = _col(created).cast("timestamp"), as_of.cast("timestamp")
    return F.floor((F.unix_millis(end) - F.unix_millis(start)) / 86_400_000).cast("bigint")


def display_name(identifier: Column | str) -> Column:
    """``sophia_calm`` as ``Sophia Calm``; only the first underscore separates."""
    return F.initcap(F.regexp_replace(_col(identifier), "^([^_]*)_", "$1 "))


# The marks a URI component keeps as they are although form encoding escapes them.
URI_KEEPS = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encode_component(c: Column | str) -> Column:
    """Percent-encode a text for use inside a URL."""
    out = F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    for escaped, mark in URI_KEEPS.items():
        out = F.replace(out, F.lit(escaped), F.lit(mark))
    return out


# Characters that sanitizing replaces, in order. The ampersand is not among them.
SANITIZED = {"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "`": "&#96;", "$": "&#36;"}


def sanitize(c: Column | str) -> Column:
    out = _col(c)
    for mark, entity in SANITIZED.items():
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def is_json(c: Column | str) -> Column:
    """Whether the text is one JSON value.

    Spark's parser stops after the first value and overlooks what follows. The text is one whole value only if it
    also parses as the element of a list and as the field of an object.
    """
    text = _col(c)
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return in_list & in_object


def json_or_raw(c: Column | str) -> Column:
    """Valid JSON in its compact form; any other text as it is."""
    text = _col(c)
    return F.when(is_json(text), F.to_json(F.try_parse_json(text))).otherwise(text)


def cache_key(*parts: Column | str) -> Column:
    """Parts joined by dashes; lists are written as JSON."""
    return F.concat_ws("-", *[_col(p) for p in parts])


def endpoint_key(method: Column | str, url: Column | str) -> Column:
    """``METHOD-host`` of a call; calls without a method count as GET."""
    host = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    return F.when(host.isNotNull(), F.concat_ws("-", text_or(method, "GET"), host))


# Null fields of a response are written, not left out.
KEEP_NULLS = {"ignoreNullFields": "false"}


def ok_envelope(**fields: Column) -> Column:
    """A successful response as JSON."""
    return F.to_json(F.struct(F.lit(True).alias("ok"), *[c.alias(n) for n, c in fields.items()]), KEEP_NULLS)


def error_envelope(message: Column, code: Column, details: Column | None = None) -> Column:
    """A failed response as JSON."""
    info = details if details is not None else F.create_map().cast("map<string,string>")
    error = F.struct(message.alias("message"), code.alias("code"), info.alias("details"))
    return F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error")), KEEP_NULLS)


def vector(c: Column | str, dimensions: int | None = None) -> Column:
    """A vector stored as JSON text; null if it does not have the expected number of dimensions."""
    parsed = F.from_json(_col(c), "array<float>")
    return parsed if dimensions is None else F.when(F.size(parsed) == dimensions, parsed)


def hashed_position(size: int | Column, *key: Column | str) -> Column:
    """A position from 0 to size - 1 that depends on the key alone: a repeatable stand-in for a random pick."""
    digest = F.md5(F.concat_ws(":", *[_col(k).cast("string") for k in key]))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, (F.lit(size) if isinstance(size, int) else size).cast("bigint")).cast("int")


def hashed_order(seed: int, *key: Column | str) -> Column:
    """A sort key that shuffles rows in a repeatable way."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in key]))


def backoff_ms(attempt: Column | str, initial: float = 300.0, factor: float = 2.0, cap: float = 10_000.0,
               jitter: float = 1.0) -> Column:
    """The wait before a retry: each wait is the one before times the factor, at most the cap, times the jitter.

    Jitter 0.8 and 1.2 give the bounds of the randomised wait, 1.0 its middle.
    """
    steps = F.when(_col(attempt) >= 1, F.sequence(F.lit(1), _col(attempt).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    grow = lambda wait, _: F.least(wait * F.lit(factor), F.lit(cap)) * F.lit(jitter)
    return F.aggregate(steps, F.lit(float(initial)), grow)


def doubling_backoff_ms(attempt: Column | str, initial: float = 400.0) -> Column:
    """The plain schedule: initial times two to the power of the attempt (from zero), without a cap."""
    return F.lit(float(initial)) * F.pow(F.lit(2.0), _col(attempt))
