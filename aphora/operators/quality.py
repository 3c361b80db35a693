"""Declarative row validation with coercion.

Rules are turned into column expressions when the plan is built; no row visits Python, but for rules with a ``test``, a
Python function of a value. Each rule gives error codes and a cleaned value, and a row is valid when there is no code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aphora import dimensions
from aphora.functions.text import SPACE, sanitize, trim, utf16_length

# The formats of the named kinds of text.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
URL = rf"(?i)^(https?)://[^$.?#{SPACE[1:-1]}].[^{SPACE[1:-1]}]*\z"
SAFE_STRING = r"""^[^<>'"`;=]*\z"""

ISO_DATE = (
    r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01])"
    r"([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?)?\z"
)
NUMBER = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"
# Fixed value: the latest time a date can hold, in milliseconds.
MAX_TIME = 8.64e15
RADIX_NUMBERS = {16: r"^0[xX]([0-9a-fA-F]+)\z", 8: r"^0[oO]([0-7]+)\z", 2: r"^0[bB]([01]+)\z"}


@dataclass(frozen=True)
class Rule:
    """What a value must look like. ``kind`` is one of string, number, boolean, email, date, array, object, enum,
    uuid and url; the other fields apply to the kinds they name.

    ``check`` is a condition on the cleaned value as a column, ``test`` a function of the cleaned value in Python: it passes
    with ``True``, refuses with a text (or anything else), and an exception it raises becomes an error of that value alone.
    Both see only values that met the rest of the rule. A ``test`` is not possible for the items of a list.
    """

    kind: str
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    sanitize: bool = False
    minimum: float | None = None
    maximum: float | None = None
    integer: bool = False
    min_date: str | None = None
    max_date: str | None = None
    min_items: int | None = None
    max_items: int | None = None
    items: Rule | None = None
    properties: dict[str, Rule] | None = None
    required_keys: tuple[str, ...] = ()
    additional: bool = True
    values: tuple = ()
    default: object = None
    check: Callable[[Column], Column] | None = None
    test: Callable[[object], object] | None = None


# Error codes travel as one text while a rule is compiled and become a list at the very end: text functions stay
# inside generated code, functions over lists with a lambda do not.
_MARK = "\u0001"


@dataclass
class _Result:
    """The cleaned value, and error texts: each is null, one code, or several with marks between them."""

    clean: Column
    texts: list[Column] = field(default_factory=list)

    def errors(self) -> Column:
        """All error codes as one text, null if there are none."""
        if not self.texts:
            return F.lit(None).cast("string")
        return self.texts[0] if len(self.texts) == 1 else F.nullif(F.concat_ws(_MARK, *self.texts), F.lit(""))


@dataclass(frozen=True)
class _Context:
    """What holds for a whole set of rules: strictness, and the columns that already hold a value and its parsed form."""

    strict: bool = False
    slots: dict[str, tuple[Column, Column | None]] = field(default_factory=dict)
    in_list: bool = False


def _codes(prefix: str, *problems: tuple[Column, str]) -> list[Column]:
    return [F.when(problem, F.lit(prefix + code)) for problem, code in problems]


def _listed(text: Column) -> Column:
    """A text of error codes as a list."""
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, _MARK))


def _digits(digits: Column, base: int) -> Column:
    """The number that digits denote. ``conv`` fails beyond 64 bits, so longer ones are summed up as doubles."""
    exact = {16: 15, 8: 20, 2: 60}[base]
    short = F.conv(F.substring(digits, 1, exact), base, 10).try_cast("double")
    add = lambda total, digit: total * F.lit(float(base)) + F.conv(digit, base, 10).try_cast("double")
    return F.when(F.length(digits) <= exact, short).otherwise(F.aggregate(F.split(digits, ""), F.lit(0.0), add))


def js_number(text: Column) -> Column:
    """The number a text denotes as a whole: blank is zero, ``0x10`` is 16, ``5d`` is none."""
    t = trim(text)
    value = F.when(t.rlike(NUMBER), t.try_cast("double")).when(t == "", F.lit(0.0))
    value = value.when(t.rlike(r"^[+]?Infinity\z"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    for base, pattern in RADIX_NUMBERS.items():
        value = value.when(t.rlike(pattern), _digits(F.regexp_extract(t, pattern, 1), base))
    return value


def js_boolean(text: Column) -> Column:
    """``true`` and ``1``, ``false`` and ``0``, exactly as written; anything else is none."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


# Other ways to write a date: an optional weekday, the date in one of four orders, and an optional time with a zone.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
_WEEKDAY = r"(?:(?:sun|mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?)(?:day)?\.?,? +)?"
_CLOCK = r"(?:(?:,? +| *t)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(?: *([ap]m))?(?: *(z|(?:gmt|utc)?[+-][0-9]{1,2}:?[0-9]{2}|gmt|utc))?(?: *\([^()]*\))?)?"
# The order of year, month and day within the pattern of each form.
_DATE_FORMS = {
    rf"{_MONTH} +([0-9]{{1,2}})(?:st|nd|rd|th)?,? +([0-9]{{4}})": (3, 1, 2),
    rf"([0-9]{{1,2}})(?:st|nd|rd|th)?[ -]+{_MONTH},?[ -]+([0-9]{{4}})": (3, 2, 1),
    r"([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})": (1, 2, 3),
    r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})": (3, 1, 2),
}


def _written_date(text: Column) -> Column:
    """Dates such as ``Jan 5, 2024``, ``Fri, 5 January 2024 10:00 GMT``, ``2024/01/05`` and ``1/5/2024 3:07 pm`` (month first).

    The first form that fits as a whole decides; it is brought to one order of parts, and the parts make the time. Impossible days
    and times are none. Without a zone the time counts as UTC.
    """
    lowered = F.lower(trim(text))
    unified = F.lit(None).cast("string")
    for form, (year, month, day) in _DATE_FORMS.items():
        pattern = rf"^{_WEEKDAY}{form}{_CLOCK}\z"
        parts = rf"${year}|${month}|${day}|$4|$5|$6|$7|$8|$9"
        unified = F.coalesce(unified, F.when(lowered.rlike(pattern), F.regexp_replace(lowered, pattern, parts)))
    part = lambda i: F.split(unified, r"\|", 9)[i]
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).try_cast("int")
    named = F.position(F.concat(F.lit(" "), F.substring(part(1), 1, 3)), F.lit("".join(f" {m}" for m in MONTHS)))
    month = F.when(part(1).rlike("^[0-9]"), number(1)).otherwise(((named + 3) / 4).cast("int"))
    half = part(7)
    hour = F.when(half == "", F.when(number(3) <= 23, number(3))).otherwise(
        F.when(number(3).between(1, 12), number(3) % 12 + F.when(half == "pm", 12).otherwise(0)))
    second = F.when(number(5) <= 59, F.concat(number(5).cast("string"), F.lit("."), F.rpad(part(6), 6, "0")).try_cast("decimal(8,6)"))
    offset = F.regexp_extract(part(8), r"([+-])([0-9]{1,2}):?([0-9]{2})$", 0)
    minutes = F.when(offset == "", F.lit(0)).otherwise(
        F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int")
        * (F.regexp_extract(offset, r"^.([0-9]{1,2}?):?([0-9]{2})$", 1).try_cast("int") * 60 + F.regexp_extract(offset, r"([0-9]{2})$", 1).try_cast("int")))
    local = F.try_make_timestamp(number(0), month, number(2), hour, F.when(number(4) <= 59, number(4)), second, F.lit("UTC"))
    return F.when(unified.isNotNull(), local - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def js_date(text: Column) -> Column:
    """ISO dates and times, and some other ways to write them; without a zone they count as UTC."""
    return F.when(text.rlike(ISO_DATE), F.try_to_timestamp(text)).otherwise(_written_date(text))


def parse_value(value: Column, kind: T.DataType, rule: Rule) -> Column:
    """The value as the kind of the rule, null where it is not one. Other kinds are taken as they are."""
    text, numeric = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    if rule.kind == "number":
        if text:
            return js_number(value)
        if numeric:
            return F.when(~F.isnan(value.cast("double")), value.cast("double"))
        return value.cast("double") if isinstance(kind, T.BooleanType) else F.lit(None).cast("double")
    if rule.kind == "boolean":
        if text:
            return js_boolean(value)
        if numeric:
            return F.when(value == 1, True).when(value == 0, False)
        return value if isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")
    if rule.kind == "date":
        if text:
            return js_date(value)
        if numeric:
            # The range of valid times, in milliseconds either side of 1970; others are no dates.
            return F.when(F.abs(value.cast("double")) <= MAX_TIME, F.timestamp_millis(value.try_cast("bigint")))
        zoned = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        return value.cast("timestamp") if zoned else F.lit(None).cast("timestamp")
    return value


def _string(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    if not isinstance(kind, T.StringType):
        return _Result(value, [F.lit(prefix + "type")])
    problems = []
    if rule.min_length is not None:
        problems.append((utf16_length(value) < rule.min_length, "min_length"))
    if rule.max_length is not None:
        problems.append((utf16_length(value) > rule.max_length, "max_length"))
    if rule.pattern is not None:
        problems.append((~value.rlike(rule.pattern), "pattern"))
    if ctx.strict and rule.values:
        problems.append((~value.isin(*rule.values), "enum"))
    return _Result(sanitize(value) if rule.sanitize else value, _codes(prefix, *problems))


def _number(number: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    problems = [(number.isNull(), "not_number")]
    if rule.minimum is not None:
        problems.append((number < F.lit(float(rule.minimum)), "min"))
    if rule.maximum is not None:
        problems.append((number > F.lit(float(rule.maximum)), "max"))
    if rule.integer:
        whole = (number == F.rint(number)) & (F.abs(number) < F.lit(float("inf")))
        problems.append((~whole, "integer"))
    return _Result(number, _codes(prefix, *problems))


def _boolean(flag: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    return _Result(flag, _codes(prefix, (flag.isNull(), "not_boolean")))


def _date(moment: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    problems = [(moment.isNull(), "date")]
    if rule.min_date is not None:
        problems.append((moment < F.lit(rule.min_date).cast("timestamp"), "min_date"))
    if rule.max_date is not None:
        problems.append((moment > F.lit(rule.max_date).cast("timestamp"), "max_date"))
    return _Result(moment, _codes(prefix, *problems))


def _format(pattern: str, code: str):
    def compiled(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
        fits = value.rlike(pattern) if isinstance(kind, T.StringType) else F.lit(False)
        return _Result(value, _codes(prefix, (~fits, code)))

    return compiled


def _enum(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    fits = value.isin(*rule.values) if rule.values else F.lit(False)
    return _Result(value, _codes(prefix, (~fits, "enum")))


def _array(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    if not isinstance(kind, T.ArrayType):
        return _Result(value, [F.lit(prefix + "not_array")])
    size, sized, problems = F.size(value), F.lit(True), []
    if rule.min_items is not None:
        problems.append((size < rule.min_items, "min_items"))
    if rule.max_items is not None:
        problems.append((size > rule.max_items, "max_items"))
    for problem, _ in problems:
        sized = sized & ~problem
    texts = _codes(prefix, *problems)
    if rule.items is None:
        return _Result(value, texts)
    item, inside = rule.items, _Context(ctx.strict, in_list=True)

    def of_item(x: Column, i: Column) -> Column:
        found = compile_rule(x, kind.elementType, item, inside).errors()
        named = F.concat(F.lit(f"{prefix}item["), i.cast("string"), F.lit("]:"), F.replace(found, F.lit(_MARK), F.lit(",")))
        return F.when(found.isNotNull(), named)

    per_item = F.nullif(F.array_join(F.transform(value, of_item), _MARK), F.lit(""))
    texts.append(F.when(sized, per_item))
    if not _rewrites(item):
        return _Result(value, texts)
    return _Result(F.transform(value, lambda x: compile_rule(x, kind.elementType, item, inside).clean), texts)


def _rewrites(rule: Rule) -> bool:
    """Whether the cleaned value can differ from the value."""
    return rule.sanitize or rule.kind in ("number", "boolean", "date", "object", "array")


def _property(name: str, present: Column, value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> tuple[Column, Column]:
    """Error text of one property, prefixed with its name, and its cleaned value."""
    result = compile_rule(value, kind, rule, ctx, f"{prefix}{name}:")
    text = F.when(present, result.errors())
    if ctx.strict and rule.required:
        text = text.when(~present, F.lit(f"{prefix}{name}:required"))
    clean = result.clean
    if rule.default is not None:
        clean = F.when(present, clean).otherwise(F.lit(rule.default))
    return text, clean


def _field(value: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    """A property of an object that is a struct or a map, and its type."""
    if isinstance(kind, T.MapType):
        return F.try_element_at(value, F.lit(name)), kind.valueType
    if name in kind.fieldNames():
        return value.getField(name), kind[name].dataType
    return F.lit(None).cast("string"), T.StringType()


def _object(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str) -> _Result:
    properties = rule.properties
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        present = {n: value.getField(n).isNotNull() for n in names}
        has = lambda n: present.get(n, F.lit(False))
    elif isinstance(kind, T.MapType):
        has = lambda n: F.map_contains_key(value, n)
        names = None
    else:
        return _Result(value, [F.lit(prefix + "not_object")])
    if properties is None:
        return _Result(value)

    texts = _codes(prefix, *[(~has(n), f"missing:{n}") for n in rule.required_keys])
    cleaned = []
    for name, inner in properties.items():
        column, inner_kind = _field(value, kind, name)
        text, clean = _property(name, has(name), column, inner_kind, inner, ctx, prefix)
        texts.append(text)
        cleaned.append(clean.alias(name))
    refused = f"{prefix}not_allowed:"
    if names is None:
        known = F.array(*[F.lit(n) for n in properties])
        extra = F.array_except(F.map_keys(value), known)
        if rule.additional:
            cleaned.append(F.map_filter(value, lambda k, _: ~F.array_contains(known, k)).alias("additional"))
        else:
            texts.append(F.when(F.size(extra) > 0, F.concat(F.lit(refused), F.array_join(extra, _MARK + refused))))
    else:
        others = [n for n in names if n not in properties]
        if rule.additional:
            cleaned += [value.getField(n).alias(n) for n in others]
        else:
            texts += [F.when(present[n], F.lit(refused + n)) for n in others]
    return _Result(F.struct(*cleaned), texts)


def _tested(value: Column, test: Callable[[object], object]) -> Column:
    """Error code of each value that is not null, null if the test passed it. Values go to Python in Arrow batches."""
    def verdict(v: object) -> str | None:
        if v is None:
            return None
        try:
            answer = test(v)
        except Exception as problem:  # whatever a test raises is an error of this value
            return f"custom_failed:{problem}".replace(_MARK, " ")
        return None if answer is True else f"custom:{answer}".replace(_MARK, " ") if isinstance(answer, str) and answer else "custom"

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([verdict(v) for v in values.to_pylist()], pa.string())

    return run(value)


_KINDS = {
    "string": _string, "number": _number, "boolean": _boolean, "date": _date, "array": _array, "object": _object,
    "enum": _enum, "email": _format(EMAIL, "email"), "uuid": _format(UUID, "uuid"), "url": _format(URL, "url"),
}


def compile_rule(value: Column, kind: T.DataType, rule: Rule, ctx: _Context, prefix: str = "") -> _Result:
    """Error codes, each with the prefix, and cleaned value of one column under one rule.

    A required value that is missing or blank has that one error. An optional null is valid as it is.
    """
    value, usable = ctx.slots.get(prefix, (value, None))
    usable = parse_value(value, kind, rule) if usable is None else usable
    compiled = _KINDS.get(rule.kind)
    result = compiled(usable, kind, rule, ctx, prefix) if compiled else _Result(value, [F.lit(prefix + "type")])
    found = result.errors()
    if rule.check is not None:
        passed = F.coalesce(rule.check(result.clean), F.lit(False))
        found = F.coalesce(found, F.when(~passed, F.lit(prefix + "custom")))
    if rule.test is not None:
        if ctx.in_list:
            raise ValueError("items of a list cannot be tested in Python")
        code = _tested(F.when(found.isNull() & value.isNotNull(), result.clean), rule.test)
        found = F.coalesce(found, F.concat(F.lit(prefix), code))
    absent = value.isNull()
    text = F.when(~absent, found)
    if rule.required:
        blank = absent | (value == "") if isinstance(kind, T.StringType) else absent
        text = F.when(blank, F.lit(prefix + "required")).otherwise(found)
    return _Result(F.when(~absent, result.clean), [text])


_PARSED_KINDS = ("number", "boolean", "date")


def _compiled(df: DataFrame, rules: dict[str, Rule], strict: bool) -> tuple[DataFrame, dict[str, _Result]]:
    """The rules over a table to which properties and parsed values were added as columns.

    A rule names its value many times; as a column it is taken out of its object, and parsed, only once.
    """
    schema = df.schema
    values: dict[str, Column] = {}
    parsed: dict[str, Column] = {}
    slots: dict[str, tuple[Column, Column | None]] = {}

    def stage(prefix: str, column: Column, value: Column, kind: T.DataType, rule: Rule) -> None:
        ready = None
        if rule.kind in _PARSED_KINDS:
            name = f"_parsed_{len(parsed)}"
            parsed[name], ready = parse_value(column, kind, rule), F.col(name)
        slots[prefix] = (column, ready)
        if rule.kind == "object" and rule.properties and isinstance(kind, (T.StructType, T.MapType)):
            for field_name, inner in rule.properties.items():
                extracted, inner_kind = _field(value, kind, field_name)
                name = f"_value_{len(values)}"
                values[name] = extracted
                stage(f"{prefix}{field_name}:", F.col(name), extracted, inner_kind, inner)

    for name, rule in rules.items():
        stage(f"{name}:", F.col(name), F.col(name), schema[name].dataType, rule)
    staged = df.withColumns(values) if values else df
    staged = staged.withColumns(parsed) if parsed else staged
    ctx = _Context(strict, slots)
    return staged, {name: compile_rule(F.col(name), schema[name].dataType, rule, ctx, f"{name}:") for name, rule in rules.items()}


def _text_of(results: dict[str, _Result], names) -> Column:
    return F.concat_ws(_MARK, *[results[name].errors() for name in names])


def validate(df: DataFrame, rules: dict[str, Rule], strict: bool = False) -> DataFrame:
    """Adds ``<column>__clean`` for every rule, ``errors`` (``column:code``) and ``valid``."""
    staged, results = _compiled(df, rules, strict)
    checked = staged.select(
        *df.columns, *[r.clean.alias(f"{name}__clean") for name, r in results.items()],
        _text_of(results, rules).alias("_errors"),
    )
    return checked.withColumns({"errors": _listed(F.col("_errors")), "valid": F.col("_errors") == ""}).drop("_errors")


def validate_parts(df: DataFrame, parts: dict[str, dict[str, Rule]], strict: bool = False) -> DataFrame:
    """Validate the parts of a request (params, query, body, headers), each a set of columns.

    ``errors`` maps each failed part to its errors; any error rejects the row.
    """
    every = {name: rule for rules in parts.values() for name, rule in rules.items()}
    if len(every) != sum(len(rules) for rules in parts.values()):
        raise ValueError("a column belongs to one part only")
    staged, results = _compiled(df, every, strict)
    checked = staged.select(*df.columns, *[_text_of(results, rules).alias(f"_errors_{part}") for part, rules in parts.items()])
    entries = [x for part in parts for x in (F.lit(part), _listed(F.col(f"_errors_{part}")))]
    clean = [F.col(f"_errors_{part}") == "" for part in parts]
    valid = clean[0]
    for c in clean[1:]:
        valid = valid & c
    errors = F.map_filter(F.create_map(*entries), lambda _, e: F.size(e) > 0)
    return checked.select(*df.columns, errors.alias("errors"), valid.alias("valid"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the bookkeeping, and the quarantine with the reasons."""
    return checked.where("valid").drop("errors", "valid"), checked.where("NOT valid").drop("valid")


# Rule sets that come with the package.
# The personalisation request.
PERSONALIZE_RULES = Rule(
    "object",
    properties={
        "preferences": Rule("array", items=Rule("string"), min_items=1, max_items=5),
        "topics": Rule("array", items=Rule("string"), min_items=1, max_items=5),
        "style": Rule("string", default="motivational"),
        "length": Rule("string", values=("short", "medium", "long"), default="medium"),
        "language": Rule("string", default="ro"),
    },
    required_keys=("preferences", "topics"),
)
# The feedback request.
FEEDBACK_RULES = Rule("object", properties={
    "quoteId": Rule("string", required=True),
    "feedback": Rule("string", values=("like", "dislike", "neutral"), required=True),
    "details": Rule("string"),
})
# Constraints of the tables; like a CHECK, an enum or a range passes on null unless the column is required.
USER_RULES = {
    "email": Rule("string", required=True, max_length=255),
    "subscription_tier": Rule("enum", values=tuple(dimensions.TIERS)),
    "subscription_status": Rule("enum", values=tuple(dimensions.STATUSES)),
}
MOOD_RULES = {
    "mood": Rule("string", required=True, max_length=50),
    "energy_level": Rule("number", minimum=1, maximum=10),
}
