"""Row filters. All are plain predicates that reach the Parquet scan where the source allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora import dimensions


def quote_filter(quotes: DataFrame, category: str | None = None, mood: str | None = None,
                 exclude_premium: bool = False) -> DataFrame:
    """Optional filters of the catalogue; quotes without tags or mood match no tag or mood filter."""
    out = quotes.where(~F.col("premium")) if exclude_premium else quotes
    if category:
        out = out.where(F.coalesce(F.array_contains("tags", category), F.lit(False)))
    if mood:
        out = out.where(F.col("mood") == mood)
    return out


def user_generated(quotes: DataFrame) -> DataFrame:
    return quotes.where("user_generated")


def within(df: DataFrame, at: str, as_of: Column, interval: str) -> DataFrame:
    """Rows newer than the interval before ``as_of``."""
    return df.where(F.col(at) > as_of - F.expr(f"INTERVAL {interval}"))


def with_status(users: DataFrame, status: str = "active") -> DataFrame:
    return users.where(F.col("subscription_status") == status)


def audio_entitlement(users: DataFrame) -> DataFrame:
    """Adds whether audio is allowed and, if not, why."""
    free = F.col("subscription_tier") == "free"
    return users.withColumns({
        "audio_allowed": ~free,
        "audio_denial": F.when(free, F.lit("audio_requires_subscription")),
    })


def starts_with(df: DataFrame, column: str, prefix: str | Column) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def level_rank(level: Column) -> Column:
    """The place of a log level in their order; unknown levels have none."""
    pairs = [F.lit(x) for rank, name in enumerate(dimensions.LOG_LEVELS) for x in (name, rank)]
    return F.try_element_at(F.create_map(*pairs), F.lower(level))


def at_least_level(df: DataFrame, minimum: str, column: str = "level") -> DataFrame:
    """Log rows of the minimum level and above; a level outside the list is never dropped."""
    rank = level_rank(F.col(column))
    return df.where(F.coalesce(rank >= dimensions.LOG_LEVELS.index(minimum), F.lit(True)))


# The subsets the data model keeps at hand.
def billed_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("stripe_customer_id").isNotNull())


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("is_active")


def traced_audit(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("request_id").isNotNull())


def public_collections(collections: DataFrame) -> DataFrame:
    return collections.where("is_public")


def premium_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.where(F.col("premium_tier").isNotNull())


def has_json_key(details: Column, key: str) -> Column:
    """The key is present and not JSON null."""
    return F.get_json_object(details, f"$.{key}").isNotNull()


def has_json_key_strict(details: Column, key: str) -> Column:
    """The key is present, even with JSON null as its value."""
    return F.try_variant_get(F.try_parse_json(details), f"$.{key}", "variant").isNotNull()


def json_field_is(details: Column, path: str, wanted: str) -> Column:
    """The field at a JSON path holds the value, given as JSON."""
    found = F.to_json(F.try_variant_get(F.try_parse_json(details), f"$.{path}", "variant"))
    return F.coalesce(found == wanted, F.lit(False))


def _equal_scalar(found: Column, wanted: object) -> Column:
    """Whether a JSON value is this string, number, truth value or null; numbers compare by value, ``1`` is ``1.0``."""
    if wanted is None:
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    kind = F.schema_of_variant(found)
    if isinstance(wanted, str):
        same = (kind == "STRING") & (F.try_variant_get(found, "$", "string") == wanted)
    elif isinstance(wanted, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == wanted)
    else:
        number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
        if isinstance(wanted, int) and abs(wanted) < 10**20:
            # Whole numbers are compared in full; as doubles large ones would fall together.
            same = number & (F.try_variant_get(found, "$", "decimal(38,18)") == F.lit(wanted).cast("decimal(38,18)"))
        else:
            same = number & (F.try_variant_get(found, "$", "double") == float(wanted))
    return F.coalesce(same, F.lit(False))


def variant_contains(found: Column, needle: object) -> Column:
    """Whether a JSON value holds the needle: an object all its fields, a list for each of its items one that holds it.

    A value that is no list or object equals the needle. The needle is walked when the plan is built; each of its parts
    becomes a condition.
    """
    if isinstance(needle, dict):
        fields = F.try_variant_get(found, "$", "map<string,variant>")
        held = fields.isNotNull()
        for name, inner in needle.items():
            held = held & F.coalesce(variant_contains(F.try_element_at(fields, F.lit(name)), inner), F.lit(False))
        return F.coalesce(held, F.lit(False))
    if isinstance(needle, (list, tuple)):
        items = F.try_variant_get(found, "$", "array<variant>")
        held = items.isNotNull()
        for inner in needle:
            held = held & F.coalesce(F.exists(items, _holding(inner)), F.lit(False))
        return F.coalesce(held, F.lit(False))
    return _equal_scalar(found, needle)


def _holding(needle: object):
    return lambda item: variant_contains(item, needle)


def json_contains(details: Column, needle: object) -> Column:
    """Whether JSON text holds the needle (a Python value) at its top: what is no JSON holds nothing.

    As an exception, a list holds a string, number, truth value or null that is one of its items.
    """
    parsed = F.try_parse_json(details)
    held = variant_contains(parsed, needle)
    return held if isinstance(needle, (dict, list, tuple)) else held | variant_contains(parsed, [needle])


def tags_include(tags: Column, wanted: list[str]) -> Column:
    """The list holds every wanted tag."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0, F.lit(False))
