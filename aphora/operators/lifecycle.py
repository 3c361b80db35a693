"""Keeping tables in order: uniqueness, upserts, defaults, retention and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.operators.ranking import first_per_key


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; a column one of them lacks is null there."""
    return existing.unionByName(new, allowMissingColumns=True)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given total order."""
    return first_per_key(df, keys, order)


def duplicates(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def unseen_events(events: DataFrame, consumed: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Events to process: the first copy of each one that was not consumed before."""
    return keep_first(events, keys, order).join(consumed.select(*keys), keys, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str, at: str, tie: str, columns: list[str], as_of: Column) -> DataFrame:
    """Merge the newest update of each key into the table.

    Values an update leaves null keep their old value. ``updated_at`` is set on rows an update touched;
    unknown keys become new rows with ``created_at`` set as well. Both sides are unique by key when joined.
    """
    newest = first_per_key(updates, [key], [F.col(at).desc(), F.col(tie).desc()])
    changes = newest.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed"))
    base = base if "updated_at" in base.columns else base.withColumn("updated_at", F.col("created_at"))
    known = base.withColumn("_known", F.lit(True))
    merged = known.join(changes, key, "full_outer")
    changed, new = F.col("_changed").isNotNull(), F.col("_known").isNull()
    stamped = {
        **{c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns},
        "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at")),
        "created_at": F.when(new, as_of).otherwise(F.col("created_at")),
    }
    return merged.withColumns(stamped).select(*base.columns)


# What a row gets for columns it was inserted without.
USER_DEFAULTS = {"subscription_tier": "free", "subscription_status": "inactive", "email_verified": False}
QUOTE_DEFAULTS = {"language": "EN", "score": 0}
SHARE_DEFAULTS = {"image_style": "minimal", "include_attribution": True, "click_count": 0}


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill nulls, and add the columns that are missing altogether."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def expired_before(at: str, as_of: Column, interval: str) -> Column:
    return F.col(at) < as_of - F.expr(f"INTERVAL {interval}")


def audit_expired(as_of: Column, at: str = "created_at") -> Column:
    """Audit rows are kept for a year."""
    return expired_before(at, as_of, "1 YEAR")


def metric_expired(as_of: Column, at: str = "metric_ts") -> Column:
    """Metrics are kept for 90 days."""
    return expired_before(at, as_of, "90 DAYS")


def session_expired(as_of: Column) -> Column:
    """Expired sessions, and inactive ones unused for 30 days."""
    return (F.col("expires_at") < as_of) | (~F.col("is_active") & expired_before("last_used_at", as_of, "30 DAYS"))


def purge(df: DataFrame, expired: Column) -> DataFrame:
    """What a delete leaves behind: rows whose condition is unknown are kept."""
    return df.where(~F.coalesce(expired, F.lit(False)))


def sweep_report(name: str, df: DataFrame, expired: Column) -> DataFrame:
    """How many rows of a table stay and go."""
    gone = F.coalesce(expired, F.lit(False))
    counts = df.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("purged"))
    return counts.select(F.lit(name).alias("table_name"), "kept", "purged")


def expiry(at: Column, ttl_seconds: Column) -> Column:
    """When an entry expires; a missing, zero or negative lifetime means never."""
    return F.when(ttl_seconds > 0, at + F.make_dt_interval(secs=ttl_seconds.cast("decimal(18,6)")))


def live_entries(writes: DataFrame, keys: list[str], at: str, tie: str, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """The last write of each key, if it has not expired."""
    last = first_per_key(writes, keys, [F.col(at).desc(), F.col(tie).desc()])
    return last.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def live_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens that are neither revoked nor expired."""
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of))


def insert_if_absent(rows: DataFrame, candidates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table with the candidates it does not hold yet; ``is_new`` marks them. Other columns come along.

    A row that is held stays, also with a null time; of several copies of a key the smallest is kept. One aggregation decides both questions (is the key there, which copy comes first), so copies of a hot key
    collapse before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (*keys, at)]
    given = [F.col(c) if c in candidates.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest]
    tagged = rows.select(*keys, F.lit(True).alias("_held"), F.struct(at, *rest).alias("_row"))
    offered = candidates.select(*keys, F.lit(False).alias("_held"), F.struct(F.col(at).cast(rows.schema[at].dataType).alias(at), *given).alias("_row"))
    held = F.col("_held")
    merged = tagged.unionByName(offered).groupBy(*keys).agg(
        F.max("_held").alias("_held"), F.min(F.when(held, F.col("_row"))).alias("_old"), F.min(F.when(~held, F.col("_row"))).alias("_new"))
    kept = F.when(F.col("_held"), F.col("_old")).otherwise(F.col("_new"))
    return merged.select(*keys, *[kept[c].alias(c) for c in (at, *rest)], (~F.col("_held")).alias("is_new"))
