"""Newest, most frequent and sampled rows per key.

All of them end in ``row_number() <= n`` right above the window, which Spark turns into a group limit that
runs before the shuffle as well: a task sends at most n rows per key, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aphora.functions.text import hashed_order


def _columns(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1, position: str | None = None) -> DataFrame:
    """The first n rows of each key; ``order`` must be a total order so that the answer is unique."""
    rank = position or "_position"
    window = W.partitionBy(*keys).orderBy(*_columns(order))
    kept = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return kept if position else kept.drop(rank)


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str, n: int, position: str | None = None) -> DataFrame:
    """The newest n rows of each key, ties by the given column."""
    return first_per_key(df, keys, [F.col(at).desc(), F.col(tie).asc()], n, position)


def count_by(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(count))


def top_values(df: DataFrame, key: str, value: str, n: int, position: str = "position", count: str = "n") -> DataFrame:
    """The n most frequent values of each key, ties by value. Rows are counted before anything is ranked."""
    counts = count_by(df, [key, value], count)
    return first_per_key(counts, [key], [F.col(count).desc(), F.col(value).asc()], n, position)


def sample_per_key(df: DataFrame, keys: list[str], identifier: str, n: int, seed: int, position: str = "position") -> DataFrame:
    """A repeatable sample of n rows per key: the rows whose hashed id sorts first."""
    return first_per_key(df, keys, [hashed_order(seed, identifier), F.col(identifier)], n, position)


def ranked_list(df: DataFrame, key: str, position: str, item: Column, name: str) -> DataFrame:
    """One row per key with its items in position order. Only for ranked rows: the list is as long as the limit."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def newest(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The newest n rows overall."""
    return df.orderBy(F.col(at).desc(), F.col(tie).asc()).limit(n)


def highest(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n rows with the highest score."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)


def with_group_size(df: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    """Adds the number of rows of each key; for results that were already cut to a few rows per key."""
    return df.withColumn(name, F.count("*").over(W.partitionBy(key)))
