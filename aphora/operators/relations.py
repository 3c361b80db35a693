"""Lookups and referential integrity as joins.

Joins are equi-joins on ids. Their sides are not hinted: sizes are measured at run time, small sides become
broadcasts and skewed partitions are split by AQE. Only tables whose rows are listed in
``aphora.dimensions`` are broadcast by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every request with the row it names; ``found`` tells whether there is one."""
    marked = rows.withColumn("_hit", F.lit(True))
    return requests.join(marked, key, "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def existing(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return requests.join(rows.select(key), key, "left_semi")


def missing(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return requests.where(F.col(key).isNotNull()).join(rows.select(key), key, "left_anti")


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key names no parent; a null foreign key is not a violation."""
    parents = parent.select(F.col(key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(parents, foreign_key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left of a table after its deleted parents took their rows along."""
    return child.join(deleted.select(key), key, "left_anti")


def cascade_collections(collections: DataFrame, members: DataFrame, deleted_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting users removes their collections, and those the rows in them."""
    gone = collections.join(deleted_users.select("user_id"), "user_id", "left_semi")
    return cascade_delete(collections, deleted_users, "user_id"), cascade_delete(members, gone, "collection_id")


def set_null(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows stay, but lose a reference to a deleted parent."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col(key))
    return child.join(gone, key, "left").withColumn(key, kept).drop("_gone").select(*child.columns)


def with_dimension(df: DataFrame, dimension: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join one of the fixed tables of ``aphora.dimensions``; their size is a constant of the code."""
    return df.join(F.broadcast(dimension), on, how)
