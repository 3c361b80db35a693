"""Reading tables, catalogue files and logs with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aphora import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the given folder; the path may be a file or a folder of part files."""
    return spark.read.schema(schemas.INPUT_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def canonical(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table that is already in the canonical model."""
    return spark.read.format(fmt).schema(schemas.CANONICAL[name]).load(path)


def query(spark: SparkSession, sql: str, params: dict | list | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised statement; values travel as parameters, tables as named arguments."""
    return spark.sql(sql, args=params, **views) if views else spark.sql(sql, args=params)


def jdbc(
    spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    bounds = {"partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    return reader.options(**bounds).options(**options).load()


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array and may carry ``//`` comments.

    A row that does not fit fails the read: the permissive mode would silently shorten the table.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("allowComments", True)
    return reader.option("mode", "FAILFAST").json(path)


def quote_file(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.QUOTE_FILE)


def generated_quotes(spark: SparkSession, path: str) -> DataFrame:
    """The file of generated quotes, its creation time (epoch milliseconds) as a timestamp."""
    rows = json_array(spark, path, schemas.GENERATED_FILE)
    return rows.select("text", "category", "lang", epoch_ms_to_timestamp(F.col("createdAt")).alias("created_at"))


def collection_file(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.COLLECTION_FILE)


def category_file(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.CATEGORY_FILE)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def epoch_ms_to_timestamp(ms):
    return F.timestamp_millis(ms)
