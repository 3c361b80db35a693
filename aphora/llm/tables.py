"""Reading inputs, cutting lineage into the shared folder, and numbering rows without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aphora.session import shared_dir


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any others, whatever they are called, stay unread."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written below the shared folder and read from there: later steps do not depend on lost executors.

    Spark removes the shuffle files of a finished step when the driver collects garbage. A driver that only starts jobs makes
    little of it and would keep the files of all steps, so it is asked to.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], spread: Column, buckets: int, into: str) -> DataFrame:
    """Number the rows of every key gaplessly from 0, however many rows a key has.

    ``spread`` deals the rows of a key to ``buckets`` parts. A part is numbered by a window of its own; its offset is
    the number of rows in the parts before it, a running sum over at most ``buckets`` small rows.
    """
    dealt = df.withColumn("_part", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return (
        ranked.join(offsets, [*keys, "_part"])
        .withColumn(into, F.col("_before") + F.col("_rank"))
        .drop("_part", "_before", "_rank")
    )


def part_count(rows: int, per_part: int = 50_000) -> int:
    """How many parts keep the parts of one key near ``per_part`` rows."""
    return max(1, -(-rows // per_part))
