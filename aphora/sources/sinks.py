"""Appending and exporting. Every writer is one distributed write; none rewrites what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.session import shared_dir


def surrogate_id(*keys: str | Column) -> Column:
    """A 60-bit id computed from the natural key: no global numbering, the same on every retry."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def audit_rows(df: DataFrame, action: str | Column, details: list[str], user: str = "user_id",
               at: str = "created_at") -> DataFrame:
    """Audit rows whose payload is the JSON of the named columns."""
    label = F.lit(action) if isinstance(action, str) else action
    return df.select(
        F.col(user).alias("user_id"),
        label.alias("action"),
        F.to_json(F.struct(*details)).alias("details"),
        F.col(at).alias("created_at"),
    )


def append_by_day(df: DataFrame, path: str, at: str = "created_at", rows_per_file: int = 5_000_000) -> None:
    """Append events below one folder per day.

    ``rebalance`` brings a day's rows together so that a write does not leave one file per task and day,
    and lets AQE split a day that is too large for one task.
    """
    dated = df.withColumn("dt", F.to_date(at)).hint("rebalance", F.col("dt"))
    writer = dated.write.mode("append").partitionBy("dt").option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def append_generated(existing_path: str, new_rows: DataFrame) -> None:
    """Add rows to the generated-quote table without reading or rewriting the existing ones."""
    new_rows.write.mode("append").parquet(existing_path)


def bounded_files(df: DataFrame, path: str, rows_per_file: int, fmt: str = "text") -> None:
    """Many files of at most the given number of rows, as a rolling log would leave."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def export(df: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    """The whole table as JSON lines, CSV or Parquet part files."""
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown export format {fmt}")
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def array_files(df: DataFrame, path: str, block: Column, note: str) -> None:
    """Files of JSON arrays with a comment at the top, one per block, as the catalogue's files are kept by hand.

    A file is put together in one row, so ``block`` must bound the rows that share it.
    """
    rows = df.select(block.alias("block"), F.to_json(F.struct(*df.columns)).alias("row"))
    lines = rows.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list("row")), ",\n  ").alias("rows"))
    text = F.concat(F.lit(f"// {note} "), F.col("block").cast("string"), F.lit("\n[\n  "), F.col("rows"), F.lit("\n  // end\n]\n"))
    lines.select("block", text.alias("value")).write.partitionBy("block").text(path)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read from there: what is needed several times is worked out once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
