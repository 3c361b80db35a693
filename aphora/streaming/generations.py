"""Tables that a stream writes batch by batch, kept in few folders.

Every batch is a folder ``span=n-n``. Folders of earlier batches are merged into one ``span=first-last``, which counts from the
moment its job is committed (the ``_SUCCESS`` file), so a reader sees either the old folders or the new one. What a merged
folder covers is removed when a later batch is written: by then the batches it holds are committed in the stream's
checkpoint, and readers of the batch before have had their time. A merge that failed leaves a folder without ``_SUCCESS``;
it is overlooked, and removed as well. One stream writes a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPAN = re.compile(r"span=([0-9]+)-([0-9]+)$")
#: So many folders of a kind are merged into one.
FANOUT = 16


def _listed(spark: SparkSession, folder: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The spans in a folder: those committed, and those not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done, open_ones = [], []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        found = _SPAN.match(status.getPath().getName())
        if found:
            committed = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            (done if committed else open_ones).append((int(found[1]), int(found[2])))
    return done, open_ones


def _path(folder: str, span: tuple[int, int]) -> str:
    return f"{folder}/span={span[0]}-{span[1]}"


def _live(done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that no other span covers, in order."""
    return sorted(s for s in done if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in done))


def live_spans(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    return _live(_listed(spark, folder)[0])


def read(spark: SparkSession, folder: str, schema: str, before: int | None = None, after: int = -1) -> DataFrame:
    """The rows of all batches (of those before one, after one), with ``_last``, the last batch of their folder."""
    paths = [_path(folder, s) for s in live_spans(spark, folder) if (before is None or s[1] < before) and s[0] > after]
    last = F.split("span", "-")[1].cast("bigint")
    if not paths:
        return spark.createDataFrame([], f"{schema}, _last bigint")
    rows = spark.read.schema(f"{schema}, span string").option("basePath", folder).parquet(*paths)
    return rows.withColumn("_last", last).drop("span")


def _remove(spark: SparkSession, folder: str, spans: list[tuple[int, int]]) -> None:
    for span in spans:
        path = spark._jvm.org.apache.hadoop.fs.Path(_path(folder, span))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_batch(rows: DataFrame, folder: str, batch_id: int, partition_by: list[str] = []) -> None:
    """Write a batch, or write it again; what merged folders cover, and merges that failed, are removed first."""
    spark = rows.sparkSession
    done, open_ones = _listed(spark, folder)
    gone = [s for s in done if s not in _live(done)] + [s for s in open_ones if s[0] < s[1]]
    _remove(spark, folder, gone)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(_path(folder, (batch_id, batch_id)))


def forget(spark: SparkSession, folder: str, before: int) -> None:
    """Remove the folders of batches before the given one, for tables of which only the newest batch counts."""
    _remove(spark, folder, [s for s in live_spans(spark, folder) if s[1] < before])


def _due(spans: list[tuple[int, int]], fanout: int, whole: bool) -> tuple[int, int] | None:
    """The span to merge next. Without ``whole``, neighbours of about one size are merged, so that a row is rewritten
    only as often as the number of batches has digits to the base of ``fanout``."""
    if whole:
        return (spans[0][0], spans[-1][1]) if len(spans) > fanout else None
    level = lambda s: len(_digits(s[1] - s[0] + 1, fanout))
    for size in sorted({level(s) for s in spans}):
        same = [s for s in spans if level(s) == size]
        if len(same) >= fanout:
            return same[0][0], same[fanout - 1][1]
    return None


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, rest = divmod(n, base)
        out.append(rest)
    return out


def compact(spark: SparkSession, folder: str, schema: str, before: int, merge: Callable[[DataFrame], DataFrame],
            fanout: int = FANOUT, whole: bool = True, partition_by: list[str] = []) -> bool:
    """Merge folders of batches before the given one, which must be committed in the checkpoint, if there are enough.

    ``merge`` takes the rows with ``_last`` and returns rows without it. With ``whole`` one folder remains of them all.
    """
    spans = [s for s in live_spans(spark, folder) if s[1] < before]
    due = _due(spans, fanout, whole)
    if due is None:
        return False
    rows = read(spark, folder, schema, before=due[1] + 1, after=due[0] - 1)
    writer = merge(rows).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(_path(folder, due))
    return True
