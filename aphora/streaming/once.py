"""Events consumed once, however late a copy comes.

A stream's own de-duplication forgets an event once the watermark has passed it. Here the ids of all consumed events are
kept, below one folder per day of their event, and next to them a Bloom filter of each day: bitmaps of ``BITS`` bits, of
which every id belongs to one by its hash, and sets ``HASHES`` bits in it. A batch asks the filters first. Only ids whose
bits are all set on some day are looked up, and only in the folders of these days; the lookup decides, so a
filter that says yes by chance costs reading and loses nothing. The filters of earlier batches are merged by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aphora.streaming import generations
from aphora.streaming.jobs import run_batches

#: Bits of one bitmap, as Spark's bitmap functions make them, and bits set per id.
BITS, HASHES = 32_768, 4
#: Bitmaps of a day: with 4,096 of them some ten million ids a day are told apart well.
BITMAPS = 4_096
_IDS, _FILTERS = "id string, day date", "day date, slot int, bits binary"
#: Events without a time belong to this day.
_NO_DAY = "1970-01-01"
#: More days than a history can have.
_MANY_DAYS = 1_000_000


def _id(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def _slot(bitmaps: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(bitmaps)).cast("int")


def _places() -> Column:
    """The bits an id sets in its bitmap."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col("id")), F.lit(BITS)) for i in range(1, HASHES + 1)])


def day_filters(ids: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """day, slot, bits: the Bloom filters of days from rows of day and id."""
    places = ids.select("day", _slot(bitmaps).alias("slot"), F.explode(_places()).alias("place"))
    return places.groupBy("day", "slot").agg(F.bitmap_construct_agg("place").alias("bits"))


def _merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy("day", "slot").agg(F.bitmap_or_agg("bits").alias("bits"))


def _all_set(bits: Column, places: Column) -> Column:
    """Whether the bitmap has all these bits: bit p is in byte p / 8, from the lowest bit on."""
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1

    return F.forall(places, is_set)


def maybe_seen(ids: DataFrame, filters: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """day and id for the ids that may have been consumed with an event of that day."""
    asked = ids.select("id", _slot(bitmaps).alias("slot"), _places().alias("places"))
    met = asked.join(filters, "slot").where(_all_set(F.col("bits"), F.col("places")))
    return met.select("day", "id").distinct()


def seen(spark: SparkSession, ids: DataFrame, history: str, batch_id: int, bitmaps: int = BITMAPS) -> DataFrame:
    """Those of the ids that batches before this one have consumed."""
    filters = generations.read(spark, f"{history}/filters", _FILTERS, before=batch_id).drop("_last")
    asked = f"{history}/asked"
    generations.write_batch(maybe_seen(ids, filters, bitmaps), asked, batch_id)
    generations.forget(spark, asked, batch_id)
    maybe = generations.read(spark, asked, _IDS, before=batch_id + 1, after=batch_id - 1).drop("_last")
    days = [row["day"] for row in maybe.select("day").distinct().take(_MANY_DAYS)]
    stored = generations.read(spark, f"{history}/ids", _IDS, before=batch_id).where(F.col("day").isin(days) if days else F.lit(False))
    return stored.join(maybe, ["day", "id"], "left_semi").select("id").distinct()


def consume_ever_once(stream: DataFrame, keys: list[str], out: str, history: str, checkpoint: str, at: str = "ts",
                      trigger: dict | None = None, bitmaps: int = BITMAPS, fanout: int = generations.FANOUT) -> StreamingQuery:
    """Write each event once (the earliest of its copies in the batch that brings the first), whatever the delay of others.

    Repeating a batch overwrites what it wrote and asks only the batches before it.
    """
    fields = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(_id(keys).alias("id")).agg(F.min_by(F.struct(*fields), F.struct(at)).alias("row"))
        known = seen(spark, first.select("id"), history, batch_id, bitmaps)
        generations.write_batch(first.join(known, "id", "left_anti").select("row.*"), out, batch_id)
        written = generations.read(spark, out, schema, before=batch_id + 1, after=batch_id - 1)
        ids = written.select(_id(keys).alias("id"), F.coalesce(F.to_date(at), F.lit(_NO_DAY).cast("date")).alias("day"))
        generations.write_batch(ids, f"{history}/ids", batch_id, ["day"])
        generations.write_batch(day_filters(ids, bitmaps), f"{history}/filters", batch_id)
        generations.compact(spark, f"{history}/filters", _FILTERS, batch_id, _merged, fanout)
        generations.compact(spark, f"{history}/ids", _IDS, batch_id, lambda rows: rows.drop("_last"), fanout, False, ["day"])
        generations.compact(spark, out, schema, batch_id, lambda rows: rows.drop("_last"), fanout, False)

    return run_batches(stream, write, checkpoint, trigger=trigger)


def consumed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return generations.read(spark, out, schema).drop("_last")
