"""Token search over quotes, directly and through an inverted index, by words as they are or by English stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.functions.english import query_stems, stems

# Anything that is neither letter nor digit separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), SEPARATOR)


def searchable(quotes: DataFrame) -> Column:
    """Text and author as one searchable text."""
    author = F.coalesce("author", F.lit("")) if "author" in quotes.columns else F.lit("")
    return F.concat_ws(" ", F.col("text"), author)


def search(quotes: DataFrame, terms: list[str]) -> DataFrame:
    """Quotes that contain every term. One pass, no shuffle: each row answers for itself.

    A text without a term as a substring cannot have it as a token; only the others are split into tokens.
    """
    wanted = [t.lower() for t in terms]
    text = searchable(quotes)
    lowered = F.lower(text)
    possible = F.lit(True)
    for term in wanted:
        possible = possible & lowered.contains(term)
    absent = F.array_except(F.array(*[F.lit(t) for t in wanted]), tokens(text))
    return quotes.where(possible).where(F.size(absent) == 0)


def search_english(quotes: DataFrame, query: str) -> DataFrame:
    """Quotes that hold, in any form, every word of the query that is no stop word; a query of stop words finds none.

    One pass, no shuffle. A stem and its words differ in their endings only, so a text must hold all but the last two letters
    of every stem; only texts that do are split and stemmed.
    """
    wanted = query_stems(query)
    lowered = F.lower(searchable(quotes))
    possible = F.lit(bool(wanted))
    for term in wanted:
        possible = possible & lowered.contains(term[: max(1, len(term) - 2)])
    found = quotes.where(possible)
    absent = F.array_except(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), stems(tokens(searchable(found))))
    return found.where(F.size(absent) == 0)


def inverted_index(quotes: DataFrame, english: bool = False) -> DataFrame:
    """One row per quote and distinct term. Frequent terms stay many rows; no list of quotes is collected.

    With ``english`` the terms are stems without stop words; ask such an index for the terms that ``query_stems`` gives.
    """
    found = F.array_distinct(tokens(searchable(quotes)))
    term = F.explode(F.array_distinct(stems(found)) if english else found).alias("term")
    return quotes.select("quote_id", term).where(F.col("term") != "")


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the index by term hash, so that a search reads only the folders of its terms.

    The number of buckets is part of every folder's name: tables written with other numbers may be appended.
    """
    placed = index.withColumn("buckets", F.lit(buckets)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    ordered = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
    ordered.write.mode("append").partitionBy("buckets", "bucket").parquet(path)


def search_index(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of the quotes that contain every term; an entry that was appended twice counts once. No term finds nothing."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.where(F.col("term").isin(wanted))
    if "bucket" in index.columns:
        folder = F.lit(False)
        for term in wanted:
            folder = folder | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(term)), F.col("buckets")))
        hits = hits.where(folder)
    found = hits.select("quote_id", "term").distinct().groupBy("quote_id").agg(F.count("*").alias("_n"))
    return found.where(F.col("_n") == len(wanted)).select("quote_id")
