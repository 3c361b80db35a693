"""Benchmark decontamination: documents that hold ten consecutive words of a benchmark item.

A prefix-filtered set join for full containment. The shingles of an item are its windows of ``width`` words (an item of
fewer words is one window). A document that contains a window contains all its tokens, so one token is a sufficient
prefix; the tokens are ordered by their frequency in all documents, and each window is joined on its rarest token only.
The token's place in the window gives the only possible place of the window in the document (positional bound); windows
that would reach beyond the document are dropped (length bound); the rest are verified word by word.

Everything is a DataFrame expression. The windows' table is broadcast only if its measured size is small; a larger one is
joined by shuffling the document tokens, and candidates fetch their document's words afterwards.

Null or wordless texts have no words; items without words match nothing. An item without an id hits as any other does, but is not
listed: ``n_items`` counts item ids. Repeated documents are each returned, repeated items count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import stored

WIDTH = 10
#: Largest benchmark, in windows and in bytes of their words, whose tables are sent to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII."""
    split = F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(F.coalesce(split, F.array().cast("array<string>")), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, gram, words): every distinct window of every item."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    size = F.least(F.lit(width), F.size("words"))
    starts = worded.select("item_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    grams = starts.select("item_id", F.slice("words", F.col("at"), F.col("size")).alias("words"))
    return grams.select("item_id", F.xxhash64("words").alias("gram"), "words").distinct()


def _tokens(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, words, at, word): one row per word of a document, after a base row at -1 without a word."""
    worded = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    opened = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    return worded.select("row", "doc_id", F.size("words").alias("n"), "words", F.posexplode(opened).alias("place_", "word")).select(
        "row", "doc_id", "n", "words", (F.col("place_") - 1).alias("at"), "word")


def _anchors(grams: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """(word, place, words, gram): every window with its rarest token over all documents (ties: the smaller word)."""
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = grams.select(F.explode("words").alias("word")).distinct()
    counts = stored(tokens.select("word").join(hint(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    placed = grams.select("gram", "words", F.posexplode("words").alias("place", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("gram").agg(
        F.first("words").alias("words"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("best"))
    return ranked.select(F.col("best.word").alias("word"), F.col("best.place").alias("place"), F.col("words").alias("wanted"), "gram")


def _found(docs: DataFrame, anchors: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """(row, doc_id, n, start, stop, gram): the base row of every document, and one row per verified occurrence."""
    start, stop = F.col("at") - F.col("place"), F.col("at") - F.col("place") + F.size("wanted")
    fits = (start >= 0) & (stop <= F.col("n"))
    verified = fits & (F.slice("words", start + 1, F.size("wanted")) == F.col("wanted"))
    found = ["row", "doc_id", "n", start.alias("start"), stop.alias("stop"), "gram"]
    if small:
        return tokens.join(F.broadcast(anchors), "word", "left").where((F.col("at") < 0) | verified).select(*found)
    base = tokens.where("at < 0").select("row", "doc_id", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("stop", "int"), ("gram", "bigint"))])
    met = tokens.select("row", "n", "at", "word").join(anchors, "word").where(fits).select("row", "at", "place", "wanted", "gram").distinct()
    worded = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", words_of(F.col("text")).alias("words")).dropDuplicates(["row"])
    return base.unionByName(met.join(worded.withColumn("n", F.size("words")), "row").where(verified).select(*found))


def _hits(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n) of every document, copies included; (row, n_hit, items) of the contaminated texts, each once, stored."""
    windows = stored(item_windows(items, width), "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("words", " "))).alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    grams = windows.select("gram", "words").dropDuplicates(["gram"])
    tokens = _tokens(docs.select("doc_id", "text"))
    anchors = stored(_anchors(grams, tokens, small), "anchors")
    found = stored(_found(docs, anchors, tokens, small), "found")
    merge = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("sum"), F.greatest(acc["end"], x["stop"]).alias("end")),
        lambda acc: acc["sum"])
    met = found.where("gram is not null")
    spans = met.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select("row", merge.cast("long").alias("n_hit"))
    names = met.select("row", "gram").distinct().join(windows.select("item_id", "gram"), "gram").groupBy("row").agg(F.collect_set("item_id").alias("items"))
    return found.where("gram is null").select("row", "doc_id", "n"), stored(spans.join(names, "row"), "hits")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (``row`` names id and text)."""
    rows, hits = _hits(docs, items, width)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    # The hits are a stored table with one row per text, so a text that many rows share does not hold up the join.
    return rows.join(hits, "row", "left").select(
        "row", "doc_id", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(listed), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any window of a benchmark item, all columns as they were."""
    dirty = _hits(docs, items, width)[1].select(F.col("row").alias("_row"))
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(dirty, "_row", "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
t AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, p, size, item FROM t JOIN g USING (size, gram)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
