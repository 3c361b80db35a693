"""How far the sources of a language differ in their words: exact divergences between sources, and their telling terms.

Documents with the same text are collapsed per language first: one text with the number of its copies per source, so it is
tokenised once and its counts and document frequencies are weighted. Counts per (language, source, term) are summed on the
map side before they are shuffled. A language keeps the terms that stand in ``min_docs`` of its documents. All
probabilities are whole billionths and all sums whole numbers, so that results do not depend on the order of work.

Pairs of sources are evaluated sparsely. ``f`` of a term that neither has is one number per pair. What a term of one source
adds against a source without it depends on its count alone, so the counts are summed up as a histogram per source and
met with the other sources. Only terms that both have are joined. The result names every pair of sources of a language;
no step makes more rows for a term, or a longer list for a text, than its language has (pairs of) sources.

Null language, source and text count as empty strings. Empty texts, and documents without a term, make their group appear.
Repeated rows count as often as they stand there. Ties rank by the bytes of the item. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aphora.llm.tables import stored
from aphora.llm.textmath import chunks, ragged

MIN_DOCS, TOP = 10, 10
UNIT = 1_000_000_000

#: Bytes of terms: letters A to Z in both cases and everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts as ``textmath.chunks`` gives them: the text of every term, its number, and the distinct terms by number."""
    solid = TERM[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(_LOWER[data[solid]])])
    coded = words.dictionary_encode()
    return np.searchsorted(offsets, starts, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1)) if len(key) else order
    return (ordered[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts and weighted document frequencies per language and source of some distinct texts."""
    for batch in batches:
        lists = batch["sources"]
        borders = lists.offsets.to_numpy()
        sources = lists.values.field("source").dictionary_encode()
        copies = lists.values.field("copies").to_numpy()
        source = sources.indices.to_numpy().astype(np.int64)
        langs = batch["lang"].dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)
        for lo, _, data, offsets in chunks(batch["text"], 4 << 20):
            text, term, names = terms_of(data, offsets)
            seen, times = np.unique(text * max(1, len(names)) + term, return_counts=True)
            text, term = lo + seen // max(1, len(names)), seen % max(1, len(names))
            owner, nth = ragged((borders[1:] - borders[:-1])[text])
            at = borders[text[owner]] + nth
            group = lang[text[owner]] * max(1, len(sources.dictionary)) + source[at]
            key, n, docs = _summed(group * max(1, len(names)) + term[owner], times[owner] * copies[at], copies[at])
            group, term = key // max(1, len(names)), key % max(1, len(names))
            found = [langs.dictionary.take(pa.array(group // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(group % max(1, len(sources.dictionary)))), names.cast(pa.string()).take(pa.array(term)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); equal texts of a language are read once."""
    keyed = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies"))
    held = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    found = texts.join(held, ["lang", "digest"]).select("lang", "sources", "text").mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in billionths, plus one; null where nothing is kept."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per source its divergence from each other source, and its ``top`` terms."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = stored(term_counts(read), "term-counts")
    kept = stored(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"),
        "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = stored(
        read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")])
        .withColumn("p0", share(none, F.col("total"), F.col("terms"))),
        "source-groups")
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    shares = stored(shares, "term-shares")

    one, other = groups.select("lang", "source", "p0", "terms"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    unlike = F.col("source") != F.col("item")
    base = apart(F.col("p0"), F.col("q0"))
    # Terms neither source has, as if no source had any: f of the two empty shares, once per kept term.
    empty = one.join(other, "lang").where(unlike).select("lang", "source", "item", F.coalesce(F.col("terms") * base, none).alias("value"))
    # Terms of one source, as if no other had them: what they add to that.
    steps = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = steps.join(other, "lang").where(unlike).groupBy("lang", "source", "item").agg(F.sum((apart(F.col("p"), F.col("q0")) - base) * F.col("times")).alias("value"))
    # Terms of both sources: what is right, in place of the two steps above.
    mate = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("p0").alias("q0"))
    right = apart(F.col("p"), F.col("p2")) - apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("p2")) + base
    both = shares.join(mate, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(right).alias("value"))
    half = alone.unionByName(both)
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = empty.unionByName(half).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    telling = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    listed = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    return listed.unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS (SELECT row, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT lang, g.source, term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
