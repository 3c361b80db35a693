"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set of word shingles (five words; a shorter text is one shingle). Darts are thrown at every
shingle's regions: its weight axis is cut into regions of doubling width, and each region receives a Poisson process of
darts, generated in order of rank from a hash of (shingle, region). A dart also has a height, which must lie below the
shingle's weight, and a coordinate; the signature keeps the earliest dart of every coordinate. Two signatures agree in a
coordinate with a probability equal to the weighted Jaccard similarity. As ranks come in order, only about
k ln k + 2k darts of a document are ever made, however many shingles it has.

Signatures are cut into bands, and documents that share a band are candidates. Equal texts are merged first. In a bucket
each document meets the smallest one, not all others; candidates are checked on their exact shingle sets, and the links
found are merged to components. Buckets that still hold several components then go on, with another document in the
middle, and at last with every remaining pair of different components: pairs inside a component can add nothing. So a
group of n copies costs about n checks. Before texts are fetched, and inside the join that makes the last pairs, a sketch
(some bits of every coordinate) leaves out pairs that agree so rarely that a link at the threshold would do so with a
probability of at most ``LOSS`` (the bands lose about one such link in 55,000), and above it more rarely still. For the last
pairs the documents left in open buckets get sketches four times as long: those leave out pairs below 0.745, the first ones
below 0.705.

Texts without words (empty, blank) have no shingles: they join only the texts equal to them. Null texts stand alone. What is
signed, linked and merged are rows, named by a hash of id and text, so texts that share an id, or have none, are all
compared; repeated rows with the same id and text collapse into one. The class id is the smallest document id of the class;
an id whose texts are in several classes is listed with each. Rows without an id link others but are not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.components import components
from aphora.llm.tables import stored
from aphora.llm.textmath import CHUNK_BYTES, U, Words, mix, ragged, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 36
ROWS = 6
#: Coordinates of a signature, a power of two up to 2048. The first BANDS x ROWS make the bands, all make the sketch.
COORDINATES = 512
#: Bits of each coordinate in a sketch.
BITS = 4
#: Coordinates and bits of the longer sketches of documents in buckets that stay open to the end.
LONG, LONG_BITS = 2048, 2
#: Further documents in the middle of an unsettled bucket before its remaining pairs are listed.
MIDDLES = 1
#: A pair is left out if its sketches agree so rarely that a link's would with at most this probability.
LOSS = 1e-7
#: Largest number of rows of pairs whose names (eight bytes each) are sent to every executor.
BROADCAST_ROWS = 2_000_000


def shingle_sets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, hash, number of occurrences, ordered by document and hash."""
    n = np.diff(words.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc, place = ragged(count)
    lo = words.first[doc] + place
    hash_ = words.runs(lo, np.minimum(lo + width, words.first[doc + 1]))
    order = np.lexsort((hash_, doc))
    doc, hash_ = doc[order], hash_[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
    at = np.flatnonzero(new)
    return doc[at], hash_[at], np.diff(np.append(at, len(doc)))


def _unit(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1] from the upper bits of a hash."""
    return ((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs x k) of weighted sets given as rows; a document without rows keeps the largest value throughout.

    ``k`` is a power of two up to 2048. A dart's hash gives its waiting time by the upper bits and its coordinate by the
    lower ones. The value of a coordinate holds the rank of its earliest dart above, and bits of that hash below.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full(docs * k, empty, np.uint64)
    mass = np.bincount(doc, weight, docs)
    reach = np.where(mass > 0, (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-300), 0.0)
    todo, partial = mass > 0, bool((weight < 1).any())
    while todo.any():
        rows = np.flatnonzero(todo[doc])
        region = 0
        while len(rows):
            low, width = float((1 << region) - 1), float(1 << region)
            rows = rows[weight[rows] > low]
            live = rows
            h = mix(element[live] ^ mix(np.uint64(region + 1) * np.full(1, 0x9E3779B97F4A7C15, np.uint64)))
            rank = -np.log(_unit(h)) / width
            while True:
                near = rank <= reach[doc[live]]
                live, h, rank = live[near], h[near], rank[near]
                if not len(live):
                    break
                hit = weight[live] >= low + width * _unit(mix(h ^ U(0x5851F42D4C957F2D))) if partial or region else slice(None)
                place = doc[live][hit] * k + (h[hit] & U(k - 1)).astype(np.int64)
                value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | ((h[hit] >> U(9)) & U(0xFFFFFFFF))
                np.minimum.at(out, place, value)
                h = mix(h + U(0x9E3779B97F4A7C15))
                rank = rank - np.log(_unit(h)) / width
            region += 1
        todo &= (out.reshape(docs, k) == empty).any(1)
        reach = np.where(todo, reach * 2, reach)
    return out.reshape(docs, k)


def signatures(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bands: int = BANDS, rows: int = ROWS,
               shingle: int = SHINGLE, coordinates: int = COORDINATES, bits: int = BITS) -> DataFrame:
    """(id, bands, sketch): one hash per band of the signature, some bits per coordinate. Documents without words are left out."""
    limit = CHUNK_BYTES * COORDINATES // coordinates

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_chunks(batch["text"], limit):
                doc, element, _ = shingle_sets(words, shingle)
                full = np.flatnonzero(np.bincount(doc, minlength=hi - lo))
                dense = np.searchsorted(full, doc)
                drawn = dart_signatures(dense, element, np.ones(len(doc)), len(full), coordinates)
                keys = np.zeros((len(full), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ drawn[:, r : bands * rows : rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                sketch = _sketch(drawn, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(lo, hi - lo).take(pa.array(full)),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel().view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, sketch.shape[1], dtype=np.int32), sketch.ravel().view(np.int64))],
                    ["id", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sign, "id bigint, bands array<bigint>, sketch array<bigint>")


def _sketch(drawn: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Some bits of every coordinate, as many coordinates to a number as it holds."""
    shift = np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_or.reduce((mix(drawn) >> U(64 - bits)).reshape(len(drawn), -1, 64 // bits) << shift, axis=2)


def _least_agreeing(k: int, chance: float, loss: float) -> int:
    """The largest number t for which fewer than t of k coordinates agree with at most the probability ``loss``."""
    below = 0.0
    for t in range(k + 1):
        ways = math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1)
        below += math.exp(ways + t * math.log(chance) + (k - t) * math.log1p(-chance))
        if below > loss:
            return t
    return k


def _likely(a: str, b: str, similarity: float, k: int = COORDINATES, bits: int = BITS) -> Column:
    """Whether two sketches of k coordinates agree often enough for documents of at least this similarity."""
    differ, lowest = F.lit(0), sum(1 << at for at in range(0, 64, bits))
    for i in range(k * bits // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in range(bits.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(lowest)))
    return F.lit(k) - differ >= _least_agreeing(k, similarity + (1 - similarity) / (1 << bits), LOSS)


def _jaccard(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) with texts (tu, tv) whose shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for lo, _, words in word_chunks(column):
                doc, hash_, _ = shingle_sets(words, shingle)
                docs.append(doc + lo)
                hashes.append(hash_)
            return np.concatenate(docs), np.concatenate(hashes)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                (da, ha), (db, hb) = sets(part["tu"]), sets(part["tv"])
                doc, hash_ = np.concatenate((da, db)), np.concatenate((ha, hb))
                order = np.lexsort((hash_, doc))
                doc, hash_ = doc[order], hash_[order]
                same = (doc[1:] == doc[:-1]) & (hash_[1:] == hash_[:-1])
                common = np.bincount(doc[1:][same], minlength=part.num_rows)
                union = np.bincount(doc, minlength=part.num_rows) - common
                good = pa.array(common >= similarity * union - 1e-9)
                yield pa.RecordBatch.from_arrays([part["u"].filter(good), part["v"].filter(good)], ["u", "v"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(check, "u bigint, v bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): what stands in any pair. Each side is reduced on its own first."""
    return pairs.select(F.col("u").alias("id")).distinct().union(pairs.select("v").distinct()).distinct()


def _sent(ids: DataFrame) -> DataFrame:
    """A table of names, broadcast if they are few, so that no texts or sketches are shuffled for the others."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def equal_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, copy_of): the smallest id among documents of the same text. Null texts are left out; repeated rows merge."""
    keyed = docs.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"))
    # A table of its own, so that the join may split a text that very many rows share.
    first = stored(keyed.groupBy("key").agg(F.min("id").alias("copy_of")), "first-copies")
    return keyed.join(first, "key").groupBy("id").agg(F.min("copy_of").alias("copy_of"))


def row_name(text: str = "text", id_col: str = "doc_id") -> Column:
    """Names a row by its id and text, so that repeated and missing ids do no harm."""
    return F.xxhash64(F.col(id_col).cast("long"), text)


def near_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY,
                 shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for every distinct id; documents linked by similarity, directly or through others, share a class."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), row_name(text, id_col).alias("row")).distinct()
    # The smallest ids are a table of their own, so that the join may split a hot class.
    placed = stored(ids.join(row_classes(docs, text, id_col, similarity, shingle, bands, rows), "row").select("doc_id", "class"), "placed")
    least = stored(placed.groupBy("class").agg(F.min("doc_id").alias("class_id")), "least-ids")
    known = placed.join(least, "class").select("doc_id", "class_id").distinct()
    wordless = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(text).isNotNull()).alias("known")).where("not known and doc_id is not null")
    return known.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each class of near copies, that of the smallest id (a missing id comes last); null texts stay."""
    named = docs.withColumn("_row", row_name(text, id_col))
    ids = named.where(F.col(text).isNotNull()).select(F.col("_row").alias("row"), F.col(id_col).cast("long").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    first = ids.join(row_classes(docs, text, id_col), "row").groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.row").alias("_row"))
    kept = named.where(F.col(text).isNotNull()).join(first, "_row", "left_semi").unionByName(named.where(F.col(text).isNull()))
    return kept.dropDuplicates(["_row"]).select(*docs.columns)


def row_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY,
                shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, class) for every distinct row with a text, by ``row_name``; a class is named by its smallest row name."""
    docs = docs.select(row_name(text, id_col).alias("row"), F.col(text).alias("text"))
    text, id_col = "text", "row"
    copies = stored(equal_texts(docs, text, id_col), "copies")
    firsts = copies.where("id = copy_of").select("id")
    signed = stored(signatures(docs, text, id_col, bands, rows, shingle).join(firsts, "id", "left_semi").dropDuplicates(["id"]), "bands")
    members = signed.select("id", F.posexplode("bands").alias("band", "key"))
    shared = stored(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("middle")).where("n > 1").drop("n"), "shared-bands")
    buckets = stored(members.join(shared, ["band", "key"]), "buckets")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = signed.select("id", "sketch")

    def sketched(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "likely")
        used = stored(_ends(pairs), "used")
        some = stored(sketches.join(_sent(used), "id", "left_semi"), "sketches")
        both = pairs.join(some.toDF("u", "a"), "u").join(some.toDF("v", "b"), "v")
        return both.where(_likely("a", "b", similarity)).select("u", "v")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        # Few documents are in pairs, as a rule. A stored table has a known size; the plan of an aggregate would shuffle all texts.
        used = stored(_ends(pairs), "used")
        texts = stored(source.join(_sent(used), "id", "left_semi").where("text is not null").dropDuplicates(["id"]), "pair-texts")
        one, two = texts.toDF("u", "tu"), texts.toDF("v", "tv")
        return stored(_jaccard(pairs.join(one, "u").join(two, "v"), shingle, similarity), "links")

    first = buckets.where("id <> middle").select(F.col("middle").alias("u"), F.col("id").alias("v"))
    found = components(links(sketched(first)))
    for turn in range(MIDDLES + 1):
        roots = found.toDF("id", "root")
        placed = buckets.select("id", "band", "key").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # The document in the middle is drawn by a hash that changes with the turn.
        drawn = F.max_by(F.struct("id", "root"), F.xxhash64(F.lit(turn), F.col("id"))).alias("middle")
        groups = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), drawn)
        open_ = stored(groups.where("low <> high").select("band", "key", "middle"), "open-buckets")
        rest = placed.join(open_, ["band", "key"])
        if turn < MIDDLES:
            pairs = sketched(rest.where("root <> middle.root").select(F.least("id", "middle.id").alias("u"), F.greatest("id", "middle.id").alias("v")))
        else:
            # Only these documents are signed again, at length.
            held = stored(rest.drop("middle"), "open-rows")
            ids = _sent(stored(held.select("id").distinct(), "open-ids"))
            long = signatures(source.join(ids, "id", "left_semi"), "text", "id", bands, rows, shingle, LONG, LONG_BITS).select("id", "sketch").dropDuplicates(["id"])
            rest = stored(held.join(signed.select("id", "bands").join(ids, "id", "left_semi").join(long, "id"), "id"), "open")
            one, two = rest.alias("one"), rest.alias("two")
            same = (F.col("one.band") == F.col("two.band")) & (F.col("one.key") == F.col("two.key"))
            apart = (F.col("one.id") < F.col("two.id")) & (F.col("one.root") != F.col("two.root")) & _likely("one.sketch", "two.sketch", similarity, LONG, LONG_BITS)
            # A pair is made in the first of the bands that it shares; the bucket there is open too.
            first = F.array_position(F.zip_with("one.bands", "two.bands", lambda a, b: a == b), True) == F.col("one.band") + 1
            pairs = one.join(two, same & apart & first).select(F.col("one.id").alias("u"), F.col("two.id").alias("v"))
        new = links(pairs)
        if not new.isEmpty():
            found = components(found.toDF("u", "v").unionByName(new))
    roots = found.toDF("copy_of", "root")
    return copies.join(roots, "copy_of", "left").select(F.col("id").alias("row"), F.coalesce("root", "copy_of").alias("class"))
