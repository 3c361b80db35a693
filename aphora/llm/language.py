"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every run of letters (with its diacritics) is lower-cased and framed by blanks; its 1- to 3-grams of code points are hashed
into a fixed number of buckets. Training counts buckets per language in Spark; the matrix of smoothed log-probabilities
(languages x buckets, so of a known size) goes to the workers, which score whole texts with gathers and sums.

Null or letterless texts get ``und`` and score 0. Equal scores go to the first language in alphabetical order. Without a
learned language every text is ``und``. Rows keep their multiplicity; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.textmath import chunks

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: At most about so many training rows per language; rows are chosen by a hash of their id.
TRAIN_ROWS = 20_000
UNKNOWN = "und"

_SEEDS = (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: Bytes of text whose n-grams are worked on at once: some 250 bytes of arrays are made for each byte of text.
PIECE_BYTES = 1 << 17
#: Evidence of so many n-grams counts in full; the log-odds of longer texts are scaled down to it.
EVIDENCE = 200


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of the id as text falls in the part kept for testing (a null id does not)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some documents' texts, the document of each, and the number of letters per document."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # A byte that starts a character marks one code point; so byte offsets become code point offsets.
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    borders = lead[offsets]
    kind, lower = _classes()
    small = np.minimum(points, len(kind) - 1)
    letter = kind[small]
    big = points >= len(kind)
    folded = np.where(letter, lower[small], 0).astype(np.uint32)
    if big.any():
        at = np.flatnonzero(big)
        is_letter = np.array([chr(c).isalpha() for c in points[at]])
        letter[at], folded[at] = is_letter, np.where(is_letter, points[at], 0)
    counts = np.diff(np.concatenate(([0], np.cumsum(letter)))[borders])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run
    at = np.flatnonzero(keep)
    letters = folded[at]
    doc = np.searchsorted(borders, at, "right") - 1
    found, owners = [], []
    for order, seed in zip(ORDERS, _SEEDS):
        if len(letters) < order:
            continue
        h = np.full(len(letters) - order + 1, seed, np.uint32)
        for k in range(order):
            h = (h ^ letters[k : k + len(h)]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        # n-grams within one document that hold a letter; a run's own blank may open the next run's first n-gram.
        ok = doc[order - 1 :] == doc[: len(h)]
        if order == 1:
            ok &= letters[: len(h)] != 0
        found.append(h[ok].astype(np.int64))
        owners.append(doc[: len(h)][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    return np.concatenate(found), np.concatenate(owners), counts


def _gram_pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of a column of texts, some rows at a time: first and last row, and what ``_grams`` tells of them."""
    for lo, hi, data, offsets in chunks(texts, PIECE_BYTES):
        yield lo, hi, *_grams(data, offsets)


_TABLES: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For the code points below 0x3000: is it a letter, and its lower case (of one code point)."""
    if not _TABLES:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x3000)]
        _TABLES.append(np.array([c.isalpha() for c in chars]))
        _TABLES.append(np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32))
    return _TABLES[0], _TABLES[1]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: buckets x languages, smoothed log-probabilities
    weights: np.ndarray
    prior: np.ndarray


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from labelled rows (null labels and texts are left out).

    ``rows`` bounds the expected number of rows per language; the choice depends on a hash of the id alone.
    """
    known = train.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / float(1 << 30)
    number = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            for lo, _, bucket, doc, _ in _gram_pieces(batch["text"]):
                totals += np.bincount(label[lo + doc] * BUCKETS + bucket, minlength=totals.size).reshape(totals.shape)
        where, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(bucket, pa.int32()), pa.array(totals[where, bucket])], ["lang", "bucket", "n"])

    chosen = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = chosen.mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.ones((BUCKETS, len(languages)))
    matrix[counts["bucket"].to_numpy(), counts["lang"].to_numpy()] += counts["n"].to_numpy(np.float64)
    total = sum(sizes.values())
    prior = np.log([sizes[k] / total for k in languages])
    return LanguageModel(languages, np.log(matrix / matrix.sum(0)).astype(np.float32), prior)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] = ["doc_id"]) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score``, the probability of that language (evidence tempered).

    Only the text goes to Python, and nothing but the answer comes back.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        languages, weights, prior = shipped.value
        names = np.array([*languages, UNKNOWN], object)
        best, score = np.full(len(texts), len(languages)), np.zeros(len(texts))
        if languages:
            for lo, hi, bucket, doc, letters in _gram_pieces(texts):
                size = hi - lo
                sums = np.stack([np.bincount(doc, weights[:, k][bucket], size) for k in range(len(languages))], 1)
                n = np.bincount(doc, minlength=size)
                logs = sums * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + prior
                top = logs.argmax(1)
                odds = np.exp(logs - logs.max(1, keepdims=True))
                ok = letters > 0
                best[lo:hi] = np.where(ok, top, len(languages))
                score[lo:hi] = np.where(ok, odds.max(1) / odds.sum(1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    judged = docs.select(*carry, predict(F.col(text)).alias("_judged"))
    return judged.select(*carry, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score"))


def identify_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the rows not held out and predict every row: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
