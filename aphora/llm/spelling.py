"""Words of a corpus that are spellings of one another, by PartEnum signatures over their letters.

Runs of letters are counted in every whole text (a fixed share of them, told by a checksum of document and run, loses one
letter first). Two words are near if one inserted, deleted or replaced letter leads from one to the other. The letters
of a word, numbered by occurrence, are a binary vector: a replaced letter means a Hamming distance of two between words of
one length, an inserted one a distance of one between neighbouring lengths. Distinct vectors are few, as anagrams share
one. The letters are dealt to ``PARTS`` parts of about equal weight; two vectors at distance two agree in all but two parts,
and at distance one in all but one. So a vector signs what is left without each pair of parts, and without each
part, and equal signatures are joined: nothing is lost, whatever the parts are. Pairs of vectors are verified letter by
letter; then the words behind a verified pair are joined on what is left of them without the letter that differs, and
that too is checked by their edit distance. No step pairs all words of a signature or of a vector.

A form is the near word with the largest count (ties: the first in code point order) if that is twice the word's own; roots
follow the forms by pointer doubling, a few rounds as counts double along the way.

Null texts have no words, a null id reads as an empty one in the checksum. Repeated rows count as often as they stand there.
Very long texts and runs are read whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import stored
from aphora.llm.textmath import chunks, mix, ragged, seeded

PARTS = 8
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many loses a letter.
SPOILT = 97
#: Occurrences of a letter that are weighed on their own when letters are dealt to parts.
WEIGHED = 4

_U = np.uint64
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: Bytes of runs up to this length have their checksums put together from those of id and run.
_SHORT = 64


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a run: A to Z in both cases, and the two bytes of U+00C0 to U+00FF."""
    lead = data == 0xC3
    fold = data | 0x20
    out = ((fold >= 0x61) & (fold <= 0x7A)) | lead
    out[1:] |= lead[:-1]
    return out


def _shifted(crc: np.ndarray, upto: int) -> np.ndarray:
    """Checksums carried over 0 to ``upto`` further bytes: with the run's own checksum they make that of both together."""
    out = np.empty((len(crc), upto + 1), np.uint32)
    out[:, 0] = crc
    for k in range(upto):
        out[:, k + 1] = _CRC[out[:, k] & 0xFF] ^ (out[:, k] >> np.uint32(8))
    return out


def runs_of(ids: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, Counter]:
    """Distinct lower-case runs with their counts as they stand, and the counts of those that lost a letter."""
    solid = _letters(data)
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    lower = data[solid]
    lower = np.where((lower >= 0x41) & (lower <= 0x5A), lower + 32, lower).astype(np.uint8)
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(lower)]).dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    owner = np.searchsorted(offsets, starts, "right") - 1
    heads = [f"{i}:".encode() for i in ids]
    size = np.array([len(w) for w in words], np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    carried = _shifted(np.array([zlib.crc32(h) for h in heads], np.uint32), int(min(_SHORT, size.max(initial=0))))
    check = carried[owner, np.minimum(size[code], carried.shape[1] - 1)] ^ own[code]
    for k in np.flatnonzero(size[code] > _SHORT).tolist():
        check[k] = zlib.crc32(words[code[k]], zlib.crc32(heads[owner[k]]))
    hit = check % np.uint32(SPOILT) == 0
    spoilt: Counter = Counter()
    for word, h in zip(code[hit].tolist(), check[hit].tolist()):
        run = words[word].decode()
        at = h % len(run)
        spoilt[run[:at] + run[at + 1 :]] += 1
    return coded.dictionary.cast(pa.large_string()), np.bincount(code[~hit], minlength=len(words)), spoilt


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_pylist()
        for lo, hi, data, offsets in chunks(batch["text"], 4 << 20):
            words, counts, spoilt = runs_of(ids[lo:hi], data, offsets)
            some = pa.array(np.flatnonzero(counts))
            yield pa.RecordBatch.from_arrays([words.take(some).cast(pa.string()), pa.array(counts[some], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(spoilt), pa.string()), pa.array(list(spoilt.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the words of all texts that are long and frequent enough."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(_count, "word string, n bigint")
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _numbered(letters: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings of sorted letters: string, code point and occurrence (from 0) of every letter."""
    texts = letters.to_pylist()
    point = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner, nth = ragged(np.array([len(t) for t in texts], np.int64))
    new = np.ones(len(point), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (point[1:] != point[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(point)), 0)) if len(point) else nth
    return owner, point, np.arange(len(point)) - first


def deal(weights: dict[tuple[int, int], float], parts: int) -> dict[tuple[int, int], int]:
    """Letters (by code point and occurrence) dealt to parts: each in turn to the part with the least weight so far."""
    load, out = [0.0] * parts, {}
    for letter, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        out[letter] = min(range(parts), key=load.__getitem__)
        load[out[letter]] += weight
    return out


def _parts(vectors: DataFrame, parts: int) -> dict[tuple[int, int], int]:
    """The deal for these vectors: a letter weighs as much as it tells apart. One row per letter comes to the driver."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, point, occurrence = _numbered(batch["letters"])
            key, n = np.unique(point * WEIGHED + np.minimum(occurrence, WEIGHED - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    rows = vectors.mapInArrow(tally, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    total = max([r["n"] for r in rows], default=1) + 1
    return deal({divmod(r["key"], WEIGHED): r["n"] / total * (1 - r["n"] / total) for r in rows}, parts)


def signatures(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """signature, side and letters: per vector its parts without each two (side 0), and without each one (1: against vectors
    with a letter less, 2: against vectors with a letter more)."""
    dealt = _parts(vectors, parts)
    pairs = list(combinations(range(parts), 2))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of = np.zeros((max([p for p, _ in dealt], default=0) + 1, WEIGHED), np.int64)
        for (point, occurrence), part in dealt.items():
            part_of[point, occurrence] = part
        marks = seeded(parts + len(pairs), 23)
        for batch in batches:
            owner, point, occurrence = _numbered(batch["letters"])
            rows = batch.num_rows
            tags = mix((point.astype(_U) << _U(32)) + occurrence.astype(_U) + _U(1))
            sums = np.zeros((rows, parts), _U)
            np.add.at(sums, (owner, part_of[point, np.minimum(occurrence, WEIGHED - 1)]), tags)
            whole = sums.sum(1, dtype=_U)
            size = np.bincount(owner, minlength=rows).astype(_U)
            two = np.stack([mix(mix(whole - sums[:, a] - sums[:, b] + marks[parts + k]) + size) for k, (a, b) in enumerate(pairs)], 1)
            fewer = np.stack([mix(mix(whole - sums[:, a] + marks[a]) + size) for a in range(parts)], 1)
            more = np.stack([mix(mix(whole - sums[:, a] + marks[a]) + size + _U(1)) for a in range(parts)], 1)
            signed = np.concatenate([two, fewer, more], 1)
            side = np.tile(np.repeat(np.arange(3), [len(pairs), parts, parts]), rows)
            repeated = batch["letters"].take(pa.array(np.repeat(np.arange(rows), signed.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(signed.ravel().view(np.int64)), pa.array(side, pa.int8()), repeated], ["signature", "side", "letters"])

    return vectors.mapInArrow(sign, "signature bigint, side tinyint, letters string")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of vectors at a distance of two (or one): the letter that only the first has, and that only the second has."""
    for batch in batches:
        rows = batch.num_rows
        keys, signs = [], []
        for name, sign in (("left", 1), ("right", -1)):
            owner, point, _ = _numbered(batch[name])
            keys.append((owner << 21) + point)
            signs.append(np.full(len(owner), sign, np.int64))
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        change = np.bincount(where, np.concatenate(signs), len(key)).astype(np.int64)
        pair, point = key >> 21, key & ((1 << 21) - 1)
        gone, come = np.bincount(pair, np.maximum(change, 0), rows), np.bincount(pair, np.maximum(-change, 0), rows)
        lost, gained = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        lost[pair[change > 0]], gained[pair[change < 0]] = point[change > 0], point[change < 0]
        ok = np.flatnonzero((gone == 1) & (come <= 1))
        chosen = pa.array(ok)
        letter = [pa.array([chr(c) if c else "" for c in x[ok].tolist()], pa.string()) for x in (lost, gained)]
        yield pa.RecordBatch.from_arrays([batch["left"].take(chosen), batch["right"].take(chosen), *letter], ["left", "right", "lost", "gained"])


def near_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """left, right, lost, gained: vectors of one size that differ in one letter, and those that have one letter more."""
    signed = stored(signatures(vectors, parts), "signatures")
    one = signed.select("signature", F.col("side").alias("one"), F.col("letters").alias("left"))
    two = signed.select("signature", F.col("side").alias("two"), F.col("letters").alias("right"))
    fits = F.expr("(one = 0 and two = 0 and left < right) or (one = 1 and two = 2)")
    met = one.where("one < 2").join(two.where("two <> 1"), "signature").where(fits)
    return met.select("left", "right").mapInArrow(_differences, "left string, right string, lost string, gained string").distinct()


def _without(word: str, letter: str, hole: str) -> str:
    """SQL for the word without each occurrence of the letter (``hole`` in its place), or the word itself for no letter."""
    cut = f"concat(substr({word}, 1, i - 1), {hole}, substr({word}, i + 1))"
    return f"if({letter} = '', array({word}), array_distinct(transform(filter(sequence(1, length({word})), i -> substr({word}, i, 1) = {letter}), i -> {cut})))"


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, n, near, near_n for every ordered pair of near words among ``words`` (word, n)."""
    spelt = stored(words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), "")), "spelt-words")
    pairs = stored(near_vectors(spelt.select("letters").distinct(), parts), "near-vectors")
    hole = "if(gained = '', '', '*')"

    def rest(side: str, letter: str, word: str, n: str) -> DataFrame:
        held = spelt.select(F.col("letters").alias(side), F.col("word").alias(word), F.col("n").alias(n))
        cut = pairs.join(held, side).withColumn("rest", F.explode(F.expr(_without(word, letter, hole))))
        return cut.select(F.xxhash64("left", "right", "rest").alias("key"), word, n)

    met = rest("left", "lost", "word", "n").join(rest("right", "gained", "near", "near_n"), "key").where(F.levenshtein("word", "near") == 1)
    found = stored(met.select("word", "n", "near", "near_n"), "near-words")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root for every word that has a form; the pointers reach twice as far in every round."""
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n for all words of the texts."""
    words = stored(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    near = near_words(words, parts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(near, "word", "left")
    strong = -F.col("best.less") >= 2 * F.col("n")
    judged = stored(
        told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")),
        "judged-words")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
