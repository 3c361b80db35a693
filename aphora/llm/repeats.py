"""Substring dedup: words inside any long word sequence that stands somewhere else too.

Seed and extend. Every window of ``length`` consecutive words elects an anchor, the smallest-hashed run of ``seed`` words
inside it (winnowing); equal windows elect the same anchor at the same place, and neighbouring windows mostly share theirs.
The rows that are joined are anchors, not windows: about one per fourteen words. An anchor whose hash stands only
once in the corpus cannot lie in a repeat and is dropped. The others carry their span, the stretch of text that their
windows cover, and are extended to both sides: spans of one anchor that are equal as a whole repeat as a whole, and are
settled by counting; of every span that differs, one representative is cut into its windows, and a window found twice is
a repeat. The union of these windows is the union of all maximal repeats of at least ``length`` words.

Counts are pre-aggregated, so a passage shared by a third of all documents is a number, not a group; no pairs are made.
Hashes of spans and windows have 64 bits and are compared only below an equal 64-bit anchor.

Null texts have no words. A text shorter than ``length`` loses nothing. Repeated rows (same id and text) are repeats of
each other, as two documents would be; each row is returned. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import stored
from aphora.llm.textmath import U, Words, mix, ragged, sliding_min, word_chunks

LENGTH = 35
SEED = 8
#: Window starts handled at once; their words' places must fit the lower 24 bits of the election values.
SEGMENT = 1 << 22
_PLACE = U((1 << 24) - 1)


def elect(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that elect one anchor: document, first and last window start, anchor (places in the batch)."""
    n = np.diff(words.first)
    doc, place = ragged(np.maximum(n - length + 1, 0))
    start = words.first[doc] + place
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    gram = words.grams(seed)
    width = length - seed + 1
    anchor = np.empty(len(start), np.int64)
    for lo in range(0, len(start), SEGMENT):
        part = start[lo : lo + SEGMENT]
        # Windows of several documents: the segment reaches from its first window to its last, in pieces that fit.
        for base in range(int(part[0]), int(part[-1]) + 1, SEGMENT):
            here = (part >= base) & (part < base + SEGMENT)
            if not here.any():
                continue
            stop = int(part[here][-1]) + 1
            votes = (gram[base : stop + width - 1] & ~_PLACE) | np.arange(stop + width - 1 - base, dtype=np.uint64)
            anchor[lo : lo + len(part)][here] = base + (sliding_min(votes, width) & _PLACE).astype(np.int64)[part[here] - base]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return doc[at], start[at], start[last], anchor[at]


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, span, id, places): an anchor, its span's hash, and the span's first and one-past-last word in one number."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_chunks(batch["text"]):
                doc, first, last, anchor = elect(words, length, seed)
                if not len(doc):
                    continue
                span = words.runs(first, last + length) ^ mix(((anchor - first).astype(np.uint64) << U(32)) | (last - first).astype(np.uint64))
                begin = words.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.runs(anchor, anchor + seed).view(np.int64)), pa.array(span.view(np.int64)),
                     batch["row"].slice(lo, hi - lo).take(pa.array(doc)),
                     pa.array(((first - begin) << 32) | (last + length - begin)), pa.array((anchor - begin).astype(np.int64))],
                    ["h", "span", "row", "places", "anchor"])

    return docs.select("row", "text").mapInArrow(find, "h bigint, span bigint, row bigint, places bigint, anchor bigint")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(w, row, start, settled): the hash of every window of the listed spans, with its place below the anchor mixed in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_chunks(batch["text"]):
                lists = batch["spans"].slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                places, anchor = flat.field("places").to_numpy(), flat.field("anchor").to_numpy()
                h, settled = flat.field("h").to_numpy(), flat.field("settled").to_numpy(zero_copy_only=False)
                first, stop = places >> 32, places & 0xFFFFFFFF
                item, step = ragged(stop - first - length + 1)
                start = first[item] + step
                at = words.first[owner[item]] + start
                w = words.runs(at, at + length) ^ mix(h[item].view(np.uint64) + (anchor[item] - start).astype(np.uint64))
                for a in range(0, len(w), 1 << 18):
                    b = slice(a, a + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[b].view(np.int64)), batch["row"].slice(lo, hi - lo).take(pa.array(owner[item[b]])), pa.array(start[b]), pa.array(settled[item[b]])],
                        ["w", "row", "start", "settled"])

    return texts.mapInArrow(cut, "w bigint, row bigint, start bigint, settled boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, spans) for (row, text): the word ranges [lo, hi) of a row's repeats, which may overlap."""
    found = stored(seeds(docs, length, seed), "seeds")
    # Counts are tables of their own, so that the joins below may split a hot anchor.
    twice = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-seeds")
    shared = stored(found.join(twice, "h"), "shared-seeds")
    kinds = stored(shared.groupBy("h", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "places", "anchor")).alias("one")), "spans")
    whole = shared.join(kinds.where("n > 1").select("h", "span"), ["h", "span"], "left_semi").select("row", "places")
    mixed = stored(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "mixed-seeds")
    single = kinds.join(mixed, "h").select("one.row", F.struct("h", "one.places", "one.anchor", (F.col("n") > 1).alias("settled")).alias("item"))
    lists = single.groupBy("row").agg(F.collect_list("item").alias("spans"))
    windows = stored(_windows(docs.select("row", "text").join(lists, "row"), length), "windows")
    again = stored(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"), "repeated-windows")
    cut = windows.where("not settled").join(again, "w", "left_semi").select("row", ((F.shiftleft("start", 32)) + F.col("start") + length).alias("places"))
    # Repeated rows have the same spans: each is listed once, however often the row stands in the table.
    return stored(whole.unionByName(cut).groupBy("row").agg(F.collect_set("places").alias("spans")), "repeats")


def covered(spans: pa.ListArray, words: Words) -> np.ndarray:
    """For every word of the batch, whether a span of its document covers it."""
    owner = np.repeat(np.arange(len(spans)), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy())
    places = spans.flatten().to_numpy()
    base = words.first[owner]
    delta = np.bincount(base + (places >> 32), minlength=len(words.starts) + 1).astype(np.int64)
    delta -= np.bincount(base + (places & 0xFFFFFFFF), minlength=len(words.starts) + 1)
    return np.cumsum(delta[:-1]) > 0


def _row() -> Column:
    """Names a row by its id and text, so that repeated ids do no harm."""
    return F.xxhash64("doc_id", "text")


def removed_words(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) for every document."""
    rows = docs.select(_row().alias("row"), "doc_id", "text")
    spans = repeated_spans(rows, length, seed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests = [], [], []
            for lo, hi, words in word_chunks(batch["text"]):
                out = covered(batch["spans"].slice(lo, hi - lo), words)
                data = words.data.tobytes()
                total.append(np.diff(words.first))
                gone.append(np.diff(np.concatenate(([0], np.cumsum(out)))[words.first]))
                border = np.append(words.starts, len(data))
                for d in range(hi - lo):
                    a, b = words.first[d], words.first[d + 1]
                    kept = data[border[a] : words.ends[b - 1]].split() if a < b else []
                    if gone[-1][d]:
                        kept = [w for w, o in zip(kept, out[a:b].tolist()) if not o]
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            count, cut = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (total, gone))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count), pa.array(cut), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.join(spans, "row", "left").select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents with repeated words cut out, other characters unchanged and runs of blanks at a cut joined.

    A document without repeats keeps its text as it is; ``n_chars`` follows the text where that column exists.
    """
    spans = repeated_spans(docs.select(_row().alias("row"), "text"), length, seed).withColumnRenamed("row", "_row")
    plain = [c for c in docs.columns if c not in ("text", "n_chars")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list = []
            for lo, hi, words in word_chunks(batch["text"]):
                out = covered(batch["_spans"].slice(lo, hi - lo), words)
                data = words.data.tobytes()
                for d, known in enumerate(batch["text"].slice(lo, hi - lo)):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if not out[a:b].any():
                        texts.append(known.as_py())
                        continue
                    keep = np.flatnonzero(np.diff(np.concatenate(([1], out[a:b], [1]))))
                    parts = [data[words.starts[a + x] : words.ends[a + y - 1]] for x, y in zip(keep[0::2], keep[1::2])]
                    texts.append(b" ".join(parts).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in plain], pa.array(texts, pa.string())], [*plain, "text"])

    joined = docs.withColumn("_row", _row()).join(spans.withColumnRenamed("spans", "_spans"), "_row", "left").select(*plain, "text", "_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("text", "_spans"))
    edited = joined.mapInArrow(cut, f"{fields}, text string")
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)
