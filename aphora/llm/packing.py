"""Packing token sequences by minimum bin slack.

Documents are tokenised, closed with an end token and cut into full windows; what remains of each, shorter than a window,
is packed. Only the number of remainders of each length matters for the plan, a table of at most ``window`` rows: the
longest length left opens a sequence, and a bitset subset-sum dynamic programme over the other lengths (with their
counts) finds the multiset that fills the rest closest to capacity; the counts are traced back. The pattern is repeated as
often as the counts allow, so a plan has about as many patterns as there are lengths, for any number of documents. Where
a pattern leaves more than ``max_slack`` tokens open, a remainder is cut to fill it, and its tail goes back to the counts.
What is left at the end is cut into sequences of powers of two, which need no padding.

Spark then numbers the remainders of each length (in parts, so that one length may hold any number of rows) and looks
up each number in the plan. Checksums of whole pieces come from the tokenising pass; documents that were cut are
tokenised again.

A null text is an empty one: its only token is the end token. Repeated rows are packed as rows of their own. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import numbered, part_count, stored
from aphora.llm.textmath import release

WINDOW = 4096
END = 2
MAX_SLACK = 16
#: Half the characters of encoded words, and of other pieces of words (a quarter of them), that a worker remembers in one
#: generation of its two tables: at some 30 bytes a character, at most 150 MB in all.
KNOWN_CHARACTERS = 1_200_000
#: Largest number of cut documents whose numbers (eight bytes each) are sent to every executor.
BROADCAST_ROWS = 200_000

# Words of these characters only are split by the expression below as the tokenizer would; others (also those with the
# sign that opens special tokens) go to the tokenizer as a whole. Texts are cut at blanks first: no token reaches across one.
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-įı-ɏ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """What was worked out for a key, in two generations: when the younger one is full, it becomes the older one.

    So the memory is bounded, and what is asked for often stays.
    """

    def __init__(self, work, size: int) -> None:
        super().__init__()
        self.work, self.size, self.held, self.older = work, size, 0, {}

    def __missing__(self, key):
        if self.held >= self.size:
            self.older = dict(self)
            self.clear()
            self.held = 0
        found = self.older.get(key)
        out = self[key] = self.work(key) if found is None else found
        self.held += len(key)
        return out


class Encoder:
    """Texts -> their token ids as little-endian 32-bit numbers; words and pieces of words are remembered."""

    def __init__(self, definition: str, known: int = KNOWN_CHARACTERS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.plain = all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        self.numbers = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        self.words, self.pieces = Known(self._word, known * 3 // 2), Known(self._piece, known // 2)

    def _word(self, word: bytes) -> bytes:
        if self.plain:
            # Most words are ASCII letters, with a sign behind them or none; in lower case they are pieces themselves.
            if word.isalpha():
                low = word.lower()
                return self._piece(word.decode()) if low == word else self.words[low]
            if word[-1] in b".,!" and word[:-1].isalpha():
                return self.words[word[:-1].lower()] + self.pieces[chr(word[-1])]
        text = word.decode("utf-8", "replace")
        if self.plain and _PLAIN.fullmatch(text):
            if text.isalpha():
                return self.pieces[text.lower()]
            if text[-1] in ".,!" and text[:-1].isalpha():
                return self.pieces[text[:-1].lower()] + self.pieces[text[-1]]
            return b"".join([self.pieces[p] for p in _PIECE.findall(text.lower())])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return b"".join([self.numbers[t.id] for t in self.model.tokenize(shown)])

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


def encoder(shipped) -> Encoder:
    """The encoder of a worker: it is kept beside the definition in the broadcast value, for the worker's later tasks."""
    held = shipped.value
    if len(held) == 1:
        held.append(Encoder(held[0]))
    return held[1]


class Plan:
    """Where the k-th remainder of a length goes, as rows of (length, first k, ...), for any k."""

    FIELDS = ("length", "first", "used", "sequence", "offset", "head", "tail_first")

    def __init__(self, counts: dict[int, int], window: int, max_slack: int) -> None:
        self.window, self.sequences = window, 0
        self.left = {int(k): int(v) for k, v in counts.items() if v}
        self.next = dict.fromkeys(range(1, window + 1), 0)
        self.total = {k: self.left.get(k, 0) for k in self.next}
        self.rows: list[tuple[int, ...]] = []
        while self.left:
            if sum(k * v for k, v in self.left.items()) < window:
                self._close(max_slack)
                break
            self._fill(max_slack)
        table = np.array(self.rows, np.int64).reshape(-1, len(self.FIELDS))
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.keys = (self.table[:, 0] << 40) + self.table[:, 1]
        del self.left, self.next, self.total, self.rows

    def _take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        return first

    def _cut(self, length: int, head: int, times: int, sequence: int, offset: int) -> None:
        """The next ``times`` remainders of a length lose their head to sequences; the tails join the shorter length."""
        tail = length - head
        self.rows.append((length, self._take(length, times), 1, sequence, offset, head, self.total[tail]))
        self.total[tail] += times
        self.left[tail] = self.left.get(tail, 0) + times

    def _whole(self, length: int, used: int, times: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self._take(length, used * times), used, sequence, offset, 0, 0))

    def _pattern(self) -> dict[int, int]:
        """The longest remainder, and the multiset that fills the rest of the window closest to capacity."""
        seed = max(self.left)
        room = self.window - seed
        goal, mask, reach, trace = 1 << room, (1 << (room + 1)) - 1, 1, []
        for length in sorted((k for k in self.left if k <= room), reverse=True):
            spare = min(self.left[length] - (length == seed), room // length)
            copies = 1
            while spare and not reach & goal:
                copies = min(copies, spare)
                trace.append((length, copies, reach))
                reach |= (reach << (length * copies)) & mask
                spare -= copies
                copies *= 2
            if reach & goal:
                break
        best = reach.bit_length() - 1
        used = {seed: 1}
        for length, copies, before in reversed(trace):
            if not before >> best & 1:
                best -= length * copies
                used[length] = used.get(length, 0) + copies
        return used

    def _fill(self, max_slack: int) -> None:
        used = self._pattern()
        slack = self.window - sum(k * v for k, v in used.items())
        times, cut = min(self.left[k] // v for k, v in used.items()), 0
        if slack > max_slack:
            spare = [(self.left[k] - used.get(k, 0), k) for k in self.left if k > slack and self.left[k] > used.get(k, 0)]
            if spare:
                cut = max(spare)[1]
                times = min(self.left[k] // (used.get(k, 0) + (k == cut)) for k in {*used, cut})
        offset = 0
        for length, n in used.items():
            self._whole(length, n, times, self.sequences, offset)
            offset += length * n
        if cut:
            self._cut(cut, slack, times, self.sequences, offset)
        self.sequences += times

    def _close(self, max_slack: int) -> None:
        """Less than a window is left: fill sequences of the powers of two that it is made of."""
        rest = sum(k * v for k, v in self.left.items())
        sizes = [rest] if rest > self.window - max_slack else [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        for size in sizes:
            offset = 0
            while offset < size:
                fits = [k for k in self.left if k <= size - offset]
                length = max(fits or self.left)
                if fits:
                    self._whole(length, 1, 1, self.sequences, offset)
                    offset += length
                else:
                    self._cut(length, size - offset, 1, self.sequences, offset)
                    offset = size
            self.sequences += 1


def pieces(table: np.ndarray, keys: np.ndarray, length: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Rounds of (item, start in the remainder, length, sequence, offset) for remainders given by length and number."""
    item, start = np.arange(len(k)), np.zeros(len(k), np.int64)
    while len(item):
        row = table[np.searchsorted(keys, (length << 40) + k, "right") - 1]
        _, first, used, sequence, offset, head, tail_first = row.T
        at = k - first
        size = np.where(head > 0, head, length)
        yield item, start, size, sequence + at // used, offset + (at % used) * size
        more = head > 0
        item, start = item[more], start[more] + head[more]
        length, k = length[more] - head[more], tail_first[more] + at[more]


def _sizes(docs: DataFrame, definition, window: int, end: int) -> DataFrame:
    """(no, row, doc_id, n, crcs): number and name of each row, its tokens, and the checksums of its full windows and its remainder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(definition)
        last, step = np.asarray([end], "<u4").tobytes(), 4 * window
        for batch in batches:
            sizes, crcs = [], []
            for text in batch["text"]:
                ids = known.ids(text.as_py()) + last
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + step]) for a in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([batch["no"], batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["no", "row", "doc_id", "n", "crcs"])
            release()

    return docs.select(F.monotonically_increasing_id().alias("no"), F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "no bigint, row bigint, doc_id bigint, n bigint, crcs array<bigint>")


def _checksums(cut: DataFrame, definition, end: int) -> DataFrame:
    """(row, start, length, crc): checksums of pieces of documents (row, text, pieces) that are tokenised again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(definition)
        last = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            lists = batch["pieces"]
            out, owner = [], np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            doc, ids = -1, b""
            for i, d in enumerate(owner.tolist()):
                if d != doc:
                    doc, ids = d, known.ids(batch["text"][d].as_py()) + last
                out.append(zlib.crc32(ids[4 * start[i] : 4 * (start[i] + length[i])]))
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(out, pa.int64())], ["row", "start", "length", "crc"])

    return cut.mapInArrow(encode, "row bigint, start bigint, length bigint, crc bigint")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, max_slack: int = MAX_SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast([Path(tokenizer).read_text(encoding="utf-8")])
    sizes = stored(_sizes(docs, definition, window, end), "token-sizes")
    rest = (F.col("n") % window).cast("long")
    counts = {r["rest"]: r["c"] for r in sizes.select(rest.alias("rest")).where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("c")).collect()}
    plan = Plan(counts, window, max_slack)
    shipped = spark.sparkContext.broadcast((plan.table, plan.keys))

    full = sizes.where(F.col("n") >= window).select("no", "row", "doc_id", "n", "crcs", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / window) - 1)).alias("block"))
    full = full.select("no", "row", "doc_id", "n", (F.col("block") * window).alias("start"), F.element_at("crcs", F.col("block").cast("int") + 1).alias("crc"), F.lit(0).alias("one"))
    blocks = full.count()
    whole = numbered(full, ["one"], ["row", "start", "no"], F.xxhash64("no", "start"), part_count(blocks), "k").select(
        "doc_id", "start", F.lit(window).cast("long").alias("length"), "crc", "n", (F.col("k") + plan.sequences).alias("sequence"), F.lit(0).cast("long").alias("offset"))

    ends = sizes.withColumn("rest", rest).where("rest > 0").select("no", "row", "doc_id", "n", "rest", F.element_at("crcs", -1).alias("crc"))
    ranked = numbered(ends, ["rest"], ["row", "no"], F.xxhash64("no"), part_count(max(counts.values(), default=0)), "k")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest_, k, n = (batch[c].to_numpy() for c in ("rest", "k", "n"))
            for item, start, size, sequence, offset in pieces(*shipped.value, rest_, k):
                cut = size < rest_[item]
                at = pa.array(item)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].take(at), batch["doc_id"].take(at), pa.array(n[item]), pa.array(n[item] - rest_[item] + start), pa.array(size),
                     pa.array(sequence), pa.array(offset), pa.array(batch["crc"].take(at).to_numpy(), mask=cut)],
                    ["row", "doc_id", "n", "start", "length", "sequence", "offset", "crc"])

    placed = stored(ranked.select("row", "doc_id", "n", "rest", "k", "crc").mapInArrow(
        place, "row bigint, doc_id bigint, n bigint, start bigint, length bigint, sequence bigint, offset bigint, crc bigint"), "placed")
    # A cut depends on the document and on where it is cut only, however many copies of the document there are.
    pending = placed.where("crc is null").drop("crc")
    lists = pending.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("pieces"))
    # Few documents are cut, as a rule; their numbers are broadcast if they are few, so that no text is shuffled for the others.
    cut = stored(lists.select("row"), "cut")
    few = cut.count() <= BROADCAST_ROWS
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(F.broadcast(cut) if few else cut, "row", "left_semi").dropDuplicates(["row"])
    checked = stored(_checksums(lists.join(texts, "row").select("row", "text", "pieces"), definition, end), "cut-checksums")
    again = pending.join(checked, ["row", "start", "length"])
    columns = ["doc_id", "start", "length", "crc", "n", "sequence", "offset"]
    return (
        whole.select(*columns).unionByName(placed.where("crc is not null").select(*columns)).unionByName(again.select(*columns))
        .select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
    )
