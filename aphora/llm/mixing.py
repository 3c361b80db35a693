"""Language-model scoring by online context mixing, of bits and then of whole words.

A text is its words (A-Z in lower case) and one end. Every token is a symbol: one of the most frequent training words, the
end, or a class of all other words (a hash of a word's first two bytes). Symbols are sent as bits, along a Huffman code
of the training text. Every bit is predicted from counts kept under several hashed contexts: none, the token before, the
last of the common words before it, and the last two of these. The predictions are mixed in the logistic domain
by weights, chosen by a gate (how well the two longest contexts are known); the weights are learned online, block of bits
after block, and the mixed probability is refined by an adaptive map from (gate, probability) to the frequency found. A word
of a class has the share (c + 1) / (C + K + 1): its count, and the counts and number of the words of its class; one share
is kept for words not seen.

That is one predictor of three. The others know every word by itself, however rare: how often it followed the token before it, and
the two tokens before it (``follows`` counts all such runs of the training text, exactly but for equal hashes). Each context spreads
what it leaves open by the next shorter one, (c + a p) / (C + a), the shortest by the first predictor. One of the two works ``a`` out
from the counts of all texts; the other takes two tokens for sure, as in passages that stand elsewhere too. A text that is learned from
is scored without the own occurrence of each token. The three are mixed by weights that every text starts evenly, and that are
corrected after each token by the probabilities given.

All training text is learned from: each task predicts its texts bit by bit before it counts them, and corrects its weights on
every block. Contexts of bits are hashed to tables of fixed size, which tasks send in parts and Spark adds up; weights are averaged.

A null text is an empty one (its only token is the end). Repeated rows are scored each. Without training rows the code is
that of equal counts. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm import follows
from aphora.llm.follows import UNIT_BYTES
from aphora.llm.language import held_out
from aphora.llm.tables import stored
from aphora.llm.textmath import CHUNK_BYTES, U, Words, chunks, mix, ragged, words_of

#: Words with a symbol of their own, words that count as common in contexts, classes of the other words.
NAMED = 512
COMMON = 256
CLASSES = 256
SYMBOLS = NAMED + CLASSES + 1
STOP = SYMBOLS - 1
FREQUENT = 1 << 17
#: Bits of the table of each context.
SIZES = (14, 20, 18, 20)
PART = 4096
#: Tasks whose parts (32 kB each) are added up in one group.
TOGETHER = 32
#: Symbols predicted before they are counted; symbols, and bits, worked on at once.
BLOCK = 1 << 16
PIECE = 1 << 14
STEP = 8192
#: Counters that are few enough to be counted in place; more are counted in their order.
SMALL = 1 << 16
RATE = 0.05
SHADE = 0.4
STEPS = 24
GATES = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPREAD = U(0x9E3779B97F4A7C15)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every symbol: its length, and per step the inner node passed and the bit taken."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, node = {}, {}, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], bit[a[2]], parent[b[2]], bit[b[2]] = node, 0, node, 1
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    paths = []
    for s in range(len(counts)):
        path, at = [], s
        while at in parent:
            path.append((parent[at] - len(counts), bit[at]))
            at = parent[at]
        paths.append(path[::-1])
    longest = max(map(len, paths))
    length = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((len(counts), longest), np.int64), np.zeros((len(counts), longest), np.uint8)
    for s, path in enumerate(paths):
        nodes[s, : len(path)] = [n for n, _ in path]
        bits[s, : len(path)] = [b for _, b in path]
    return length, nodes, bits


def bases(sizes: tuple[int, ...]) -> np.ndarray:
    """Where the table of each context begins; the last entry is the size of all."""
    return np.concatenate(([0], np.cumsum([1 << b for b in sizes])))


def blocks(symbols: np.ndarray, contexts: list[np.ndarray], code, sizes: tuple[int, ...], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bits in blocks of ``size`` symbols: the symbol each belongs to, its value, and its slots (contexts x bits)."""
    length, nodes, bits = code
    inside = np.arange(nodes.shape[1]) < length[:, None]
    marks, values, begin = ((nodes.astype(np.uint64) + U(1)) * _SPREAD)[inside], bits[inside], np.cumsum(length) - length
    start, size = bases(sizes), size or BLOCK

    def hashed(h: np.ndarray, k: int) -> np.ndarray:
        h *= _SPREAD
        h >>= U(64 - sizes[k])
        return h.view(np.int64) + start[k]

    # A context that is the same everywhere has one slot per step of the code.
    fixed = [hashed(c[0] ^ marks, k) if len(c) and (c == c[0]).all() else None for k, c in enumerate(contexts)]
    for lo in range(0, len(symbols), size):
        taken = length[symbols[lo : lo + size]]
        owner, slots = np.repeat(np.arange(lo, lo + len(taken)), taken), np.empty((len(contexts), int(taken.sum())), np.int64)
        bit, done = np.empty(slots.shape[1], np.uint8), 0
        # Pieces whose arrays stay in the cache.
        for at in range(lo, lo + len(taken), PIECE):
            s = symbols[at : min(at + PIECE, lo + len(taken))]
            n = length[s]
            ends = np.cumsum(n)
            step = np.repeat(begin[s] - ends + n, n)
            step += np.arange(len(step))
            here, mark = slice(done, done + len(step)), marks[step]
            bit[here] = values[step]
            for k, c in enumerate(contexts):
                if fixed[k] is not None:
                    slots[k, here] = fixed[k][step]
                    continue
                h = np.repeat(c[at : at + len(s)], n)
                h ^= mark
                slots[k, here] = hashed(h, k)
            done += len(step)
        yield owner, bit, slots


def leading(data: np.ndarray, words: Words) -> np.ndarray:
    """The first two bytes of each word."""
    second = np.where(words.ends - words.starts > 1, data[np.minimum(words.starts + 1, len(data) - 1)], 0)
    return (data[words.starts].astype(np.uint64) << U(8)) + second.astype(np.uint64)


def class_of(first: np.ndarray) -> np.ndarray:
    return (mix(first + U(77)) % U(CLASSES)).astype(np.int64)


def classes(data: np.ndarray, words: Words) -> np.ndarray:
    """The class of each word by its first two bytes."""
    return class_of(leading(data, words))


def tokens(words: Words, named: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols of all tokens, document by document, and the contexts of their bits; ``named`` holds each word's symbol. Words of
    a class, and what follows them, are predicted by themselves in ``follows``."""
    docs = len(words.first) - 1
    doc = np.repeat(np.arange(docs), np.diff(words.first))
    total = len(words.starts) + docs
    at = np.arange(len(words.starts)) + doc
    symbols, name = np.full(total, STOP), np.zeros(total, np.uint64)
    symbols[at], name[at] = named, words.hashes
    opens = words.first[:-1] + np.arange(docs)
    first = np.zeros(total, np.int64)
    first[opens] = opens
    first = np.maximum.accumulate(first)
    before = np.zeros(total, np.uint64)
    before[1:] = name[:-1]
    before[opens] = 0
    # The place of the last common word before each token of the same document, and of the one before that.
    last = np.full(total, -1)
    last[1:] = np.maximum.accumulate(np.where(symbols < COMMON, np.arange(total), -1))[:-1]
    last = np.where(last >= first, last, -1)
    earlier = np.where(last >= 0, last[np.maximum(last, 0)], -1)
    one = np.where(last >= 0, name[np.maximum(last, 0)], U(0))
    two = np.where(earlier >= 0, name[np.maximum(earlier, 0)], U(0))
    return symbols, [np.zeros(total, np.uint64), mix(before + U(2)), mix(one + U(1)), mix(one + mix(two + U(3)))]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + SHADE) / (n0 + SHADE)).astype(np.float32)


def levels(n: np.ndarray) -> np.ndarray:
    """How well a context is known: the doublings of its count, up to seven."""
    return np.minimum(np.frexp(n + 1.0)[1] - 1, 7).astype(np.uint8)


def gate_shares(level: np.ndarray, k: int) -> np.ndarray:
    """What the last context (k = -1) or the one before it (k = -2) adds to a bit's set of weights."""
    return level * np.uint8(4) if k == -1 else np.minimum((level + np.uint8(1)) >> np.uint8(1), np.uint8(3))


class Slots:
    """Stretched predictions of all slots. The last two contexts, which choose the gate, keep a slot's share of it beside its
    prediction, so that one look in memory finds both."""

    def __init__(self, sizes: tuple[int, ...]) -> None:
        self.bases = bases(sizes)
        self.split = int(self.bases[-3])
        self.table = np.zeros(self.split, np.float32)
        self.pairs = np.zeros(int(self.bases[-1]) - self.split, np.int64)

    @classmethod
    def of(cls, sizes: tuple[int, ...], table: np.ndarray, pairs: np.ndarray) -> Slots:
        out = cls.__new__(cls)
        out.bases = bases(sizes)
        out.split, out.table, out.pairs = int(out.bases[-3]), table, pairs
        return out

    def put(self, k: int, slots: np.ndarray, table: np.ndarray, level: np.ndarray) -> None:
        """Predictions and levels of slots of context k (counted from the last one, from -1 on)."""
        if k < -2:
            self.table[slots] = table
            return
        both = np.empty((len(slots), 2), np.float32)
        both[:, 0] = table
        both.view(np.int32)[:, 1] = gate_shares(level, k)
        self.pairs[slots - self.split] = both.view(np.int64)[:, 0]

    def look(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions (contexts x bits) and gates of bits."""
        inputs = np.empty(slots.shape, np.float32)
        inputs[:-2] = self.table.take(slots[:-2])
        pairs = self.pairs.take(slots[-2:] - self.split)
        inputs[-2:] = pairs.view(np.float32)[:, ::2]
        share = pairs.view(np.int32)[:, 1::2]
        return inputs, np.add(share[0], share[1], dtype=np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -20, 20)))


def _bin(dot: np.ndarray) -> np.ndarray:
    at = np.rint(dot * 2)
    at += STEPS // 2
    return np.clip(at, 0, STEPS, out=at).astype(np.int64)


def _mixed(inputs: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the inputs, with the weights of each bit's gate."""
    columns = np.ascontiguousarray(weights.T, np.float32)
    dot = columns[0][gate]
    dot *= inputs[0]
    for column, x in zip(columns[1:], inputs[1:]):
        part = column[gate]
        part *= x
        dot += part
    return dot


@dataclass
class Mixer:
    """Weights per gate, and the counts of the adaptive map per (gate, step of the mixed prediction)."""

    weights: np.ndarray
    hits: np.ndarray
    total: np.ndarray

    @classmethod
    def new(cls, contexts: int) -> Mixer:
        return cls(np.full((GATES, contexts), 0.35), np.zeros((GATES, STEPS + 1)), np.zeros((GATES, STEPS + 1)))

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None = None, step: int = STEP) -> None:
        """Predict and correct in small blocks; the map counts what was predicted before."""
        for lo in range(0, len(bit), step):
            x, g, y = inputs[:, lo : lo + step], gate[lo : lo + step], bit[lo : lo + step]
            m = None if weight is None else weight[lo : lo + step]
            dot = _mixed(x, g, self.weights)
            error = (y - squash(dot)).astype(np.float64)
            if m is not None:
                error *= m
            mass = np.bincount(g, m, len(self.weights)) + 1e-9
            for k in range(len(x)):
                slope = np.bincount(g, error * x[k], len(self.weights)) / mass
                self.weights[:, k] += RATE * slope * np.minimum(1.0, mass / 100)
            at = g * (STEPS + 1) + _bin(dot)
            self.hits += np.bincount(at, y if m is None else m * y, self.hits.size).reshape(self.hits.shape)
            self.total += np.bincount(at, m, self.total.size).reshape(self.total.shape)

    def rows(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.hits.ravel(), self.total.ravel()])

    @classmethod
    def merged(cls, contexts: int, rows: list[tuple[float, np.ndarray]]) -> Mixer:
        """Weights averaged by the number of bits learned from, counts added."""
        out = cls.new(contexts)
        mass = sum(m for m, _ in rows)
        if mass:
            cut = [out.weights.size, out.weights.size + out.hits.size]
            parts = [np.split(r, cut) for _, r in rows]
            out.weights = sum(p[0] * m for p, (m, _) in zip(parts, rows)).reshape(out.weights.shape) / mass
            out.hits = sum(p[1] for p in parts).reshape(out.hits.shape)
            out.total = sum(p[2] for p in parts).reshape(out.total.shape)
        return out


def probability(inputs: np.ndarray, gate: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Probability that the bit is one: the mean of the mixed prediction and its refinement."""
    dot = _mixed(inputs, gate, weights)
    step = _bin(dot)
    step += gate * (STEPS + 1)
    return 0.5 * (squash(dot) + refined.ravel()[step])


def refinement(mixer: Mixer) -> np.ndarray:
    own = squash((np.arange(STEPS + 1) - STEPS // 2) / 2.0)
    return (mixer.hits + 8 * own) / (mixer.total + 8)


@dataclass
class Bits:
    """A finished predictor: table of stretched predictions, how well slots are known, weights, refinement."""

    table: np.ndarray
    level: np.ndarray
    weights: np.ndarray
    refined: np.ndarray
    sizes: tuple[int, ...]

    def parts(self) -> tuple:
        found, at = Slots(self.sizes), bases(self.sizes)
        for k in range(-len(self.sizes), 0):
            here = np.arange(at[k - 1], at[k])
            found.put(k, here, self.table[here], self.level[here])
        return found.table, found.pairs, self.weights, self.refined, self.sizes


def log_bits(symbols: np.ndarray, contexts: list[np.ndarray], code, model: tuple) -> np.ndarray:
    """Natural logarithm of the probability of each symbol."""
    *held, weights, refined, sizes = model
    found, out = Slots.of(sizes, *held), np.zeros(len(symbols))
    for owner, bit, slots in blocks(symbols, contexts, code, sizes, PIECE):
        p = probability(*found.look(slots), weights, refined)
        lo = int(owner[0])
        sums = np.bincount(owner - lo, np.log(np.where(bit == 1, p, 1 - p)))
        out[lo : lo + len(sums)] = sums
    return out


# ---- learning ---------------------------------------------------------------------------------------------------


def lower_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    for lo, hi, data, offsets in chunks(texts, limit):
        data = _LOWER[data]
        yield lo, hi, data, words_of(data, offsets)


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """Parts sent by so many tasks, added up by number. Of many tasks, first the parts of about ``TOGETHER`` tasks are added."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * PART, np.int64)
        for blob in rows["counts"]:
            if len(blob) < 8 * PART:
                blob = pa.decompress(blob, 8 * PART, "zstd")
            total += np.frombuffer(blob, "<i8" if len(blob) == 16 * PART else "<i4")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    fan = min(64, -(-tasks // TOGETHER))
    if fan > 1:
        share = F.pmod(F.spark_partition_id(), F.lit(fan))
        parts = parts.withColumn("share", share).groupBy("part", "share").applyInPandas(add, "part int, counts binary")
    return parts.groupBy("part").applyInPandas(add, "part int, counts binary")


def counted(n: np.ndarray, slots: np.ndarray, bit: np.ndarray, size: int, base: int) -> np.ndarray:
    """Count the bits of one context into ``n`` (slots x 2); the slots that were met, in order."""
    keys = (slots * 2 + bit).astype(np.int32)
    if 2 * size <= SMALL:
        here = np.bincount(keys - np.int32(2 * base), minlength=2 * size).reshape(-1, 2)
        n[base : base + size] += here.astype(np.int32)
        return np.flatnonzero(here.any(1)) + base
    keys.sort()
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys = keys[at].astype(np.int64)
    n.reshape(-1)[keys] += np.diff(np.append(at, len(slots))).astype(np.int32)
    met = keys >> 1
    return met[np.concatenate(([True], met[1:] != met[:-1]))]


def learn(docs: DataFrame, lookup_rows: tuple, code, sizes: tuple[int, ...] = SIZES) -> Bits:
    """Counts, weights and refinement from the texts; ``lookup_rows`` are the hashes and symbols of frequent words."""
    size = int(bases(sizes)[-1])
    shipped = docs.sparkSession.sparkContext.broadcast((lookup_rows, code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, names), code_ = shipped.value
        lookup = Lookup(keys)
        # Zeros and ones counted per slot, and what is worked out from them: anew where a block counted, once per slot.
        n, found = np.zeros((size, 2), np.int32), Slots(sizes)
        mixer, mass = Mixer.new(len(sizes)), 0
        for batch in batches:
            for _, _, data, words in lower_chunks(batch["text"]):
                symbols, contexts = tokens(words, named_symbols(data, words, lookup, names)[0])
                for _, bit, slots in blocks(symbols, contexts, code_, sizes):
                    for lo in range(0, len(bit), STEP):
                        mixer.learn(*found.look(slots[:, lo : lo + STEP]), bit[lo : lo + STEP])
                    mass += len(bit)
                    for k, s in enumerate(slots, -len(sizes)):
                        new = counted(n, s, bit, 1 << sizes[k], int(found.bases[k - 1]))
                        zeros, ones = n[new].astype(np.float32).T
                        found.put(k, new, stretch(zeros, ones), levels(zeros + ones))
        for p in range(0, size, PART):
            if n[p : p + PART].any():
                plain = n[p : p + PART].T.astype("<i4").tobytes()
                # Compressed if that makes it shorter, so that the length tells.
                blob = min(pa.compress(plain, "zstd", asbytes=True), plain, key=len)
                yield pa.RecordBatch.from_arrays([pa.array([p // PART], pa.int32()), pa.array([0.0]), pa.array([blob], pa.binary())], ["part", "mass", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(mass)]), pa.array([mixer.rows().astype("<f8").tobytes()], pa.binary())], ["part", "mass", "counts"])

    parts = stored(docs.select("text").mapInArrow(run, "part int, mass double, counts binary"), "bit-counts")
    rows = parts.where("part < 0").orderBy("mass", "counts").collect()
    n = np.zeros((2, size))
    for r in _added(parts.where("part >= 0"), len(rows)).collect():
        n[:, r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], "<i8").reshape(2, PART)
    mixer = Mixer.merged(len(sizes), [(r["mass"], np.frombuffer(r["counts"], "<f8")) for r in rows])
    return Bits(stretch(n[0], n[1]), levels(n[0] + n[1]), mixer.weights, refinement(mixer), sizes)


# ---- scoring ----------------------------------------------------------------------------------------------------


class Lookup:
    """Rows by 64-bit hash: an open table with linear probing, filled and read in whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int64)
        self.keys = keys
        rows, at = np.arange(len(keys)), self._home(keys)
        while len(rows):
            free = self.slot[at] < 0
            self.slot[at[free][::-1]] = rows[free][::-1]
            placed = self.slot[at] == rows
            rows, at = rows[~placed], (at[~placed] + 1) & (size - 1)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), self._home(h)
        while len(todo):
            row = self.slot[at]
            held = row >= 0
            same = held & (self.keys[np.maximum(row, 0)] == h[todo]) if len(self.keys) else held
            out[todo[same]] = row[same]
            more = held & ~same
            todo, at = todo[more], (at[more] + 1) & (len(self.slot) - 1)
        return out


def named_symbols(data: np.ndarray, words: Words, lookup: Lookup, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's symbol, and its row in the lookup (-1: not there). ``names`` holds the rows' symbols, -1 for those without."""
    row = lookup.find(words.hashes)
    own = np.append(names, -1)[row]
    return np.where(own >= 0, own, NAMED + classes(data, words)), row


def _units(rows: DataFrame) -> DataFrame:
    """(unit, data): consecutive rows as they are, compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, *_ in chunks(batch["text"], UNIT_BYTES):
                held = pa.BufferOutputStream()
                with pa.ipc.new_stream(held, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([held.getvalue().to_pybytes()], pa.binary())], ["unit", "data"])
                unit += 1

    return rows.select("doc_id", "held_out", "text").mapInArrow(cut, "unit bigint, data binary")


def _rows_of(unit: bytes) -> tuple[pa.Table, np.ndarray]:
    """A unit's rows, and which of them are learned from."""
    rows = pa.ipc.open_stream(unit).read_all()
    return rows, ~rows["held_out"].to_numpy()


def _dealt(units: DataFrame, parts: int) -> DataFrame:
    """(unit, part, data): what every unit sends to be counted."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch["unit"].to_pylist(), batch["data"]):
                rows, learned = _rows_of(data.as_buffer())
                hashes, n, first = (np.concatenate(x) for x in zip(*((w.hashes, np.diff(w.first), leading(d, w)) for _, _, d, w in lower_chunks(rows["text"]))))
                to, sent = follows.sent(*follows.runs(hashes, n), np.repeat(learned, n + 1), hashes, np.repeat(learned, n), first, parts)
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(to)), pa.array(to, pa.int32()), pa.array(sent, pa.binary())], ["unit", "part", "data"])

    return units.mapInArrow(deal, "unit bigint, part int, data binary")


def word_counts(counted: DataFrame) -> DataFrame:
    """(h, class, n): the hash, class and number of every distinct word learned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch["words"].to_pylist():
                h, first, n = follows.unpacked(words, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.cumsum(h, dtype=np.uint64).view(np.int64)), pa.array(class_of(first).astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "class", "n"])

    return counted.where("unit is null").select("words").mapInArrow(read, "h bigint, class int, n bigint")


@dataclass
class Corpus:
    """What all texts to learn from are like: words with a symbol of their own (hashes and symbols), log10 of the counts of each
    class, texts, tokens, distinct tokens, parts of the counts, and the weights of the shorter context in those of two and three tokens."""

    named: tuple[np.ndarray, np.ndarray]
    class_logs: np.ndarray
    ends: int
    tokens: int
    kinds: int
    parts: int
    weights: tuple[float, float]


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def _scored(units: DataFrame, counted: DataFrame, code, model: Bits, corpus: Corpus) -> DataFrame:
    """The scores of all units' rows, from the answers that each got."""
    shipped, kept = units.sparkSession.sparkContext.broadcast((code, model.parts(), corpus)), []

    def score(parts: pa.Table) -> pa.Table:
        code_, model_, all_ = shipped.value
        if not kept:
            kept.append(Lookup(all_.named[0]))
        data = dict(zip(parts["part"].to_pylist(), parts["data"].to_pylist()))
        rows, learned = _rows_of(data.pop(-1))
        found = []
        for _, _, plain, words in lower_chunks(rows["text"]):
            named = named_symbols(plain, words, kept[0], all_.named[1])[0]
            found.append((words.hashes, np.diff(words.first), np.diff(words.offsets) - 1, named, log_bits(*tokens(words, named), code_, model_)))
        hashes, n, size, named, logs = (np.concatenate(f) for f in zip(*found))
        twice, thrice, count = follows.answered(data)
        place = follows.distinct(*follows.runs(hashes, n), all_.parts)[-1]
        twice, thrice, count = twice[place], thrice[place], count[follows.distinct(hashes, hashes, all_.parts)[-1]]
        at, opens = follows.layout(n)

        # The bits' prediction, with a word's share in its class: the first predictor, and what the others start from.
        share = np.log10(count + 1.0)
        p = np.exp(logs)
        p[at] *= 10 ** np.where(named >= NAMED, share - all_.class_logs[np.maximum(named - NAMED, 0)], 0.0)
        # A text that was learned from does not foretell its tokens by their own occurrence.
        own = np.repeat(learned, n + 1)
        met = np.zeros(len(p), np.int64)
        met[1:][at] = count
        met[opens] = all_.ends
        second = follows.continued(p, twice - own, met - own, all_.weights[0])
        met[1:] = twice[:-1]
        # Two tokens before it a text's first one has not.
        met[opens], thrice[opens] = own[opens], own[opens]
        longer = [follows.continued(second, thrice - own, met - own, weight) for weight in (all_.weights[1], follows.SURE)]
        total = follows.switched(np.stack([p, *longer]), n + 1) / np.log(10)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, share, len(n)) + np.log10(all_.ends + 1.0) - (n + 1) * np.log10(all_.tokens + all_.kinds + 1)
        return pa.table(
            [rows["doc_id"], rows["held_out"], pa.array(n + 1), pa.array(np.bincount(doc, count > 0, len(n)).astype(np.int64) + (all_.ends > 0)), pa.array(np.full(len(n), all_.tokens)), pa.array(base),
             pa.array(total), pa.array(-total * np.log2(10) / np.maximum(size, 1))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    answers = counted.where("unit is not null").select("unit", "part", "data")
    return units.select("unit", F.lit(-1).alias("part"), "data").union(answers).groupBy("unit").applyInArrow(score, RESULT)


def _step(n):
    """The count on a logarithmic scale, finer than a factor of 1.1."""
    return F.floor(F.log2(n) * 8).cast("int")


def score_corpus(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row. At most ``frequent``
    words, and no more than ``NAMED``, have a symbol of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    train = rows.where("not held_out")
    ends, size = (n or 0 for n in rows.agg(F.count(F.when(~F.col("held_out"), 1)), F.sum(F.octet_length("text"))).first())
    parts = follows.part_count(size)
    units = stored(_units(rows), "units")
    counted = stored(follows.counted(_dealt(units, parts)), "run-counts")
    table = word_counts(counted)

    by_step = table.groupBy(_step(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()
    top = table.orderBy(F.desc("n"), "h").limit(min(NAMED, frequent)).toPandas()
    named = top["h"].to_numpy(np.int64).view(np.uint64), np.arange(len(top))

    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    tokens_, kinds_ = int(mass.sum()) + ends, int(kinds.sum()) + int(ends > 0)
    np.subtract.at(mass, top["class"].to_numpy(np.int64), top["n"].to_numpy(np.float64))
    np.subtract.at(kinds, top["class"].to_numpy(np.int64), 1.0)
    counts = np.zeros(SYMBOLS)
    counts[: len(top)], counts[NAMED:STOP], counts[STOP] = top["n"].to_numpy(), mass, ends
    code = huffman(counts)

    model = learn(train, named, code)
    seen, once = np.zeros((2, follows.BINS)), np.zeros(2)
    for r in counted.where("unit is null").select("seen").collect():
        bins, few = follows.unpacked(r["seen"], 2)
        seen, once = seen + bins.reshape(2, -1), once + few
    # What stands before a token: a word, or (once per text) nothing; and what stands before it with the token before that.
    contexts = np.array([[r["n"] for r in by_step] + [ends], [r["c"] for r in by_step] + [1]], np.float64)
    weights = tuple(follows.concentration(times, times / np.maximum(different, 1), few) for (times, different), few in zip((contexts, seen), once))
    return _scored(units, counted, code, model, Corpus(named, np.log10(mass + kinds + 1), ends, tokens_, kinds_, parts, weights))
