"""Quality score: a generalised additive model with pairwise interactions over text statistics.

A text becomes ``FEATURES`` numbers, computed for whole batches at once. Each feature is cut into bins at quantiles; the
model is an intercept, a table of log-odds per bin of each feature, and tables over two coarsely binned features for the
strongest pairs. Learning is cyclic boosting: round after round, each feature in turn fits a tree of at most four leaves
to what the others leave unexplained, and adds a small part of it to its table; then the pairs do the same with one
cut on either axis. Scoring looks bins up and adds.

Learning uses labelled rows chosen by a hash of their id, at most about ``rows`` of them; features of these are computed
in Spark and reach the driver as a table of that bounded size. Scores depend on the text alone.

Null and empty texts have all statistics zero and get the score of that. Rows with a null label are not learned from; without any
labelled row, or with labels of one kind, every text scores the smoothed share of label 1 (0.5 without labels). Repeated
rows keep their multiplicity. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.language import held_out
from aphora.llm.textmath import Words, word_chunks

#: Bound on the (expected) number of labelled rows learned from.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS = 32
COARSE = 8
ROUNDS = 150
PAIRS = 10
RATE = 0.1
RIDGE = 1.0

FEATURES = (
    "log_words", "word_bytes", "upper", "punctuation", "symbols", "digits", "exclaims", "beyond_ascii", "sentence_words", "commas",
    "line_words", "distinct_words", "repeated_neighbours", "distinct_pairs", "distinct_triples", "same_ending", "symbol_words",
)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _flags("0123456789")
_STOP = _flags(".!?")
_SYMBOL = _flags("#$%&*+/<=>@[]^_`{|}~\\")
_POINT = _flags("!\"'(),-.:;?")


def _distinct(words: Words, n: int) -> np.ndarray:
    """Share of distinct runs of n words among those of each document (1 if there are none)."""
    size = np.maximum(np.diff(words.first) - n + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + words.first[doc]
    h = words.hashes[at] if n == 1 else words.runs(at, at + n)
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.where(size > 0, np.bincount(d[new], minlength=len(size)) / np.maximum(size, 1), 1.0)


def features(words: Words, offsets: np.ndarray) -> np.ndarray:
    """Documents x FEATURES."""
    data = words.data
    n = np.diff(words.first).astype(np.float64)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets]).astype(np.float64)

    solid = np.maximum(np.diff(np.concatenate(([0], np.cumsum(words.ends - words.starts)))[words.first]), 1).astype(np.float64)
    words_or_one = np.maximum(n, 1)
    letters = np.maximum(per_doc(_LETTER[data]), 1)
    owner = np.repeat(np.arange(len(n)), np.diff(words.first))
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    tail = (last[1:] == last[:-1]) & ~_LETTER[last[1:]] & (last[1:] < 128) & (owner[1:] == owner[:-1])
    columns = [
        np.log1p(n), solid / words_or_one, per_doc(_UPPER[data]) / letters, per_doc(_POINT[data]) / solid, per_doc(_SYMBOL[data]) / solid,
        per_doc(_DIGIT[data]) / solid, per_doc(data == ord("!")) / words_or_one, per_doc(data >= 128) / solid, n / (per_doc(_STOP[data]) + 1),
        per_doc(data == ord(",")) / words_or_one, n / np.maximum(per_doc(data == 10), 1), _distinct(words, 1),
        np.bincount(owner[1:], same, len(n)) / words_or_one, _distinct(words, 2), _distinct(words, 3), np.bincount(owner[1:], tail, len(n)) / words_or_one,
        np.bincount(owner, _SYMBOL[last], len(n)) / words_or_one,
    ]
    out = np.stack(columns, 1)
    out[n == 0] = 0.0
    return out


def feature_rows(column: pa.Array) -> np.ndarray:
    parts = [np.zeros((0, len(FEATURES)))]
    for _, _, words in word_chunks(column):
        # Texts end in a line feed here, so the offsets are those of the documents' bytes.
        parts.append(features(words, words.offsets))
    return np.concatenate(parts)


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def parts(self) -> tuple:
        return self.edges, self.intercept, self.tables, self.pairs, self.grids


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


def log_odds(x: np.ndarray, edges, intercept, tables, pairs, grids) -> np.ndarray:
    b = binned(x, edges)
    out = np.full(len(x), intercept)
    for j, t in enumerate(tables):
        out += t[b[:, j]]
    for (i, j), g in zip(pairs, grids):
        out += g[b[:, i] * COARSE // BINS, b[:, j] * COARSE // BINS]
    return out


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most four leaves over ordered bins."""
    gain, cut = _best_cut(g, h)
    borders = {0, len(g)}
    if gain > 1e-9:
        borders.add(cut)
        for lo, hi in ((0, cut), (cut, len(g))):
            gain, inner = _best_cut(g[lo:hi], h[lo:hi])
            if gain > 1e-9:
                borders.add(lo + inner)
    out = np.empty(len(g))
    ends = sorted(borders)
    for lo, hi in zip(ends, ends[1:]):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts of a grid, one on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left = c[:-1, -1:] - a, c[-1:, :-1] - a
        return [a, top, left, c[-1, -1] - a - top - left]

    parts = list(zip(four(cg), four(ch)))
    gain = sum(x * x / (y + RIDGE) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g, dtype=np.float64)
    for (x, y), rows, cols in zip(parts, (slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(None, j + 1), slice(j + 1, None), slice(None, j + 1), slice(j + 1, None))):
        out[rows, cols] = _leaf(x[i, j], y[i, j])
    return float(gain[i, j]), out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Fit the tables to features and labels (0 or 1)."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model([], intercept, [])
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]
    b = binned(x, edges)
    model = Model(edges, intercept, [np.zeros(BINS) for _ in edges])
    score = np.full(len(y), intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-score))
            step = rate * _tree(np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS))
            table += step
            score += step[b[:, j]]
    cell = b * COARSE // BINS

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        at = cell[:, i] * COARSE + cell[:, j]
        return at, np.bincount(at, y - p, COARSE * COARSE).reshape(COARSE, COARSE), np.bincount(at, p * (1 - p), COARSE * COARSE).reshape(COARSE, COARSE)

    gains = []
    for i in range(len(edges)):
        for j in range(i):
            _, g, h = grid(i, j)
            gains.append((_quadrants(g, h)[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.grids = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(model.pairs, model.grids):
            at, g, h = grid(i, j)
            step = rate * _quadrants(g, h)[1]
            table += step
            score += step.ravel()[at]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labels of documents; both frames hold ``doc_id``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col(label) > 0).cast("double").alias("_y"))
    share = min(1.0, rows / max(1, known.count()))
    # The sample is bounded by ``rows``, so it may be broadcast; texts are not shuffled.
    drawn = known.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)) < share * (1 << 30))
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_y"], *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["doc_id", "_y", *FEATURES])

    kind = joined.schema["doc_id"].dataType.simpleString()
    table = joined.mapInArrow(measure, f"doc_id {kind}, _y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    table = table.sort_values(["doc_id", "_y", *FEATURES], kind="stable")
    return boost(table[list(FEATURES)].to_numpy(np.float64), table["_y"].to_numpy(np.float64))


def grade(docs: DataFrame, model: Model, carry: list[str] = ["doc_id"], threshold: float = THRESHOLD) -> DataFrame:
    """``carry`` columns with ``score`` (probability of label 1) and ``predicted``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.parts())
    source = docs.select(*carry, F.col("text").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-log_odds(feature_rows(batch["_text"]), *shipped.value)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carry], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*carry, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text")
    return source.mapInArrow(score, f"{fields}, score double, predicted int")


def grade_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows not held out and score every row: doc_id, held_out, score, predicted."""
    out: Column = held_out(F.col("doc_id"))
    model = fit(docs, labels.where(~out))
    return grade(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
