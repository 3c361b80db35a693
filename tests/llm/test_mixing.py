from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aphora.llm import mixing

from .helpers import SCHEMA, corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute(rows):
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    counts = Counter(t for d, text, *_ in rows if not held[d] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return sorted((d, held[d], len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t, *_ in rows)


@pytest.mark.parametrize("frequent", [mixing.FREQUENT, 5])
def test_counts_and_base(spark, frequent):
    rows = corpus()
    got = sorted(tuple(r) for r in mixing.score_corpus(documents(spark, rows).selectExpr("*", "1 as row", "2 as h"), frequent).collect())
    want = brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert all(r[6] < 0 for r in got)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.score_corpus(docs).where("held_out").toPandas()
    assert got["score"].sum() > 0.97 * got["base_score"].sum()
    assert (got["score"] > got["base_score"]).mean() > 0.9


def test_symbols_share_one_unit_of_probability():
    rng = np.random.default_rng(1)
    sizes = (8, 9)
    code = mixing.huffman(rng.integers(0, 1000, mixing.SYMBOLS))
    size = int(mixing.bases(sizes)[-1])
    mixer = mixing.Mixer.new(2)
    model = mixing.Bits(rng.normal(size=size).astype(np.float32), rng.integers(0, 8, size).astype(np.uint8), rng.normal(size=(mixing.GATES, 2)), mixing.refinement(mixer), sizes).parts()
    symbols = np.arange(mixing.SYMBOLS)
    contexts = [np.full(len(symbols), 7, np.uint64), np.full(len(symbols), 9, np.uint64)]
    assert abs(np.exp(mixing.log_bits(symbols, contexts, code, model)).sum() - 1) < 1e-9


def test_learning_lowers_the_cost(spark, monkeypatch):
    texts = ["the cat sat on the mat and the dog sat on the log"] * 300
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = mixing.score_corpus(docs).collect()
    assert all(r["score"] > r["base_score"] for r in rows)
    assert max(r["bits_per_byte"] for r in rows) < 1.2


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    look = mixing.Lookup(keys)
    assert np.array_equal(look.find(keys), np.arange(len(keys)))
    assert (look.find(keys + np.uint64(1)) < 0).all()
    assert (mixing.Lookup(keys[:0]).find(keys) < 0).all()


def test_contexts():
    (_, _, data, words), = mixing.lower_chunks(pa.array(["a the bb A", None, "c", "bb the bb the a"]))
    named = np.where(words.ends - words.starts == 3, 7, mixing.NAMED + mixing.classes(data, words))
    symbols, (none, before, one, two) = mixing.tokens(words, named)
    assert (symbols == mixing.STOP).tolist() == [False] * 4 + [True, True, False, True] + [False] * 5 + [True]
    assert not none.any()
    assert before[0] == before[5] == before[6] == before[8] and before[2] == before[10] == before[12] and before[3] == before[9] == before[11]
    assert len({*one.tolist()}) == 2 and [x == one[2] for x in one] == [False, False, True, True, True, False, False, False, False, False, True, True, True, True]
    assert len({*two.tolist()}) == 3 and two[12] == two[13] != two[11] == two[2]


def test_small_tables(spark):
    assert mixing.score_corpus(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mixing.score_corpus(spark.createDataFrame([(1, None, None, None, None), (None, "x y", None, None, None)] + [(2, "x " * 30_000, "en", "s", 1)] * 2, SCHEMA)).collect()
    assert len(rows) == 4 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)


def test_weights_learn_from_every_bit(spark, monkeypatch):
    """However many blocks a task has, the mass behind the weights and the refinement is that of all bits."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    merged, seen = mixing.Mixer.merged, []
    monkeypatch.setattr(mixing.Mixer, "merged", lambda contexts, rows: seen.extend(rows) or merged(contexts, rows))
    texts = ["the cat sat on the mat"] * 600
    code = mixing.huffman(np.ones(mixing.SYMBOLS))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    mixing.learn(docs, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), code, (12, 12, 12, 12))
    (_, _, data, words), = mixing.lower_chunks(pa.array(texts))
    symbols = mixing.tokens(words, mixing.NAMED + mixing.classes(data, words))[0]
    bits = int(code[0][symbols].sum())
    assert len(symbols) > 60 * mixing.BLOCK
    assert sum(m for m, _ in seen) == bits
    assert sum(r[-mixing.GATES * (mixing.STEPS + 1):].sum() for _, r in seen) == bits


def test_blocks_of_any_size_hold_the_same_bits(monkeypatch):
    """Pieces and blocks change nothing but the order of work; a context that is the same everywhere is hashed like others."""
    rng = np.random.default_rng(8)
    length, nodes, values = code = mixing.huffman(rng.integers(0, 1000, mixing.SYMBOLS))
    symbols, sizes = rng.integers(0, mixing.SYMBOLS, 500), (6, 11, 9)
    contexts = [np.full(500, 3, np.uint64), rng.integers(0, 1 << 62, 500).astype(np.uint64), rng.integers(0, 5, 500).astype(np.uint64)]
    want = [(i, values[s, j], [int((int(c[i]) ^ (int(nodes[s, j]) + 1) * int(mixing._SPREAD) % 2**64) * int(mixing._SPREAD) % 2**64 >> 64 - b) + int(at)
             for c, b, at in zip(contexts, sizes, mixing.bases(sizes))]) for i, s in enumerate(symbols) for j in range(length[s])]
    for size, piece in ((None, 4096), (64, 4096), (64, 5), (1, 7)):
        monkeypatch.setattr(mixing, "PIECE", piece, raising=False)
        got = [(o, b, s) for owner, bit, slots in mixing.blocks(symbols, contexts, code, sizes, size) for o, b, s in zip(owner.tolist(), bit.tolist(), slots.T.tolist())]
        assert got == want


def test_counts_are_added_in_one_step_where_tasks_are_few(spark):
    """Groups of one part each are not added up twice; parts of many tasks still are."""
    blob = np.arange(2 * mixing.PART, dtype="<i4").tobytes()
    parts = spark.createDataFrame([(p, blob) for p in (0, 1) for _ in range(70)], "part int, counts binary").repartition(70)
    for tasks, steps in ((20, 1), (70, 2)):
        found = mixing._added(parts, tasks)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == steps
        got = {r["part"]: np.frombuffer(r["counts"], "<i8") for r in found.collect()}
        assert sorted(got) == [0, 1] and all((v == 70 * np.arange(2 * mixing.PART)).all() for v in got.values())


def test_counted_slots():
    """Counting in place and in order give the same counts, and each slot met once."""
    rng = np.random.default_rng(5)
    for size in (64, 1 << 17):
        slots, bit = rng.integers(0, 50, 3000) + 8, rng.integers(0, 2, 3000).astype(np.uint8)
        n, want = np.zeros((size + 8, 2), np.int32), np.zeros((size + 8, 2), np.int32)
        np.add.at(want, (slots, bit), 1)
        met = mixing.counted(n, slots, bit, size, 8)
        assert (n == want).all() and met.tolist() == sorted(set(slots.tolist()))


def test_looks_find_predictions_and_gates():
    sizes, rng = (3, 4, 5), np.random.default_rng(6)
    at = mixing.bases(sizes)
    table, level = rng.normal(size=at[-1]).astype(np.float32), rng.integers(0, 8, at[-1]).astype(np.uint8)
    held = mixing.Bits(table, level, None, None, sizes).parts()[:2]
    slots = np.stack([rng.integers(at[k], at[k + 1], 40) for k in range(3)])
    inputs, gate = mixing.Slots.of(sizes, *held).look(slots)
    assert (inputs == table[slots]).all()
    assert gate.tolist() == [int(a) * 4 + min((int(b) + 1) // 2, 3) for a, b in zip(level[slots[2]], level[slots[1]])]
