from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aphora.llm import repeats
from aphora.llm.textmath import sliding_min, word_chunks

from .helpers import SCHEMA, corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for (doc, *_), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [35, 10])
def test_words_of_repeated_windows_go(spark, length):
    rows = corpus()
    got = sorted(tuple(r) for r in repeats.removed_words(documents(spark), length).collect())
    assert got == brute(rows, length)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeats.removed_words(empty).collect() == []
    assert repeats.without_repeats(empty).columns == empty.columns
    extra = documents(spark).selectExpr("*", "'x' as row", "1 as spans", "2 as h")
    assert repeats.removed_words(extra).count() == len(corpus())


def test_cut_text_keeps_the_other_words(spark):
    rows = corpus()
    want = {(d, n, h) for d, _, n, h in brute(rows, 35)}
    cut = repeats.without_repeats(documents(spark)).collect()
    got = {(r["doc_id"], len(WORD.findall(o or "")) - len(WORD.findall(r["text"] or "")),
            hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest())
           for r in cut for d, o, *_ in rows if d == r["doc_id"]}
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)


def test_election_in_small_segments(monkeypatch):
    texts = pa.array([t for _, t, *_ in corpus()])
    for _, _, words in word_chunks(texts):
        whole = repeats.elect(words, 35, 8)
        monkeypatch.setattr(repeats, "SEGMENT", 97)
        for a, b in zip(whole, repeats.elect(words, 35, 8)):
            assert np.array_equal(a, b)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 28])
def test_sliding_min(width):
    v = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    assert sliding_min(v, width).tolist() == [v[i : i + width].min() for i in range(100 - width + 1)]


def test_chunks_do_not_change_words():
    texts = pa.array([t for _, t, *_ in corpus()])
    one = [h for _, _, w in word_chunks(texts, 1 << 30) for h in w.hashes.tolist()]
    assert one == [h for _, _, w in word_chunks(texts, 100) for h in w.hashes.tolist()]


def test_repeated_rows_list_a_span_once(spark):
    text = " ".join(f"w{i}" for i in range(120))
    frame = spark.createDataFrame([(7, text)] * 30, "row bigint, text string").repartition(4)
    (got,) = repeats.repeated_spans(frame).collect()
    assert got["spans"] and len(got["spans"]) == len(set(got["spans"]))
