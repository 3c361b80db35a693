from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from aphora.llm import packing
from aphora.llm.queries import tokenizer_path

from .helpers import SCHEMA, corpus, documents

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(pieces, texts, window):
    """Pieces cover every document once, sequences have no gaps and nearly no padding."""
    covered, sequences, tokens = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        covered[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, ids in texts.items():
        spans = sorted(covered.pop(doc))
        assert all(n == len(ids) for *_, n in spans)
        at = 0
        for start, length, crc, _ in spans:
            assert start == at and length > 0
            assert crc == zlib.crc32(np.asarray(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
        tokens += at
    assert not covered
    padded = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        padded += at if at & (at - 1) == 0 else window
    assert padded <= 1.01 * tokens
    assert sorted(sequences) == list(range(len(sequences)))


def test_pieces(spark, tokenizer):
    rows = [r for r in {r[0]: r for r in corpus()}.values()]
    rows += [(900, "İstanbul <|endoftext|> ’s Ǆ it's we'LL 12½ ＡＢ é a b c ΑΣ 日本語 _x__ \x1c\x85 'tis", "en", "s", 1)]
    texts = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    for window in (4096, 256):
        check(packing.pack(documents(spark, rows), tokenizer_path(), window).collect(), texts, window)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two three", "en", "s", 1)] * 3 + [(None, None, None, None, None)]
    got = packing.pack(documents(spark, rows), tokenizer_path()).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in got}) == len(got)
    assert sum(p["length"] for p in got) == 3 * got[0]["doc_tokens"] + 1 or sum(p["length"] for p in got) == 13
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).collect() == []


def test_many_copies_of_one_row(spark, tokenizer):
    """Copies of one row are placed and cut one by one, and the checksum of each cut is right."""
    text = " ".join(f"word{i} of a hot row" for i in range(14))
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
    rows = [(1, text, "en", "s", 1)] * 400 + [(2, "short", "en", "s", 1)] * 3
    got = [p for p in packing.pack(documents(spark, rows), tokenizer_path(), 256).collect() if p["doc_id"] == 1]
    assert sum(p["length"] for p in got) == 400 * len(ids) and len({(p["sequence_id"], p["offset"]) for p in got}) == len(got)
    assert all(p["ids_crc32"] == zlib.crc32(np.asarray(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in got)
    assert len({(p["start"], p["length"]) for p in got}) > 1
    taken = np.zeros(len(ids), int)
    for p in got:
        taken[p["start"] : p["start"] + p["length"]] += 1
    assert (taken == 400).all()


@pytest.mark.parametrize("counts", [
    {3000: 5000}, {2049: 7, 1: 3}, {4095: 10, 1: 4, 700: 33}, {1: 1}, {}, {k: 3 for k in range(1, 4096)},
    {random.Random(i).randrange(1, 4096): random.Random(i + 99).randrange(1, 40) for i in range(300)},
])
def test_plan_uses_every_remainder_once(counts):
    plan = packing.Plan(counts, 4096, 16)
    length = np.array([k for k, v in counts.items() for _ in range(v)], np.int64)
    k = np.array([i for v in counts.values() for i in range(v)], np.int64)
    done, used, fill = np.zeros(len(k), np.int64), defaultdict(int), defaultdict(list)
    for item, start, size, sequence, offset in packing.pieces(plan.table, plan.keys, length, k):
        assert (done[item] == start).all()
        done[item] += size
        for s, o, n in zip(sequence.tolist(), offset.tolist(), size.tolist()):
            fill[s].append((o, n))
    assert (done == length).all()
    short = 0
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        used[at] += 1
        short += 0 if at & (at - 1) == 0 else 4096 - at
    assert short <= 16 * max(1, len(fill))
    assert sorted(fill) == list(range(plan.sequences))


def test_words_of_letters_are_remembered_once(tokenizer):
    """A word in lower case is its own piece; other spellings look it up, and signs alone are pieces beside it."""
    known = packing.Encoder(tokenizer.to_str())
    text = "Word word, WORD. word wOrd! Élan élan, don't x1 <pad> word"
    assert known.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert b"word" in known.words and "word" not in known.pieces and {",", ".", "!"} <= set(known.pieces)
