from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from aphora.llm import subwords
from aphora.llm.queries import PIECES, tokenizer_path
from aphora.llm.textmath import chunks

from .helpers import SCHEMA, corpus, documents

sentencepiece = pytest.importorskip("sentencepiece")


def message(number: int, value: bytes) -> bytes:
    """A field of bytes as protocol buffers write it."""
    def varint(x: int) -> bytes:
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)

    return varint(number << 3 | 2) + varint(len(value)) + value


def definitions() -> dict[str, bytes]:
    """The given model as it is, and with the library's own character map, without a prefix, with squeezed spaces."""
    with open(tokenizer_path(PIECES), "rb") as f:
        plain = f.read()
    folding = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    compiled = message(2, dict(subwords.fields(dict(subwords.fields(folding))[3]))[2])
    return {
        "plain": plain, "map": plain + message(3, compiled), "squeeze": plain + message(3, compiled + b"\x20\x01"),
        "no prefix": plain + message(3, compiled + b"\x18\x00"), "squeeze without map": plain + message(3, b"\x20\x01")}


ALPHABET = [*"ab \n  ▁éﬁÅÅ㍿😀日本\x00\x85　​﻿�!<s>the of ing 12①", "</s>", "<0x41>", " " * 17, "▁▁", "Ａ", "hello world "]


def texts(seed: int, size: int) -> list[str | None]:
    rng = random.Random(seed)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(size)]
    return ["", None, " ", "  ", "▁", "\n", " a ", "a▁ ▁", "ﬁ", "é" * 50, "x" * 3000, *some]


@pytest.mark.parametrize("name", ["plain", "map", "squeeze", "no prefix", "squeeze without map"])
def test_equals_the_library(name):
    definition, rows = definitions()[name], texts(3, 500)
    encoder = subwords.Encoder(definition)
    library = sentencepiece.SentencePieceProcessor(model_proto=definition)
    for lo, hi, data, offsets in chunks(pa.array(rows), 5000):
        ids, first, start, stop = encoder.encode(data, offsets)
        decoded = encoder.model.decode(ids, first).to_pylist()
        for k, text in enumerate(rows[lo:hi]):
            part = slice(first[k], first[k + 1])
            wanted = library.encode(text or "", add_bos=True, add_eos=True)
            assert ids[part].tolist() == wanted
            assert decoded[k] == library.decode(wanted)
            spans = [(p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces]
            assert list(zip(start[part].tolist(), stop[part].tolist()))[1:-1] == spans
            assert start[part][0] == stop[part][0] == 0 and start[part][-1] == stop[part][-1] == len((text or "").encode())


@pytest.mark.parametrize("name", ["plain", "squeeze"])
def test_decodes_any_ids(name):
    definition, rng = definitions()[name], random.Random(5)
    model, library = subwords.Model(definition), sentencepiece.SentencePieceProcessor(model_proto=definition)
    some = [[rng.choice([rng.randrange(3, 300), rng.randrange(32000), 28705, 259, 1, 2, 0]) for _ in range(rng.randrange(9))] for _ in range(400)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in some])))
    got = model.decode(np.array([i for s in some for i in s], np.uint32), first).to_pylist()
    assert got == [library.decode(s) for s in some]


def test_remembered_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(subwords, "KNOWN", 500)
    rng = random.Random(1)
    encoder = subwords.Encoder(definitions()["plain"])
    rows = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(50)]
    for _, _, data, offsets in chunks(pa.array(rows), 400):
        encoder.encode(data, offsets)
        assert sum(map(len, encoder.known)) == encoder.size <= 500 + 2 * 401


def test_refuses_what_it_cannot_do():
    plain = definitions()["plain"]
    with pytest.raises(ValueError):
        subwords.Model(plain + message(5, message(2, b"\x04\x00\x00\x00\x00\x00\x00\x00")))
    with pytest.raises(ValueError):
        subwords.Model(message(1, message(1, b"a")) + message(3, b""))


def test_corpus(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    rows = corpus() + [(None, None, None, None, None), (1000, "twice", "en", "s", 1), (1000, "twice", "en", "s", 1)]
    got = subwords.encode_corpus(documents(spark, rows).withColumn("ids", subwords.F.lit(1)), tokenizer_path(PIECES)).collect()
    wanted = []
    for row in rows:
        ids = library.encode(row[1] or "", add_bos=True, add_eos=True)
        wanted.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(wanted, key=key)
    assert subwords.encode_corpus(spark.createDataFrame([], SCHEMA), tokenizer_path(PIECES)).collect() == []


def test_pieces_point_into_the_text(spark):
    rows = [(1, " Größe 日本 ok", "de", "s", 1), (2, None, None, None, None), (3, "a▁b", "en", "s", 1)]
    path = tokenizer_path(PIECES)
    found = subwords.pieces(subwords.encode(documents(spark, rows), path, bos=False, eos=False), path).collect()
    for doc, text, *_ in rows:
        mine = sorted([r for r in found if r["doc_id"] == doc], key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        raw = (text or "").encode()
        assert b"".join(raw[r["start"] : r["stop"]] for r in mine) == raw
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        assert [r["piece"] for r in mine] == library.encode(text or "", out_type=str)
