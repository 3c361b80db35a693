from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aphora.llm import language
from aphora.llm.textmath import chunks

from .helpers import SCHEMA

SF = "/root/testdata/sf0.01"


def slow_grams(text):
    """The n-grams of a text by plain Python, hashed like the operator's."""
    out, run = [], "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text)
    letters = []
    for i, c in enumerate(run + " "):
        if c != " ":
            letters.append(ord(c))
        elif i and run[i - 1] != " ":
            letters.append(0)
    for order, seed in zip(language.ORDERS, language._SEEDS):
        for i in range(len(letters) - order + 1):
            if order == 1 and not letters[i]:
                continue
            h = seed
            for c in letters[i : i + order]:
                h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language.BITS))
    return sorted(out)


def test_grams():
    texts = ["Straße, été 12 x", "", None, "日本語 — a", "\U0001d54f\U0001d550 z", "12 !?", "ab" * 3000]
    for limit in (10, 1 << 20):
        for lo, hi, data, offsets in chunks(pa.array(texts), limit):
            bucket, doc, letters = language._grams(data, offsets)
            for d in range(hi - lo):
                text = texts[lo + d] or ""
                assert sorted(bucket[doc == d].tolist()) == slow_grams(text)
                assert letters[d] == sum(c.isalpha() for c in text)


def test_memory_is_that_of_a_piece():
    """The arrays of the n-grams belong to a small piece of a batch, not to a megabyte of it."""
    texts = pa.array(["the cat sat on the mat " * 100] * 2000)
    language._classes()
    tracemalloc.start()
    rows = 0
    for lo, hi, bucket, doc, _ in language._gram_pieces(texts):
        assert lo == rows
        rows = hi
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 60e6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_corpus(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    tested = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = tested.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97


def test_odd_rows(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate([
        ("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("un chat", None), (None, "en"), ("", "fr"), ("12 34", "en"), ("the dog " * 20000, None)])]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA).selectExpr("*", "1 as lang_pred", "2 as score")
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert [got[i][0] for i in range(7)] == ["en", "fr", "fr", "und", "und", "und", "en"]
    assert got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(docs, model).count() == 8


def test_without_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify_corpus(empty).collect() == []
    rows = spark.createDataFrame([(1, "some text", None, "s", 1)], SCHEMA)
    assert [tuple(r) for r in language.identify_corpus(rows).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_training_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few, all_ = language.fit(docs, rows=50), language.fit(docs)
    assert few.languages == all_.languages and not np.array_equal(few.weights, all_.weights)


@pytest.mark.parametrize("parts,part", [(4, 2), (7, 2)])
def test_held_out(spark, parts, part):
    import zlib

    got = spark.range(50).select("id", language.held_out(F.col("id"), parts, part).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % parts == part) for r in got)
