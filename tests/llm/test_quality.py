from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aphora.llm import quality

from .helpers import SCHEMA, corpus

SF = "/root/testdata/sf0.01"


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return [0.0] * len(quality.FEATURES)
    b = (text + "\n").encode()
    solid = sum(len(x.encode()) for x in w)
    count = lambda flags: sum(flags[c] for c in b)
    letters = max(1, count(quality._LETTER))
    distinct = lambda n: len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) / (len(w) - n + 1) if len(w) >= n else 1.0
    ends = [x.encode()[-1] for x in w]
    return [
        np.log1p(len(w)), solid / len(w), count(quality._UPPER) / letters, count(quality._POINT) / solid, count(quality._SYMBOL) / solid, count(quality._DIGIT) / solid,
        b.count(b"!") / len(w), sum(c >= 128 for c in b) / solid, len(w) / (count(quality._STOP) + 1), b.count(b",") / len(w), len(w) / b.count(b"\n"),
        distinct(1), sum(x == y for x, y in zip(w, w[1:])) / len(w), distinct(2), distinct(3),
        sum(x == y and not quality._LETTER[x] and x < 128 for x, y in zip(ends, ends[1:])) / len(w), sum(quality._SYMBOL[e] for e in ends) / len(w)]


def test_features():
    texts = [t for _, t, *_ in corpus()] + ["A!! B!! C!!\n\nd | e | f, 12.5% é", "!", "a"]
    got = quality.feature_rows(pa.array(texts))
    assert np.allclose(got, [slow(t) for t in texts])


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.grade_corpus(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (rows["predicted"] == rows["quality"]).mean() > 0.93
    assert got.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x[:3000], y[:3000])
    p = quality.log_odds(x[3000:], *model.parts()) > 0
    assert (p == y[3000:]).mean() > 0.95 and model.pairs[0] == (1, 0)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.grade_corpus(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    assert len({r["score"] for r in quality.grade(docs, quality.fit(docs, ones)).collect()}) == 1
    assert quality.grade_corpus(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_odd_texts_and_repeated_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs.selectExpr("*", "1 as quality", "2 as score", "3 as _y"), labels, rows=200)
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "x" * 100_000, "en", "s", 1), (4, "w " * 100_000, "en", "s", 1), (4, "w " * 100_000, "en", "s", 1)]
    got = quality.grade(spark.createDataFrame(rows, SCHEMA), model)
    assert got.count() == 5 and got.where("score between 0 and 1").count() == 5
