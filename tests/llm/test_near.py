from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from aphora.llm import near
from aphora.llm.components import components

from .helpers import SCHEMA, corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=0.8):
    """Class of every document by comparing all pairs."""
    rows = list({r[0]: r for r in rows}.values())
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(find(i), []).append(r[0])
    return sorted((d, min(c)) for c in first.values() for d in c)


def family(seed=3, groups=12):
    """Groups of texts around an original, at all distances, besides texts that merely share a passage."""
    rng, rows = random.Random(seed), []
    words = [a + b for a in "bcdfgklmn" for b in ("a", "e", "io", "us", "er", "an")]
    passage = rng.choices(words, k=40)
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 80, 200]))
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(text) // 25) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
        rows.append(" ".join(rng.choices(words, k=60) + passage))
    return [(i * 3 + 1, t, "en", "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [corpus(), family(), family(8, 20)])
def test_classes_equal_all_pairs(spark, rows):
    got = sorted(tuple(r) for r in near.near_classes(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_rest_of_unsettled_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "MIDDLES", 0)
    rows = family(21)
    got = sorted(tuple(r) for r in near.near_classes(documents(spark, rows), bands=48, rows=2).collect())
    assert got == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert near.near_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = documents(spark).selectExpr("*", "1 as id", "2 as bands", "3 as u")
    assert near.near_classes(extra).count() == len({r[0] for r in corpus()})


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(4)
    n, k = 300, 2048
    one = {int(x): float(w) for x, w in zip(rng.integers(1, 1 << 60, n), rng.choice([0.4, 1, 2, 3.5, 9], n))}
    two = {x: w * rng.choice([1, 1, 1, 0.5]) for x, w in one.items() if rng.random() < 0.8} | {int(x): 2.0 for x in rng.integers(1, 1 << 60, 40)}
    doc = np.repeat([0, 1], [len(one), len(two)])
    element = np.array([*one, *two], np.uint64)
    weight = np.array([*one.values(), *two.values()])
    signs = near.dart_signatures(doc, element, weight, 2, k)
    keys = set(one) | set(two)
    want = sum(min(one.get(x, 0), two.get(x, 0)) for x in keys) / sum(max(one.get(x, 0), two.get(x, 0)) for x in keys)
    assert abs((signs[0] == signs[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5
    alone = near.dart_signatures(np.zeros(len(two), np.int64), element[len(one):], weight[len(one):], 1, k)
    assert np.array_equal(alone[0], signs[1])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (400, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in root if find(x) != x)
    got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect())
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_sketches_lose_far_fewer_links_than_bands(spark):
    """A pair whose first quarter disagrees often is judged by the whole sketch; the bound is an exact tail."""
    chance = 0.8 + 0.2 / 16
    t = near._least_agreeing(512, chance, near.LOSS)
    tail = lambda t: sum(math.comb(512, i) * chance**i * (1 - chance) ** (512 - i) for i in range(t))
    assert tail(t) <= 1e-7 < tail(t + 1)
    differ = [-1] * 3 + [0] * 29  # 48 of the first 128 coordinates, and of all 512
    frame = spark.createDataFrame([(differ, [0] * 32), ([-1] * 10 + [0] * 22, [0] * 32)], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in frame.select(near._likely("a", "b", 0.8)).collect()] == [True, False]


def test_texts_of_pairs_are_not_shuffled_with_all_others(spark, monkeypatch):
    """The few names in pairs are sent to the texts, whatever size the plan expects of them."""
    plans, stored = {}, near.stored

    def seen(df, purpose):
        plans.setdefault(purpose, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, purpose)

    monkeypatch.setattr(near, "stored", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near.near_classes(documents(spark))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sent = ["BroadcastHashJoin" in p for p in plans["pair-texts"]]
    assert sent and all(sent)
