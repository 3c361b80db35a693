from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aphora.llm import follows, mixing

from .helpers import SCHEMA, corpus, documents
from .test_mixing import brute, tokens


def held(doc_id):
    return brute([(doc_id, "")])[0][1]


def test_repeated_texts_of_rare_words_are_told_apart(spark):
    """Words outside of the named ones are predicted by the words before them, rare as these may be; but no text learned from
    foretells itself."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(1 << 40):x}" for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    copied = [i for i in range(300) if not held(i)][::20]
    more = [i for i in range(1000, 1100) if not held(i)]
    rows += [(m, texts[i], "en", "s", 1) for m, i in zip(more, copied)]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in mixing.score_corpus(spark.createDataFrame(rows, SCHEMA)).collect()}
    twice = {*copied, *more}
    assert max(bits[d] for d in bits if d in twice) < 0.3 * min(bits[d] for d in bits if d not in twice)
    once = [np.mean([b for d, b in bits.items() if d not in twice and held(d) == h]) for h in (False, True)]
    assert once[0] > 0.6 * once[1]


@pytest.mark.parametrize("unit,part", [(4 << 20, 12 << 20), (200, 500)])
def test_counts_of_runs_and_words(spark, monkeypatch, unit, part):
    """Every unit is answered the counts of its runs in all texts learned from, whatever the number of units and parts."""
    monkeypatch.setattr(mixing, "UNIT_BYTES", unit)
    monkeypatch.setattr(follows, "PART_BYTES", part)
    rows = corpus()[:40]
    docs = documents(spark, rows).selectExpr("doc_id", "doc_id % 7 = 2 as held_out", "text")
    parts = follows.part_count(sum(len((r[1] or "").encode()) for r in rows))
    units = mixing._units(docs).cache()
    answers = follows.counted(mixing._dealt(units, parts)).collect()
    assert (len({r["part"] for r in answers}) > 1) == (part == 500) and (units.count() > 10) == (unit == 200)

    def runs(text):
        t = tokens(text)
        return [(*([0] * 2 + t)[i : i + 3],) for i in range(len(t))]

    learned = [r[1] for r in rows if r[0] % 7 != 2]
    three = Counter(x for t in learned for x in runs(t))
    two = Counter(x[1:] for x in three.elements())
    words = Counter(w for t in learned for w in tokens(t)[:-1])
    seen = 0
    for unit_, data in units.toLocalIterator():
        mine, _ = mixing._rows_of(data)
        texts = mine["text"].to_pylist()
        hashes, n = (np.concatenate(x) for x in zip(*((w.hashes, np.diff(w.first)) for *_, w in mixing.lower_chunks(mine["text"]))))
        a, b, c = follows.answered({r["part"]: r["data"] for r in answers if r["unit"] == unit_})
        place = follows.distinct(*follows.runs(hashes, n), parts)[-1]
        assert a[place].tolist() == [two[x[1:]] for t in texts for x in runs(t)]
        assert b[place].tolist() == [three[x] for t in texts for x in runs(t)]
        assert c[follows.distinct(hashes, hashes, parts)[-1]].tolist() == [words[w] for t in texts for w in tokens(t)[:-1]]
        seen += len(texts)
    assert seen == len(rows)
    alike = [follows.unpacked(r["seen"], 2) for r in answers if r["unit"] is None]
    assert sum(x[1] for x in alike).tolist() == [sum(v == 1 for v in c.values()) for c in (two, three)]
    assert sum(x[0] for x in alike).reshape(2, -1).sum(1).tolist() == [sum(two.values()), len(two)]
    assert sum(r["n"] for r in mixing.word_counts(spark.createDataFrame(answers, "unit bigint, part int, data binary, seen binary, words binary")).collect()) == sum(words.values())


def test_scores_do_not_depend_on_units_and_parts(spark, monkeypatch):
    docs = documents(spark).cache()
    found = []
    for unit, part in ((4 << 20, 12 << 20), (300, 700)):
        monkeypatch.setattr(mixing, "UNIT_BYTES", unit)
        monkeypatch.setattr(follows, "PART_BYTES", part)
        found.append(sorted((r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in mixing.score_corpus(docs).collect()))
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert np.allclose(*([x[2:] for x in f] for f in found), rtol=1e-9)


def test_distinct_keys_by_part():
    rng = np.random.default_rng(2)
    for size, parts in ((0, 3), (1, 1), (5000, 7)):
        keys = rng.integers(0, 900, size).astype(np.uint64) << np.uint64(5)
        found, first, one, place = follows.distinct(keys, keys, parts)
        part = (found & follows._LOW) % np.uint64(parts)
        assert sorted(found.tolist()) == np.unique(keys).tolist() and first[0] == 0 and first[-1] == len(found)
        assert [(p, k) for p, k in zip(part.tolist(), found.tolist())] == sorted(zip(part.tolist(), found.tolist()))
        assert all((part[first[p] : first[p + 1]] == p).all() for p in range(parts))
        assert (found[place] == keys).all() and (keys[one] == found).all()


def test_packed_arrays():
    rng = np.random.default_rng(4)
    arrays = [rng.integers(0, 1 << b, n).astype(np.uint64) for b, n in ((63, 50), (1, 9), (20, 0), (17, 300))] + [np.zeros(4, np.uint64), np.array([2**64 - 1], np.uint64)]
    assert [a.tolist() for a in follows.unpacked(follows.packed(*arrays), len(arrays))] == [a.tolist() for a in arrays]


def test_predictors_are_switched_token_by_token():
    rng = np.random.default_rng(7)
    n = np.array([1, 63, 64, 65, 700, 2])
    experts = rng.random((3, n.sum())) ** 6
    experts[:, 100:200] *= 1e-30
    want, at = [], 0
    for m in n:
        weights, total = np.full(3, 1 / 3), 0.0
        for e in experts[:, at : at + m].T:
            p = weights @ e
            total += math.log(p)
            weights = (1 - follows.SWITCH) * weights * e / p + follows.SWITCH / 3
        want.append(total)
        at += m
    assert np.allclose(follows.switched(experts, n), want, rtol=1e-12)


def test_contexts_share_one_unit_of_probability():
    shorter = np.array([0.5, 0.3, 0.2])
    assert np.isclose(follows.continued(shorter, np.array([4, 0, 1]), np.full(3, 5), 2.5).sum(), 1)
    assert (follows.continued(shorter, np.zeros(3, int), np.zeros(3, int), 2.5) == shorter).all()


def test_concentration_gives_the_shorter_context_the_share_of_runs_met_once():
    times, mean = np.array([10.0, 200.0, 3000.0]), np.array([1.0, 20.0, 300.0])
    a = follows.concentration(times, mean, 600.0)
    assert np.isclose((times * a / (mean - 1 + a)).sum(), 600)
    assert math.isfinite(follows.concentration(np.zeros(1), np.zeros(1), 0.0))
