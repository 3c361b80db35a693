from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from aphora.llm import spelling
from aphora.llm.textmath import chunks

from .helpers import SCHEMA, corpus, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows) -> Counter:
    out: Counter = Counter()
    for row in rows:
        for run in RUN.findall(row[1] or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows) -> set[tuple]:
    words = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def noisy(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    parts = ["ring", "tion", "the", "an", "ß", "é", "ly", "ÀÉ", "aa", "×÷"]
    known = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    rows = []
    for i in range(size):
        text = []
        for _ in range(rng.randrange(0, 120)):
            word = known[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(word) + 1)
                word = rng.choice([word[:at] + rng.choice("aeéZ") + word[at:], word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :]])
            text.append(word)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "1", "Ā", "-\n"]).join(text), "en", "s", 1))
    return rows + [(7, None, None, None, None), (8, "", "", "", 0), (9, "abcde" * 4000 + " " + "q" * 70, "en", "s", 1)] * 3


@pytest.mark.parametrize("rows", [noisy(1, 150), noisy(2, 60), corpus() * 2])
def test_variants_equal_brute_force(spark, rows):
    got = spelling.variants(documents(spark, rows).withColumn("word", spelling.F.lit("clash")).withColumn("n", spelling.F.lit(1)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_chains_reach_their_roots(spark):
    chain = {"abcdefgh" + "x" * k: 3 * 2 ** (11 - k) for k in range(11)}
    links = {"abcdefgh" + "x" * (k + 1): "abcdefgh" + "x" * k for k in range(10)}
    words = spark.createDataFrame(list(chain.items()), "word string, n bigint")
    near = {(r["word"], r["near"]) for r in spelling.near_words(words).collect()}
    assert near == {(a, b) for k, v in links.items() for a, b in ((k, v), (v, k))}
    roots = spelling._roots(spark.createDataFrame(list(links.items()), "word string, form string"))
    assert {tuple(r) for r in roots.collect()} == {(w, "abcdefgh") for w in links}


@pytest.mark.parametrize("parts", [3, 5, 8])
def test_parts_lose_nothing(spark, parts):
    rng = random.Random(parts)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(5, 8))) for _ in range(250)})
    got = spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint"), parts).collect()
    assert sorted((r["word"], r["near"]) for r in got) == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_anagrams_are_not_paired_among_themselves(spark):
    """A hot vector: a thousand words of the same letters make pairs with a replaced letter's words only where they fit."""
    rng = random.Random(1)
    words = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(1000)})
    vectors = spark.createDataFrame([("".join(sorted(w)),) for w in words], "letters string").distinct()
    assert spelling.near_vectors(vectors).count() == 0


def test_runs_of_long_words_and_ids():
    texts = ["A" * 200 + " é×b " + "word " * 300, None, "ZzĀzZ"]
    for lo, hi, data, offsets in chunks(pa.array(texts)):
        words, counts, spoilt = spelling.runs_of(["5", "", "x" * 90][lo:hi], data, offsets)
        got = Counter({w: int(n) for w, n in zip(words.to_pylist(), counts) if n}) + spoilt
        assert got == counted(list(zip(["5", "", "x" * 90], texts)))


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
