from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aphora.llm import divergence

from .helpers import SCHEMA, corpus, documents

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10) -> list[tuple]:
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for row in rows:
        text, lang, source = row[1] or "", row[2] or "", row[3] or ""
        terms = TERM.findall(text.translate(FOLD))
        groups[lang].add(source)
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, size in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:size]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def mixed(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [a + b for a in "kä to RI 日本 zz".split() for b in ("n", "ü", "Ñ", "lo", "😀", "")]
    rows = []
    for i in range(size):
        text = rng.choice([" ", "3", "\x00", "_"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200])))
        for _ in range(rng.choice([1, 1, 1, 4])):
            rows.append((i, rng.choice([text, text, None]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "c"]), 1))
    return rows + [(1, "only", "xx", "lone", 1), (2, None, "yy", "one", 1), (3, "", "yy", "two", 1)]


@pytest.mark.parametrize("rows", [mixed(1, 120), mixed(2, 30), corpus()])
def test_audit_equals_brute_force(spark, rows):
    got = divergence.audit(documents(spark, rows).withColumn("term", F.lit("clash")).withColumn("value", F.lit(0)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_other_bounds(spark):
    rows = mixed(3, 60)
    assert sorted(map(tuple, divergence.audit(documents(spark, rows), 1, 3).collect())) == brute(rows, 1, 3)


def test_copies_are_counted_but_read_once(spark):
    """A text that holds a third of all rows: one row of it is tokenised, all its copies count."""
    rows = [(i, f"word{i % 7} shared", "en", f"s{i % 3}", 1) for i in range(60)] + [(i, "hot text shared", "en", f"s{i % 2}", 1) for i in range(30)]
    read = documents(spark, rows).select("text", "lang", "source")
    counts = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.term_counts(read).collect()}
    assert counts["s0", "hot"] == (15, 15) and counts["s1", "hot"] == (15, 15) and ("s2", "hot") not in counts
    assert sorted(map(tuple, divergence.audit(documents(spark, rows)).collect())) == brute(rows)


def test_large_counts_stay_exact(spark):
    n = spark.range(1).select(F.lit(10**12).alias("n"), F.lit(10**13).alias("total"), F.lit(5).cast("bigint").alias("terms"))
    assert n.select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first()["p"] == 1 + 10**9 * (10**12 + 2) // (10**13 + 10)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
