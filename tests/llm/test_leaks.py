from __future__ import annotations

import hashlib
import re

import duckdb
import pandas as pd
import pytest

from aphora.llm import leaks

from .helpers import SCHEMA, corpus, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def items():
    texts = corpus()
    rows = [(1, texts[0][1] and " ".join(texts[0][1].split()[3:40])), (2, "the, OF! the"), (3, ""), (4, None), (None, "ka kan"), (None, corpus()[20][1]), (5, "never seen anywhere"),
            (10, texts[8][1]), (10, texts[8][1]), (11, " ".join((texts[16][1] or "").split()[:12]))]
    return rows


def brute(rows, bench):
    grams = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (names := grams.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [leaks.BROADCAST_ROWS, 0])
def test_same_as_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", limit)
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    got = sorted(tuple(r) for r in leaks.contamination(documents(spark), bench).drop("row").collect())
    want = brute(corpus(), items())
    assert got == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert any(r[2] and not r[3] for r in want), "an item without an id hits"


def test_hot_row(spark):
    """A third of all rows are the same contaminated document: each is returned, and the statement agrees."""
    hot = (7, " ".join(f"w{i}" for i in range(30)), "en", "s", 0)
    rows = [hot] * 2000 + [(100 + i, f"a{i} b c d", "en", "s", 0) for i in range(4000)]
    bench = [(1, " ".join(f"w{i}" for i in range(3, 15))), (None, "b c d")]
    got = leaks.contamination(documents(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).drop("row").toPandas()
    assert len(got) == 6000 and got["contaminated"].all() and set(got["n_hit"]) == {12, 3}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(dict.fromkeys(r[:2] for r in rows)), columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(bench, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    want = con.execute(leaks.SQL).df()[list(got.columns)]
    assert set(map(tuple, got.to_numpy().tolist())) == set(map(tuple, want.to_numpy().tolist()))


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    plan = leaks.contamination(documents(spark), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_clean_keeps_the_others_as_they_were(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    dirty = {r[0] for r in brute(corpus(), items()) if r[-1]}
    kept = leaks.clean(documents(spark), bench)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in corpus() if r[0] not in dirty)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    rows = leaks.contamination(documents(spark), bench).collect()
    assert len(rows) == len(corpus()) and not any(r["contaminated"] for r in rows)
    assert leaks.contamination(spark.createDataFrame([], SCHEMA), bench).collect() == []
