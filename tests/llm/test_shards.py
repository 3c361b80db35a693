from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from aphora.llm import shards

from .helpers import SCHEMA, corpus, documents


def check(rows, got, shard_count=8):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(b, [])) for b in range(shard_count)]
    assert set(slots) <= set(range(shard_count)) and max(sizes) - min(sizes) <= 1


def spread(got):
    """Shards of every group of equal texts."""
    groups, counts = defaultdict(set), Counter()
    for r in got:
        groups[r["size"], r["text_crc32"]].add(r["shard"])
        counts[r["size"], r["text_crc32"]] += 1
    return {k: (counts[k], len(v)) for k, v in groups.items() if counts[k] > 1}


def test_corpus(spark):
    got = shards.shard_documents(documents(spark)).collect()
    check(corpus(), got)


def test_groups_stay_together(spark):
    rows = [(i, f"group {i // 5}" if i < 1500 else f"single {i}", "en", "s", 1) for i in range(4000)]
    got = shards.shard_documents(documents(spark, rows)).collect()
    check(rows, got)
    split = spread(got)
    assert len(split) == 300 and sum(n > 1 for _, n in split.values()) <= 8


@pytest.mark.parametrize("part", [50_000, 100])
def test_a_group_of_a_third_of_all_rows(spark, monkeypatch, part):
    monkeypatch.setattr(shards, "_PART", part)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 4}", "en", "s", 1) for i in range(3000)]
    got = shards.shard_documents(documents(spark, rows)).collect()
    check(rows, got)
    split = spread(got)
    hot = max(split.values())
    assert hot[0] == 1000 and hot[1] <= 5
    assert sum(n > 1 for _, n in split.values()) <= 0.1 * len(split)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "en", "s", 1)] * 13, [(None, "a", "en", "s", 1)] * 3])
def test_small_tables(spark, rows):
    check(rows, shards.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect())


def test_extra_columns(spark):
    extra = documents(spark).selectExpr("*", "1 as node", "2 as shard", "3 as key", "4 as size")
    check(corpus(), shards.shard_documents(extra).collect())
