from __future__ import annotations

import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from aphora.llm.queries import tokenizer_path

from . import test_leaks, test_near, test_packing, test_repeats
from .helpers import SCHEMA, documents

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    """Every stage keeps the columns, works on what the stage before kept, and decides as brute force does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == corpus_pipeline.COLUMNS
        after = sorted(tuple(r) for r in now.collect())
        if name == "language ID":
            assert set(after) <= set(before)
            assert {r[0] for r in before} - {r[0] for r in after} >= {r[0] for r in before if not any(c.isalpha() for c in r[1] or "")}
            assert len(after) > 0.9 * len(before)
        elif name == "near duplicates":
            first = {d for d, c in test_near.brute(before) if d == c}
            assert after == sorted(r for r in before if r[0] in first)
        elif name == "substring dedup":
            kept = {d: (n - gone, h) for d, n, gone, h in test_repeats.brute(before, 35)}
            words = {r[0]: test_repeats.WORD.findall(r[1] or "") for r in after}
            from hashlib import sha256

            assert {d: (len(w), sha256(" ".join(w).encode()).hexdigest()) for d, w in words.items()} == kept
        else:
            dirty = {r[0] for r in test_leaks.brute(before, items) if r[-1]}
            assert after == sorted(r for r in before if r[0] not in dirty)
        before = after
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    test_packing.check(pieces, {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in before}, 4096)
    again = corpus_pipeline.run(spark, SF).collect()
    plain = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert plain(again) == plain(pieces)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "the cat", "en", "s", 7)] * 3])
def test_odd_tables(spark, rows):
    now = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as h", "'x' as _text")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now = spark.createDataFrame(now.collect(), now.schema)
    assert sum(r["length"] for r in now.collect()) == (3 if rows and rows[0][1] else 0)


def test_the_library_does_not_need_this_folder(tmp_path):
    """Without the folder and the pipeline the entry module still imports and names the other queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); print(len(names), sum(n.startswith('op') and n[2].isdigit() for n in names), 'pipeline' in names)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["0", "False"]


def test_only_the_entry_module_names_this_folder():
    for path in ROOT.rglob("*.py"):
        inside = "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        assert inside or "aphora.llm" not in path.read_text() or path.parent.name == "tests", path


def test_rows_without_an_id_of_their_own_stay(spark):
    """Documents that share an id, or have none, are judged by their texts; every class keeps one row."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (1, text["c"]), (1, text["d"]), (2, text["d"]), (3, text["d"] + " more"), (None, text["d"]), (None, text["b"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == [("1", text["c"]), ("1", text["d"]), ("None", text["a"]), ("None", text["b"])]
    from aphora.llm import near

    assert sorted(tuple(r) for r in near.near_classes(docs).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_unclear_languages_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    from aphora.llm import language

    judged = lambda docs, model, carry: docs.withColumn("lang_pred", F.when(F.col("doc_id") < 2, "en").otherwise(language.UNKNOWN)).withColumn("score", F.lit(0.3))
    monkeypatch.setattr(language, "identify", judged)
    docs = spark.createDataFrame([(i, "the cat", "en", "s", 7) for i in range(3)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify(spark, docs, SF).collect()) == [0, 1]
