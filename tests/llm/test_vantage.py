from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aphora.llm import queries, vantage
from tests.conftest import DATA

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k):
    keep = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            keep[i] = np.array(v, np.float32).astype(np.float64)
    out = []
    for q, a in keep.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in keep.items() if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def table(n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dim))
    rows = [(i, [float(x) for x in np.round(centers[i % 9] + rng.normal(scale=0.3, size=dim), 2)], 0) for i in range(n)]
    rows += [(n, rows[100][1], 0), (n + 1, rows[100][1], 0), (-100, rows[7][1], 0), (n + 2, None, 0), (n + 3, [], 0), (n + 4, [0.0] * dim, 0),
             (n + 5, [float("nan")] + [1.0] * (dim - 1), 0), (n + 6, [None] + [1.0] * (dim - 1), 0), (n + 7, [float("inf")] * dim, 0), (None, [1.0] * dim, 0),
             (1_000, [1.0, 2.0], 0), (1_001, [1.0, 3.0], 0), (100, rows[100][1], 0)]
    return rows


def check(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-14, atol=0)


@pytest.mark.parametrize("per_shard,per_block", [(4096, 1024), (100, 3)])
def test_exact(spark, per_shard, per_block):
    rows = table()
    vectors = vantage.usable(spark.createDataFrame(rows, SCHEMA)).cache()
    got = vantage.nearest(vantage.build(vectors, per_shard), vectors.where("vec_id % 20 = 0"), 10, 1.0, per_block)
    check(sorted(tuple(r) for r in got.collect()), brute(rows, 20, 10))


def test_query_and_few_rows(spark):
    for rows in (table(), table()[600:], table()[99:103], []):
        frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as dim", "2 as vector")
        check(sorted(tuple(r) for r in vantage.search_table(frame).collect()), brute(rows, 100, 10))


def test_factor_trades_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    ids = np.arange(3000)
    tree = vantage.grow(x, ids)
    exact, names = vantage.search(x, ids, tree, x[:40], ids[:40], 10, 1.0)
    for i in range(40):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert names[i].tolist() == np.lexsort((ids, d))[:10].tolist()
    _, fast = vantage.search(x, ids, tree, x[:40], ids[:40], 10, 3.0)
    hits = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(names.tolist(), fast.tolist())])
    assert 0.3 < hits <= 1.0


def test_shape_of_the_tree():
    x = np.ones((500, 3))
    tree = vantage.grow(x, np.arange(500))
    assert sorted(tree["order"].tolist()) == list(range(500))
    _, names = vantage.search(x, np.arange(500), tree, x[:3], np.arange(3), 4, 1.0)
    assert names.tolist() == [[1, 2, 3, 4], [0, 2, 3, 4], [0, 1, 3, 4]]


@pytest.mark.parametrize("factor", [2.0**600, 2.0**-520, 1e200])
def test_huge_and_tiny_vectors(spark, factor):
    """Vectors whose squares overflow or vanish are found as those of common size are."""
    rows = [r for r in table() if r[0] is not None][:80]
    scaled = [(i, None if v is None else [None if x is None else x * factor for x in v], *rest) for i, v, *rest in rows]
    double = SCHEMA.replace("float", "double")
    plain = {(r["query_id"], r["rank"]): r for r in vantage.search_table(spark.createDataFrame(rows, double), every=20).collect()}
    got = vantage.search_table(spark.createDataFrame(scaled, double), every=20).collect()
    assert len(got) == len(plain) > 0
    for r in got:
        assert np.isclose(r["score"], plain[r["query_id"], r["rank"]]["score"] * factor, rtol=1e-12, atol=0)


def test_far_cells_are_not_visited(spark):
    """Vectors in tight groups: a query's second round meets few of the other cells, and nothing is lost."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in 50.0 * np.eye(16)[i % 16] + rng.normal(size=16)], 0) for i in range(4000)]
    vectors = vantage.usable(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).cache()
    index, asked = vantage.build(vectors, 50), vectors.where("vec_id % 100 = 0").cache()
    own = vantage.own_cells(index, asked)
    found = vantage._best(vantage.visit(index, own, 10, 1.0, 1024), 10)
    visits = vantage.other_cells(index, own, found, 10, 1.0).agg(F.sum(F.size("cells"))).first()[0] or 0
    cells = index.shards.select("cell").distinct().count()
    assert cells > 60 and visits < 0.25 * 40 * cells
    got = vantage.nearest(index, asked, 10, 1.0)
    want = [(q, r, i, d) for q, r, i, d in brute_double(rows, 100, 10)]
    check(sorted(tuple(r) for r in got.collect()), want)


def brute_double(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for q in range(0, len(rows), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(near)]
    return sorted(out)


def test_hot_cell_is_split(spark):
    """A third of all vectors are equal: their cell has several shards of bounded size."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 17), float(i % 13), 1.0 + i % 5], 0) for i in range(3000)]
    vectors = vantage.usable(spark.createDataFrame(rows, SCHEMA)).cache()
    index = vantage.build(vectors, 100)
    sizes = [len(r["ids"]) // 8 for r in index.shards.select("ids").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 200
    got = vantage.nearest(index, vectors.where("vec_id % 60 = 0"), 10, 1.0, 7)
    check(sorted(tuple(r) for r in got.collect()), brute(rows, 60, 10))


def test_statement(spark):
    """The query and its statement agree to the last bit on the given table."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.QUERIES["op10_vantage_search"].run(spark, DATA).toPandas()
    want = con.execute(queries.QUERIES["op10_vantage_search"].sql).df()
    assert list(got.columns) == list(want.columns) and len(got) > 0
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
