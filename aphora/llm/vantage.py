"""Nearest neighbours by vantage-point trees, one tree per shard of the vectors.

Building: a bounded sample of the vectors (one per ``per_shard`` rows, at most ``PIVOT_BYTES``) gives pivots. Every vector joins the
cell of its nearest pivot; a cell of more than ``per_shard`` rows is dealt to several shards by a hash of the id. A shard's tree
splits its vectors at the median distance from a vantage point, down to leaves of ``LEAF`` vectors; trees are rows of the index table.
Searching: a query first visits its own cell. The distances found there, and the nearest and farthest vector of each cell as seen
from its pivot, tell which other cells may hold a nearer one; only these are visited, in a second round. At a node the side
nearer to the query comes first; the other side is left out if the triangle inequality puts it beyond the worst of the
neighbours found: ``factor * bound > worst``, for cells as for sides. Factor one restores exact search; larger factors prune
more and may miss neighbours. The best of all shards are merged.

Distances are Euclidean, in double precision, between the vectors as they are, squares added in the order of the components; huge and tiny ones are scaled by a power of two
meanwhile, so that no square overflows. Vectors that are null, empty or zero, or hold
null or non-finite components, take no part; vectors of different lengths never meet. Rows with the same id are one vector
(the smallest of them, if they differ); a query does not find its own id. Ties go to the smaller id. With fewer
candidates than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aphora.llm.tables import stored

PER_SHARD = 4096
PER_BLOCK = 1024
LEAF = 64
#: Bytes of the pivots, which every executor receives.
PIVOT_BYTES = 16 << 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector as doubles) of the vectors that take part, one per id."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of every row of ``a`` from every row of ``b``."""
    out = np.zeros((len(a), len(b)))
    for left, right in zip(a.T, np.ascontiguousarray(b.T)):
        part = left[:, None] - right
        part *= part
        out += part
    return np.sqrt(out, out=out)


def least(d: np.ndarray, edge: np.ndarray | float) -> np.ndarray:
    """What is left of ``d - edge``, less a hair for rounding."""
    return d - edge - 1e-12 * (d + edge)


def grow(x: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """A tree as arrays: ``order`` of the rows, and nodes (first row, one past the last, radius, inner child, outer child).

    A node's first row is its vantage point; a leaf has no children (-1).
    """
    order, nodes = np.lexsort((ids,)), []

    def split(lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append([lo, hi, 0.0, -1, -1])
        if hi - lo <= LEAF:
            return at
        part = order[lo:hi]
        # The vantage point: the row farthest from the middle of the part (the first of several).
        far = int(((x[part] - x[part].mean(0)) ** 2).sum(1).argmax())
        part[[0, far]] = part[[far, 0]]
        d = distances(x[part[:1]], x[part[1:]])[0]
        ranked = np.argsort(d, kind="stable")
        part[1:] = part[1:][ranked]
        half = (len(d) + 1) // 2
        nodes[at][2] = float(d[ranked[half - 1]])
        nodes[at][3] = split(lo + 1, lo + 1 + half)
        nodes[at][4] = split(lo + 1 + half, hi)
        return at

    if len(order):
        split(0, len(order))
    table = np.array(nodes, np.float64).reshape(-1, 5)
    return {"order": order, "nodes": table}


def search(x: np.ndarray, ids: np.ndarray, tree: dict[str, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids (rows of k, best first; missing: inf and -1) of each query's nearest rows other than itself.

    ``worst`` holds the distance of the k-th neighbour already known of each query; rows beyond it need not be found.
    """
    limit = np.full(len(queries), np.inf) if worst is None else worst
    best = np.full((len(queries), k), np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    order, nodes = tree["order"], tree["nodes"]

    def offer(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = distances(queries[q], x[rows])
        given = np.where(ids[rows][None, :] == query_ids[q][:, None], np.inf, d)
        all_d, all_n = np.hstack((best[q], given)), np.hstack((names[q], np.broadcast_to(ids[rows], given.shape)))
        all_n = np.where(np.isinf(all_d), np.iinfo(np.int64).max, all_n)
        first = np.lexsort((all_n, all_d), axis=1)[:, :k]
        best[q], names[q] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_n, first, 1)
        return d

    def visit(at: int, q: np.ndarray) -> None:
        if not len(q):
            return
        lo, hi, radius, inner, outer = nodes[at]
        if inner < 0:
            offer(q, order[int(lo) : int(hi)])
            return
        d = offer(q, order[int(lo) : int(lo) + 1])[:, 0]
        near = d <= radius
        visit(int(inner), q[near])
        visit(int(outer), q[~near])
        # No row beyond the radius is nearer than radius - d, none within it nearer than d - radius.
        bound = np.maximum(least(d, radius), least(radius, d)) * factor
        open_ = bound <= np.minimum(best[q, -1], limit[q])
        visit(int(outer), q[near & open_])
        visit(int(inner), q[~near & open_])

    if len(order) and len(queries):
        visit(0, np.arange(len(queries)))
    return best, np.where(np.isinf(best), -1, names)


def _pack(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
    return {"ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes()}


def _unpack(row, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)


@dataclass
class Index:
    """The shards (dim, cell, part, lo, hi, ids, vectors, order and nodes of the tree) and the pivots by length: cells and vectors.

    ``lo`` and ``hi`` are the distances of the shard's nearest and farthest vector from the pivot.
    """

    shards: DataFrame
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]


def choose_pivots(vectors: DataFrame, per_shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One vector in ``per_shard``, at most ``PIVOT_BYTES`` of them, by the order of a hash; lengths may go without."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    if not size["n"]:
        return {}
    count = min(-(-size["n"] // per_shard), max(1, PIVOT_BYTES // (8 * size["dim"])))
    found: dict[int, list] = {}
    for cell, r in enumerate(vectors.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(count).collect()):
        found.setdefault(r["dim"], []).append((cell, r["vector"]))
    return {dim: (np.array([c for c, _ in rows]), np.array([v for _, v in rows], np.float64)) for dim, rows in found.items()}


def placed(vectors: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id, vector, dim, the cell of the nearest pivot, and how far ``away`` it is; -1 and 0 if the length has no pivot."""
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            dims, cell, away = rows["dim"].to_numpy(), np.full(len(rows), -1), np.zeros(len(rows))
            for dim in np.unique(dims):
                names, centres = shipped.value.get(int(dim), (None, None))
                if names is None:
                    continue
                norms = (centres**2).sum(1)
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 1024):
                    mine = at[lo : lo + 1024]
                    x = np.stack(rows["vector"].to_numpy()[mine])
                    best = (norms - 2 * (x @ centres.T)).argmin(1)
                    cell[mine] = names[best]
                    away[mine] = np.sqrt(((x - centres[best]) ** 2).sum(1))
            yield rows.assign(cell=cell.astype(np.int32), away=away)

    return vectors.select("vec_id", "vector", "dim").mapInPandas(place, "vec_id bigint, vector array<double>, dim int, cell int, away double")


def build(vectors: DataFrame, per_shard: int = PER_SHARD) -> Index:
    """The index of vectors (vec_id, vector, dim)."""
    pivots = choose_pivots(vectors, per_shard)
    rows = placed(vectors, pivots)
    # The table of cells is small, and stored, so that its size is known to the join.
    cells = stored(rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / per_shard).alias("parts")), "cells")
    dealt = rows.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.float64)
        tree = grow(x, ids)
        first = {c: rows[c].iloc[0] for c in ("dim", "cell", "part")}
        return pd.DataFrame([{**first, "lo": rows["away"].min(), "hi": rows["away"].max(), **_pack(ids, x), "order": tree["order"].astype("<i8").tobytes(), "nodes": tree["nodes"].astype("<f8").tobytes()}])

    schema = "dim int, cell int, part int, lo double, hi double, ids binary, vectors binary, order binary, nodes binary"
    return Index(stored(dealt.groupBy("dim", "cell", "part").applyInPandas(plant, schema), "index"), pivots)


def own_cells(index: Index, queries: DataFrame) -> DataFrame:
    """vec_id, vector, dim, worst, cells: the first round, each query and its own cell."""
    return stored(placed(queries, index.pivots).select("vec_id", "vector", "dim", F.lit(math.inf).alias("worst"), F.array("cell").alias("cells")), "own-cells")


def other_cells(index: Index, own: DataFrame, found: DataFrame, k: int, factor: float) -> DataFrame:
    """The second round: each query and the cells besides its own that may hold a vector as near as its k-th found."""
    known = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("known"))
    asked = own.join(known, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "dim", F.coalesce("known", "worst").alias("worst"), "cells")
    ranges = {r["cell"]: (r["lo"], r["hi"]) for r in index.shards.where("cell >= 0").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    by_dim = {}
    for dim, (names, centres) in index.pivots.items():
        filled = np.array([c in ranges for c in names], bool)
        edges = np.array([ranges[c] for c in names[filled]]).reshape(-1, 2)
        by_dim[dim] = names[filled], centres[filled], edges[:, 0], edges[:, 1]
    shipped = own.sparkSession.sparkContext.broadcast(by_dim)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cells = []
            for vector, dim, worst, own_cell in zip(rows["vector"], rows["dim"], rows["worst"], rows["cells"]):
                if dim not in shipped.value:
                    cells.append([])
                    continue
                names, centres, lo, hi = shipped.value[dim]
                d = distances(np.asarray(vector)[None, :], centres)[0]
                bound = np.maximum(least(d, hi), least(lo, d)) * factor
                cells.append(names[(bound <= worst) & (names != own_cell[0])].astype(np.int32))
            yield rows.assign(cells=cells)

    routed = asked.mapInPandas(route, "vec_id bigint, vector array<double>, dim int, worst double, cells array<int>")
    return stored(routed.where("size(cells) > 0"), "other-cells")


def visit(index: Index, asked: DataFrame, k: int, factor: float, per_block: int) -> DataFrame:
    """query_id, vec_id, score: at most k from every shard of the cells that each query visits."""
    visits = asked.select("vec_id", "vector", "dim", "worst", F.explode("cells").alias("cell"))
    blocks = stored(visits.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks")), "visits")
    block = F.pmod(F.xxhash64(F.lit(3), F.col("vec_id")), F.col("blocks")).cast("int")

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.float64)
        first = {c: rows[c].iloc[0] for c in ("dim", "cell", "block")}
        return pd.DataFrame([{**first, **_pack(ids, x), "worst": rows["worst"].to_numpy("<f8").tobytes()}])

    bundles = visits.join(blocks, ["dim", "cell"]).withColumn("block", block).groupBy("dim", "cell", "block").applyInPandas(
        bundle, "dim int, cell int, block int, ids binary, vectors binary, worst binary")
    # Every pair of a shard and a block of its queries is one group: two rows of bounded size.
    left = index.shards.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = bundles.join(index.shards.select("dim", "cell", "part"), ["dim", "cell"]).select(
        *[F.col(c).alias(f"to_{c}") for c in ("dim", "cell", "part", "block")], "ids", "vectors", "worst")

    def ask(tree_rows: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(tree_rows) or not len(block_rows):
            return out
        tree, asked_ = tree_rows.iloc[0], block_rows.iloc[0]
        ids, x = _unpack(tree, int(tree["dim"]))
        query_ids, q = _unpack(asked_, int(tree["dim"]))
        shape = {"order": np.frombuffer(tree["order"], "<i8"), "nodes": np.frombuffer(tree["nodes"], "<f8").reshape(-1, 5)}
        d, names = search(x, ids, shape, q, query_ids, k, factor, np.frombuffer(asked_["worst"], "<f8"))
        row, col = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": names[row, col], "score": d[row, col]})

    keys = ("dim", "cell", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"to_{c}" for c in keys])).applyInPandas(ask, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(index: Index, queries: DataFrame, k: int = 10, factor: float = 1.0, per_block: int = PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors of the index for each row (vec_id, vector, dim) of ``queries``."""
    own = own_cells(index, queries)
    found = stored(_best(visit(index, own, k, factor, per_block), k), "own-neighbours")
    more = visit(index, other_cells(index, own, found, k, factor), k, factor, per_block)
    return _best(found.drop("rank").unionByName(more), k)


def search_table(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """The neighbours of every vector whose id is divisible by ``every``, among all others."""
    rows = stored(usable(vectors), "vectors")
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    scale = _scale(largest)
    rows = stored(rows.withColumn("vector", F.transform("vector", lambda x: x * scale)), "scaled-vectors") if scale != 1 else rows
    found = nearest(build(rows), rows.where(F.col("vec_id") % every == 0), k, factor)
    return found.withColumn("score", F.col("score") / scale) if scale != 1 else found


def _scale(largest: float | None) -> float:
    """A power of two that brings vectors whose squares would overflow, or vanish, near one; it changes no digit of them."""
    if not largest or 1e-100 < largest < 1e150:
        return 1.0
    return 2.0 ** -max(-1000, math.frexp(largest)[1])


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (
  SELECT vec_id, min(v) AS v FROM v
  WHERE len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0
  GROUP BY vec_id),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) for i in range(1, len(q.v) + 1)])) AS score
  FROM u q JOIN u c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
