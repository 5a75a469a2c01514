"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

Largest inner product becomes least distance by one more coordinate: sqrt(radius^2 - |x|^2) for a vector,
with ``radius`` the largest norm of all, and 0 for a query.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, parts_for


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def _lift(x: np.ndarray, radius: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, radius**2 - (x**2).sum(1)))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, each summed alike, so that equal ones are equal in every digit."""
    out = np.zeros((len(q), len(x)))
    for a, b in zip(q.T, x.T):
        out += a[:, None] * b
    return out


def build_tree(x: np.ndarray, radius: float, leaf: int = 128, seed: int = 7) -> dict[str, np.ndarray]:
    """Vantage-point tree of the rows of ``x``.

    A node splits its rows at the median distance from its vantage point. ``nodes`` has, for each node,
    vantage row (-1: leaf), inner child or first row, outer child or end row; ``split`` the median.
    """
    lift = _lift(x, radius)
    order, rng = np.arange(len(x)), np.random.default_rng(seed)
    nodes, split, todo = [[-1, 0, len(x)]], [0.0], [(0, 0, len(x))]
    while todo:
        at, a, b = todo.pop()
        if b - a <= leaf:
            nodes[at] = [-1, a, b]
            continue
        rows = order[a:b]
        v = int(rows[rng.integers(len(rows))])
        dot = x[rows] @ x[v] + lift[rows] * lift[v]
        d = np.sqrt(np.maximum(0.0, 2 * radius**2 - 2 * dot))
        rank = np.argsort(d, kind="stable")
        order[a:b] = rows[rank]
        mid = (b - a) // 2
        nodes[at] = [v, len(nodes), len(nodes) + 1]
        split[at] = float(d[rank[mid - 1]] + d[rank[mid]]) / 2
        nodes += [[-1, 0, 0], [-1, 0, 0]]
        split += [0.0, 0.0]
        todo += [(len(nodes) - 2, a, a + mid), (len(nodes) - 1, a + mid, b)]
    return {"nodes": np.array(nodes, np.int32), "split": np.array(split), "order": order.astype(np.int32)}


def search_tree(q: np.ndarray, x: np.ndarray, least: np.ndarray, tree: dict, radius: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` with the ``k`` largest products for each query (-1 where there are fewer), and these.

    ``least`` orders rows of equal product. All queries walk the tree together. Each first goes to its
    own leaf; then a side is left out for the queries whose distance to the split exceeds ``factor``
    times that of their k-th best so far. By the triangle inequality, factor 1 leaves out nothing that is
    nearer or as near (a hair's breadth is added for rounding).
    """
    nodes, split, order = tree["nodes"], tree["split"], tree["order"]
    m, norm = len(q), (q**2).sum(1)
    best, rows = np.full((m, k), -np.inf), np.full((m, k), -1, np.int64)
    home, slack = np.full(m, -1), 1e-7 * radius

    def leaf(at: int, who: np.ndarray) -> None:
        own = order[nodes[at, 1] : nodes[at, 2]]
        s = _products(q[who], x[own])
        hit = (s >= best[who, -1:]).any(1)
        who, s = who[hit], s[hit]
        if not len(who):
            return
        s = np.concatenate([best[who], s], 1)
        r = np.concatenate([rows[who], np.broadcast_to(own, (len(who), len(own)))], 1)
        names = np.where(r < 0, np.iinfo(np.int64).max, least[r])
        by = np.lexsort((names, -s), axis=1)[:, :k]
        best[who], rows[who] = np.take_along_axis(s, by, 1), np.take_along_axis(r, by, 1)

    def far(at: int, who: np.ndarray) -> np.ndarray:
        """Distance from the vantage point less the split: negative inside."""
        v = nodes[at, 0]
        return np.sqrt(np.maximum(0.0, norm[who] + radius**2 - 2 * (q[who] @ x[v]))) - split[at]

    todo = [(0, np.arange(m))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if nodes[at, 0] < 0:
            home[who] = at
            leaf(at, who)
            continue
        inside = far(at, who) <= 0
        todo += [(nodes[at, 1], who[inside]), (nodes[at, 2], who[~inside])]
    todo = [(0, np.arange(m))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if nodes[at, 0] < 0:
            leaf(at, who[home[who] != at])
            continue
        d = far(at, who)
        reach = factor * np.sqrt(np.maximum(0.0, norm[who] + radius**2 - 2 * np.maximum(best[who, -1], -1e300)))
        todo += [(nodes[at, 1], who[d <= reach + slack]), (nodes[at, 2], who[-d <= reach + slack])]
    return rows, best


#: Cells into which all points are parted by their nearest pivot, at most: these few vectors reach the driver.
CELLS = 1_024


def _pivots(points: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector: the points of least hash, ``cells`` at most in all."""
    rows = points.orderBy(F.xxhash64("v"), "v").select("v").limit(cells).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {n: np.array(v) for n, v in out.items()}


def _cell_distances(v: np.ndarray, lift: np.ndarray | float, pivots: np.ndarray, radius: float) -> np.ndarray:
    dot = v @ pivots.T + np.asarray(lift)[..., None] * _lift(pivots, radius)
    own = (v**2).sum(1) + np.asarray(lift) ** 2
    return np.sqrt(np.maximum(0.0, own[:, None] + radius**2 - 2 * dot))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    scratch: Scratch,
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = 4_096,
    block_rows: int = 1_024,
    cells: int = CELLS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query by largest inner product.

    Equal vectors are one point with their ``k + 1`` least ids, as no more can be in a result; a large
    group of copies costs one point.

    1. Points go to the cell of their nearest pivot (one for each ``shard_rows`` points, ``cells`` at
       most); cells larger than that are dealt over several shards by hash. Each shard's tree is built
       in one task. A cell's radius is its largest distance from the pivot.
    2. A query first searches its own cell. By the triangle inequality nothing in a cell is nearer than
       the pivot's distance less the cell's radius: cells for which that exceeds ``factor`` times the
       distance of the k-th best so far are left out, all others searched. The same rule prunes trees.

    With ``factor`` 1 the search is exact; smaller ones search less. Trees and blocks of queries have a
    bounded size; only their number grows.

    Scores are products of the original vectors in double precision, summed alike for every pair. Ties
    go to the smaller id. Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part. Rows that repeat id and vector count once. Of an id with two different vectors each
    may take a rank of its own, and such rows are never each other's candidates. Only vectors of a query's
    length are searched. No rows give no rows. Other columns are not looked at, whatever their names.
    """
    sound = f"""{embedding} is not null and {vec_id} is not null
        and not exists({embedding}, x -> x is null or isnan(x) or abs(x) = double('infinity'))
        and exists({embedding}, x -> x <> 0)"""

    def clean(df: DataFrame) -> DataFrame:
        return df.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).distinct()

    few = Window.partitionBy("v").orderBy("vec_id")
    points = (
        clean(vectors)
        .withColumn("r", F.row_number().over(few))
        .where(F.col("r") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    points = scratch.table(points, "points")
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).alias("radius")).first()
    radius = float(stats["radius"] or 1.0) * (1 + 1e-12)
    pivots = _pivots(points, min(cells, parts_for(stats["n"], shard_rows)))

    def place(lifted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).to_pylist()
                dim = np.array([len(v) for v in rows], np.int32)
                cell, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
                for n in np.unique(dim):  # vectors of a length without pivots form one cell of no known radius
                    own = np.flatnonzero(dim == n)
                    if int(n) not in pivots:
                        far[own] = np.inf
                        continue
                    v = np.array([rows[i] for i in own])
                    d = _cell_distances(v, _lift(v, radius) if lifted else np.zeros(len(v)), pivots[int(n)], radius)
                    cell[own], far[own] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(cell), pa.array(far)], [*batch.schema.names, "dim", "cell", "far"])

        return run

    placed = scratch.table(points.select("v", "ids").mapInArrow(place(True), "v array<double>, ids array<long>, dim int, cell int, far double"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    # one row a cell and length of vectors
    sizes = scratch.table(sizes.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")).drop("n"), "cells")

    def plant(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy())
        ids = [np.asarray(i, np.int64) for i in rows["ids"]]
        ends = np.cumsum([len(i) for i in ids])
        data = _pack(x=x, ids=np.concatenate(ids), ends=ends, **build_tree(x, radius))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "shard": [key[2]], "tree": [data]})

    sharded = placed.join(sizes.drop("radius"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("v"), "shards").cast("int"))
    trees = scratch.table(sharded.groupBy("dim", "cell", "shard").applyInPandas(plant, "dim int, cell int, shard int, tree binary"), "trees")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, b = (_unpack(batch.column(c)[i].as_py()) for c in (0, 1))
                begins = np.concatenate([[0], t["ends"][:-1]])
                rows, _ = search_tree(b["q"], t["x"], t["ids"][begins], t, radius, k + 1, factor)
                who, at = np.nonzero(rows >= 0)
                row = rows[who, at]
                score = np.zeros(len(row))
                for x, y in zip(b["q"][who].T, t["x"][row].T):
                    score += x * y
                first, n = begins[row], t["ends"][row] - begins[row]
                own = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                qid, vid, s = b["ids"][np.repeat(who, n)], t["ids"][own], np.repeat(score, n)
                other = qid != vid
                yield pa.RecordBatch.from_arrays([pa.array(qid[other]), pa.array(vid[other]), pa.array(s[other])], ["query_id", "vec_id", "score"])

    def block(key, rows: pd.DataFrame) -> pd.DataFrame:
        q = _pack(q=np.stack(rows["v"].to_numpy()), ids=rows["vec_id"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "queries": [q]})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(asked: DataFrame, name: str) -> DataFrame:
        """The best of each query (vec_id, v, dim) in the cell that its row names."""
        # blocks by each cell's own count, so that they are full and no larger than ``block_rows`` by far
        counts = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        by_block = asked.join(counts, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
        packed = by_block.groupBy("dim", "cell", "block").applyInPandas(block, "dim int, cell int, queries binary")
        met = trees.join(packed, ["dim", "cell"]).select("tree", "queries").mapInArrow(meet, "query_id long, vec_id long, score double")
        top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scratch.table(top.drop("rank"), name)

    asked = clean(queries).select("v", "vec_id").mapInArrow(place(False), "v array<double>, vec_id long, dim int, cell int, far double")
    asked = scratch.table(asked.drop("far"), "asked")
    near = search(asked, "near")
    bound = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    radii = {(r["dim"], r["cell"]): r["radius"] for r in sizes.select("dim", "cell", "radius").collect()}  # one a cell

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each further cell that a query must search."""
        for batch in batches:
            ids, vs, dims, cells_, kths = (c.to_pylist() for c in batch.columns)
            rows: list[list] = [[], []]
            for n in set(dims):
                own = [i for i, d in enumerate(dims) if d == n]
                known = sorted(c for m, c in radii if m == n)
                if n not in pivots or not known:
                    continue
                v = np.array([vs[i] for i in own])
                d = _cell_distances(v, np.zeros(len(v)), pivots[n], radius)[:, known]
                kth = np.array([-np.inf if kths[i] is None else kths[i] for i in own])
                reach = factor * np.sqrt(np.maximum(0.0, ((v**2).sum(1) + radius**2) - 2 * kth))
                must = d - np.array([radii[n, c] for c in known]) <= (reach + 1e-7 * radius)[:, None]
                must &= np.array(known)[None, :] != np.array([cells_[i] for i in own])[:, None]
                for a, b in zip(*np.nonzero(must)):
                    rows[0].append(own[a])
                    rows[1].append(known[b])
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(rows[1], pa.int32())], ["vec_id", "v", "dim", "cell"])

    rest = asked.join(bound, "vec_id", "left").select("vec_id", "v", "dim", "cell", "kth").mapInArrow(others, "vec_id long, v array<double>, dim int, cell int")
    far = search(scratch.table(rest, "rest"), "far")
    found = near.union(far)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
