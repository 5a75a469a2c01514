"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Only every ``STEP``-th level is stored. What lies between is computed again from the stored level below it
when proofs are drawn: an aligned subtree at a time, which gives its siblings and is then forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import Scratch

#: Children of a node, and levels from one stored level to the next.
FAN, STEP = 16, 2

PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields' texts: ``-`` for a null, else length in UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _levels(nodes: list[str], whole: bool, fan: int, step: int) -> list[list[str]]:
    """Levels of an aligned subtree from its lowest nodes: up to the tree's root if it is ``whole``, else ``step`` up."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= step:
        low = out[-1]
        out.append([sha256("".join(low[i : i + fan]).encode()).hexdigest() for i in range(0, len(low), fan)])
    return out


def _siblings(levels: list[list[str]], fan: int) -> list[list[tuple[str, str]]]:
    """For each lowest node the texts before and after it in its run, level by level."""
    above: list[list[tuple[str, str]]] = [[]]
    for nodes in reversed(levels[:-1]):
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        above = [[("".join(run[:k]), "".join(run[k + 1 :])), *above[i]] for i, run in enumerate(runs) for k in range(len(run))]
    return above


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``pos``, the place in the row's ``tree`` by ``order``, and ``n``, how many rows that has.

    Rows are sorted in ranges over tree and order, so a large tree lies in many of them; a row's place in
    its range is lifted by what the ranges before hold of the tree. A range has one sum for each tree in it.
    """
    by = ["tree", *order]
    spread = nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.table(spread, name).withColumn("_range", F.shiftright("_at", 33))
    sums = rows.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    tree = Window.partitionBy("tree")
    before = F.sum("_c").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    zero = sums.select("tree", "_range", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_zero"), F.sum("_c").over(tree).alias("n"))
    return rows.join(zero, ["tree", "_range"]).withColumn("pos", F.col("_at") - F.col("_zero")).drop("_at", "_range", "_zero")


@dataclass
class Forest:
    """Stored levels of many trees. A stage's row is an aligned subtree: ``tree``, ``sub`` (which), ``n`` (nodes
    of the whole tree at that level), ``items`` (place, hash, own); ``roots`` is ``tree, root``."""

    stages: list[DataFrame]
    roots: DataFrame
    fan: int
    step: int


def build(leaves: DataFrame, order: list[str], scratch: Scratch, name: str, fan: int = FAN, step: int = STEP) -> Forest:
    """Trees over ``leaves`` (tree, hash, own and what ``order`` names).

    Each stage packs ``fan ** step`` nodes at most into a row and stores it; a task hashes the levels of
    such a subtree and keeps its root alone. Stages are as many as the logarithm of the largest tree.
    """
    width = fan**step

    def pack(nodes: DataFrame, stage: int) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct("pos", "hash", "own")))  # ``width`` at most
        by = nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("sub"))
        return scratch.table(by.agg(F.first("n").alias("n"), items.alias("items")), f"{name}-{stage}")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(3).to_pylist()
            roots = [_levels(h, n <= width, fan, step)[-1][0] for h, n in zip(hashes, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.string())], ["tree", "sub", "n", "hash"])

    stages, roots = [], None
    nodes = _numbered(leaves, order, scratch, f"{name}-leaves").select("tree", "pos", "n", "hash", "own")
    while True:
        stages.append(pack(nodes, len(stages)))
        hashes = stages[-1].select("tree", "sub", "n", F.transform("items", lambda x: x["hash"]).alias("h"))
        up = scratch.table(hashes.mapInArrow(tops, "tree string, sub long, n long, hash string"), f"{name}-up-{len(stages)}")
        done = up.where(F.col("n") <= width).select("tree", F.col("hash").alias("root"))
        roots = done if roots is None else roots.union(done)
        rest = up.where(F.col("n") > width)
        if rest.isEmpty():
            return Forest(stages, roots, fan, step)
        nodes = rest.select("tree", F.col("sub").alias("pos"), F.ceil(F.col("n") / width).alias("n"), "hash", F.lit(None).cast("int").alias("own"))


def paths(forest: Forest, above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``tree, hash, own, top, path`` of each leaf: its siblings, level by level, and then the path of its tree.

    ``above`` has each tree's own path (``tree, top, path``), ``top`` being whatever goes along. From the
    uppermost stage on, each subtree's interior is computed anew from its stored nodes.
    """
    width = forest.fan**forest.step
    ways = None
    for k in range(len(forest.stages) - 1, -1, -1):
        stage = forest.stages[k]
        found = stage.where(F.col("n") <= width).join(above, "tree")
        if ways is not None:
            found = found.union(stage.where(F.col("n") > width).join(ways, ["tree", "sub"]).select(*found.columns))
        kind = T.StructType([found.schema["tree"], T.StructField("sub", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("own", stage.schema["items"].dataType.elementType["own"].dataType), found.schema["top"], found.schema["path"]])
        out = found.select("tree", "n", "items", "top", "path").mapInArrow(_drawn(forest.fan, forest.step), kind)
        if k == 0:
            return out.drop("sub")
        ways = scratch.table(out.select("tree", "sub", "top", "path"), f"{name}-ways-{k}")


def _drawn(fan: int, step: int):
    """Rows of a stage to one row for each of its nodes."""
    width = fan**step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                items = row.column(2).flatten()
                whole = row.column(1)[0].as_py() <= width
                own = _siblings(_levels(items.field("hash").to_pylist(), whole, fan, step), fan)
                rest = [(s["left"], s["right"]) for s in row.column(4)[0].as_py()]
                steps = [s for path in own for s in (*path, *rest)]
                ends = np.cumsum([0, *(len(path) + len(rest) for path in own)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array([s[j] for s in steps], pa.string()) for j in (0, 1)], ["left", "right"])
                at = pa.array(np.zeros(len(own), np.int32))
                columns = [row.column(0).take(at), items.field("pos"), items.field("hash"), items.field("own"), row.column(3).take(at), pa.ListArray.from_arrays(pa.array(ends), pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "sub", "hash", "own", "top", "path"])

    return run


def manifest(docs: DataFrame, leaf: Column, scratch: Scratch, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, fan: int = FAN, step: int = STEP) -> DataFrame:
    """``keep`` columns, ``leaf``, ``subroot``, ``root`` and ``proof`` of each row.

    Rows of one ``group`` (null: a group of its own, the first) ascend by ``order``; while several nodes
    remain, every ``fan`` consecutive ones become their hash. The groups' roots, in the order of the
    groups' UTF-8 bytes, become ``root`` likewise. ``proof`` has a row's siblings from the leaf up, those
    before and those after it at each level, each a text of digests; ``fold`` and ``proof_hash`` read it.

    A large group is dealt over tasks by its places. Null order keys come first. Rows with equal keys lie
    in the order of their leaves, so repeated rows make neighbouring equal leaves with a proof each. A
    null or empty text differs in its leaf; a very long one is hashed where it is read, and only the hash
    moves. No rows give no rows, and there is no root then. Other columns are not looked at, whatever
    their names.
    """
    kept = keep or {order: F.col(order)}
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # sorts as the groups do, null first
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("key"), leaf.alias("hash"), F.struct(*(c.alias(k) for k, c in kept.items())).alias("own"))
    trees = build(leaves, ["key", "hash"], scratch, "rows", fan, step)
    one = trees.roots.select(F.lit("").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("own"))
    crown = build(one, ["own"], scratch, "groups", fan, step)
    start = crown.roots.select("tree", F.col("root").alias("top"), F.array().cast(PATH).alias("path"))
    groups = paths(crown, start, scratch, "groups").select(F.col("own").alias("tree"), F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"), "path")
    found = paths(trees, scratch.table(groups, "group-paths"), scratch, "rows")
    return found.select("own.*", F.col("hash").alias("leaf"), "top.subroot", "top.root", F.col("path").alias("proof"))
