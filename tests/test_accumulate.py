"""Accumulation in any graph against brute force, and without pairs where paths don't meet again."""

import random

import pytest

from urbanflow.operators import paths
from urbanflow.scratch import Scratch


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def by_hand(rows, values):
    into = {}
    for u, v in rows:
        into.setdefault(v, set()).add(u)
    out = {}
    for i in {x for e in rows for x in e} | set(values):
        seen, todo = {i}, [i]
        while todo:
            for u in into.get(todo.pop(), ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out[i] = sum(values.get(a, 0.0) for a in seen)
    return out


#: Sparse, dense and both-way edges; rings with ways in and out; a joint whose ways on lead back to it.
def graphs():
    rnd = random.Random(11)
    pick = lambda p, n, m: [(f"{p}{rnd.randrange(n)}", f"{p}{rnd.randrange(n)}") for _ in range(m)]
    rows = pick("a", 30, 25) + pick("b", 12, 20) + pick("c", 25, 30)
    rows += [(v, u) for u, v in pick("c", 25, 4)]
    rows += [("j", "v1"), ("v1", "v2"), ("v2", "j"), ("v2", "w1"), ("w1", "w2"), ("k", "j")]
    rows += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s1", "s2"), ("s2", "s3"), ("s3", "s1"), ("s2", "out"), ("in", "r2")]
    return rows + [("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d3", "d4"), ("d4", "d3"), ("d4", "d5"), ("t1", "d1"), ("t0", "t1"), ("e", "e")]


def test_any_graph(spark, one_partition):
    rows = graphs()
    ids = sorted({x for e in rows for x in e})
    values = {x: float(2**k % 1009 + k) for k, x in enumerate(ids) if k % 9} | {"alone": 3.0}
    e = spark.createDataFrame(rows, "u string, v string").coalesce(1)
    vals = spark.createDataFrame(list(values.items()), "id string, value double").coalesce(1)
    got = {r["id"]: r["total"] for r in paths.accumulate(e, vals, Scratch(spark, "t")).collect()}
    assert got == pytest.approx(by_hand(rows, values))


def test_no_pairs_along_a_chain(spark, one_partition):
    """5,000 nodes in a row behind a fork that closes again: pairs of four joints."""
    n = 5_000
    rows = [("f0", "f1"), ("f0", "f2"), ("f1", "x0"), ("f2", "x0")] + [(f"x{i}", f"x{i + 1}") for i in range(n - 1)]
    e = spark.createDataFrame(rows, "u string, v string").coalesce(1)
    values = e.selectExpr("u AS id").union(e.selectExpr("v")).distinct().selectExpr("id", "1.0D AS value")
    scratch = Scratch(spark, "t")
    got = {r["id"]: r["total"] for r in paths.accumulate(e, values, scratch).collect()}
    assert got == {"f0": 1.0, "f1": 2.0, "f2": 2.0} | {f"x{i}": i + 4.0 for i in range(n)}
    pairs = [spark.read.parquet(p).count() for p in set(scratch.places.values()) if "joint-pairs" in p]
    assert pairs and max(pairs) <= 12
