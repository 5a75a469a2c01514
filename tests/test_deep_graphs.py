"""Networks that are longer than any fixed number of rounds."""

import pytest
from pyspark.sql import functions as F

from urbanflow.model import Network
from urbanflow.operators import paths, topology
from urbanflow.scratch import Scratch

EDGES = "u string, v string, key int, length double, weight double, edge_type string, id string"


def street(u, v, w=1.0, key=0):
    return (u, v, key, w, w, "street", f"{u}-{v}")


def test_a_long_street_drains(spark):
    """2,000 nodes in a row, both ways, with a side street and an outfall at either end."""
    n = 2_000
    names = [f"n{i}" for i in range(n)]
    rows = [street(a, b) for a, b in zip(names, names[1:])] + [street(b, a) for a, b in zip(names, names[1:])]
    rows += [street("side", "n700", 2.0), street("n700", "side", 2.0)]
    rows += [("n0", "river0", 0, 1.0, 1.0, "outfall", "o0"), (names[-1], "river1", 0, 1.0, 1.0, "outfall", "o1")]
    nodes = spark.createDataFrame([(x, float(i), 0.0) for i, x in enumerate([*names, "side", "river0", "river1"])], "id string, x double, y double")
    net = topology.derive_topology(Network(nodes, spark.createDataFrame(rows, EDGES)), Scratch(spark, "t"))
    got = {r["id"]: (r["outfall"], r["shortest_path"]) for r in net.nodes.select("id", "outfall", "shortest_path").collect()}
    want = {x: ("n0", float(i)) if i <= n - 1 - i else (names[-1], float(n - 1 - i)) for i, x in enumerate(names)} | {"side": ("n0", 702.0)}
    assert got == want
    assert net.edges.count() == n - 1


def test_levels_of_a_long_pipe(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(1_500)] + [("head", "n1200"), ("far", "n3")]
    got = {r["id"]: r["level"] for r in paths.levels(spark.createDataFrame(rows, "u string, v string"), Scratch(spark, "t")).collect()}
    assert got == {f"n{i}": i for i in range(1_501)} | {"head": 0, "far": 0}
    with pytest.raises(ValueError, match="cycle"):
        paths.levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "u string, v string"), Scratch(spark, "t"))


def test_a_tree_of_least_bottlenecks_along_chains(spark):
    """Two chains of 300 pipes between far and root: one is longer but has no narrow pipe."""
    rows = [(f"a{i}", f"a{i + 1}", 1.0 + (i == 150)) for i in range(300)] + [(f"b{i}", f"b{i + 1}", 1.0) for i in range(310)]
    rows += [("far", "a0", 1.0), ("far", "b0", 1.0), ("a300", "root", 1.0), ("b310", "root", 1.0)]
    tree = {r["id"]: r for r in paths.greedy_in_tree(spark.createDataFrame(rows, "u string, v string, weight double"), "root", Scratch(spark, "t")).collect()}
    assert len(tree) == 301 + 311 + 2
    assert tree["far"]["parent"] == "b0" and tree["far"]["hops"] == 312 and tree["far"]["bottleneck"] == 1.0
    assert tree["a150"]["bottleneck"] == 2.0 and tree["a151"]["bottleneck"] == 1.0 and tree["root"]["parent"] is None


def test_shortest_paths_against_relaxation(spark):
    """A ring, a grid with ties, one-way chains, unreachable nodes, several sources."""
    import random

    rnd, rows = random.Random(1), []
    for i in range(30):
        rows += [(f"r{i:02}", f"r{(i + 1) % 30:02}", float(rnd.randrange(3)))] + ([(f"r{(i + 1) % 30:02}", f"r{i:02}", 1.0)] if i % 7 else [])
    for i in range(4):
        for j in range(4):
            rows += [(f"g{i}{j}", f"g{a}{b}", 1.0) for a, b in ((i + 1, j), (i, j + 1)) if a < 4 and b < 4]
    rows += [("g33", "r05", 0.5), ("r11", "s1", 2.0), ("r20", "s2", 1.0), ("g33", "r05", 3.0), ("lost", "lost2", 1.0)]
    best = {"s1": (0.0, 0, "", "s1"), "s2": (0.0, 0, "", "s2")}
    for _ in range(80):
        for u, v, w in rows:
            if v in best and (new := (best[v][0] + w, best[v][1] + 1, v)) < best.get(u, (1e9, 0, ""))[:3]:
                best[u] = (*new, best[v][3])
    want = {k: (d, p or None) for k, (d, _, p, _) in best.items()}
    edges = spark.createDataFrame(rows, "u string, v string, weight double")
    found = paths.shortest_paths(edges, spark.createDataFrame([("s1",), ("s2",)], "id string"), Scratch(spark, "t")).collect()
    assert {r["id"]: (r["dist"], r["parent"]) for r in found} == want
    up = {r["id"]: r["outfall"] for r in found}
    assert all(up[r["id"]] == (up[r["parent"]] if r["parent"] else r["id"]) for r in found)
    reached = paths.reach(edges, edges.select(F.lit("s1").alias("id")).limit(1), Scratch(spark, "t"))
    assert {r["id"] for r in reached.collect()} == {k for k in want if k != "s2"}


def test_a_small_negative_cycle_beside_a_large_weight(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", -1.000001), ("c", "d", -1e6)], "u string, v string, weight double")
    assert topology.negative_cycle(Network(None, e), Scratch(spark, "t"))
    assert not topology.negative_cycle(Network(None, e.where("u <> 'b'")), Scratch(spark, "t"))
