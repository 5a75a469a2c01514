"""Steps whose shuffles, tasks or driver grew faster than their input."""

import math
import random
import re

import pytest

from tests.test_sent import plan
from urbanflow.model import Network
from urbanflow.operators import distance, network, paths
from urbanflow.scratch import Scratch


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_edges_are_not_shuffled(spark, unbroadcast):
    """A pair's weight is reduced where its edges meet, so no exchange is keyed by the head of the second edge."""
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 1.0), ("d", 2.0, 0.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("b", "a", 0), ("c", "d", 0)], "u string, v string, key int")
    out = network.set_chahinian_angle(Network(nodes, edges)).edges
    assert "hashpartitioning(w" not in plan(out)
    assert {(r.u, r.v): round(r.chahinian_angle, 9) for r in out.collect()} == {("a", "b"): 0.2, ("b", "c"): 0.6, ("b", "a"): 0.0, ("c", "d"): 0.0}


def test_lists_are_shuffled_instead_of_cells(spark, unbroadcast):
    """A product's cells are unpacked behind the last exchange, and a graph's triangles need no row a wedge."""
    coo = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if i != j], "i long, j long, w double")
    out = distance.deltacon0(coo, coo.where("i < j"), 6)
    assert "hashpartitioning(i#" in plan(out) and not re.search(r"hashpartitioning\(i#\d+L?, j#\d+L?", plan(out).split("Generate")[0])
    assert out.first()["value"] > 0
    e = spark.createDataFrame([(str(i), str(j)) for i in range(7) for j in range(i)] + [("6", "x")], "u string, v string")
    out = paths.clustering(e)
    assert "array_intersect" in plan(out)
    assert {r.id: r.triangles for r in out.collect()} == {**{str(i): 15 for i in range(7)}, "x": 0}


@pytest.mark.parametrize("heavy", [1, 3, 1_000])
def test_ego_networks_on_both_sides_of_heavy(spark, heavy):
    rnd = random.Random(5)
    pairs = {(a, b) for a in range(14) for b in range(a) if rnd.random() < 0.2 or (b == 0 and a % 2)}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in {n for p in pairs for n in p}}
    want = {}
    for x, own in near.items():
        inside = own | {x}
        out = [(m, n) for m in own for n in near[m] - inside]
        want[str(x)] = (sum(1 for a, b in pairs if a in inside and b in inside), len({n for _, n in out}), len(out))
    got = paths.ego(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "u string, v string"), heavy)
    assert {r.id: (r.ego_edges, r.ego_neighbours, r.ego_out) for r in got.collect()} == want


def test_merged_tables_are_never_broadcast(spark):
    """Joins with what a graph job wrote are merged, however small its file; edges between two parts are carried on once."""
    scratch = Scratch(spark, "t")
    rows = [(str(k), str(k // 2), 0, float(k % 3)) for k in range(2, 20)] + [("5", "9", 0, 0.5), ("9", "5", 1, 0.5)]
    e = spark.createDataFrame(rows, "u string, v string, key int, length double")
    small = scratch.merged().table(e, "e")
    assert "Broadcast" not in plan(small.join(small.select("u", "key"), "u"))
    tree = {(r.u, r.v, r.key) for r in paths.min_spanning_forest(e, scratch).collect()}
    assert len(tree) == 18 and ("5", "9", 0) in tree and ("9", "5", 1) not in tree and ("5", "2", 0) not in tree


def test_spanning_forest_of_a_chain_writes_few_tables(spark):
    n = 300
    rows = [(f"{i:03}", f"{i + 1:03}", 0, float(i)) for i in range(n)] + [("000", f"{n:03}", 0, 1e9)]
    scratch = Scratch(spark, "t")
    tree = paths.min_spanning_forest(spark.createDataFrame(rows, "u string, v string, key int, length double"), scratch)
    assert {(r.u, r.v, r.key) for r in tree.collect()} == {r[:3] for r in rows[:n]}
    assert len(set(scratch.places.values())) <= 14  # ways double; with star steps it wrote 16


def test_pieces_on_shared_lines_count_once(spark):
    """Pieces are equal at six decimals, along every line and both ways; other segments are cut without a shuffle."""
    rnd, third = random.Random(3), 1 / 3
    rows, want = [], {}
    for key in range(400):
        step, k, n = rnd.choice([(1, 0), (-1, 0), (0, 1), (1, 2), (-3, 1), (-2, -1)]), rnd.randrange(6), rnd.randrange(1, 6)
        size = math.hypot(*step)
        a, b = (tuple(third + 10.0 * c / size * at for c in step) for at in (k, k + n))
        rows.append(("u", "v", key, [a, b]))
        for i in range(n):
            ends = [tuple(round(p + (q - p) * j / n, 6) + 0.0 for p, q in zip(a, b)) for j in (i, i + 1)]
            want[tuple(ends)] = key
    for key in range(400, 420):  # shorter than half a piece
        a = (rnd.randrange(3) / 7, rnd.randrange(3) / 7)
        b = (a[0] + 1.0, a[1])
        rows.append(("u", "v", key, [a, b]))
        want[tuple(tuple(round(c, 6) for c in p) for p in (a, b))] = key
    e = spark.createDataFrame(rows, "u string, v string, key int, geometry array<struct<x:double,y:double>>")
    got = network.split_long_edges(Network(None, e), 10.0 + 1e-9).edges.collect()
    assert sorted(tuple((p.x, p.y) for p in r.geometry) for r in got) == sorted(want)
    assert all(r.key == 0 and 0 < r.length <= 10.00001 for r in got)
    assert len({(r.u, r.v) for r in got}) == len(want)
