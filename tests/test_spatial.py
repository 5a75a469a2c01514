"""Spatial joins on uneven density against brute force: nine tenths of the points lie in one tile."""

import math

import numpy as np
import pytest

from urbanflow.operators import spatial
from urbanflow.scratch import Scratch

POLY = "sub_id long, ring array<struct<x:double,y:double>>"


def crowd(n, seed, spread=1000.0):
    """Nine tenths within a thousandth of the side, the rest all over."""
    rng = np.random.default_rng(seed)
    return [(i, *(float(v) for v in rng.uniform(0, spread / 1000 if i % 10 else spread, 2))) for i in range(n)]


def box(i, x, y, w):
    return i, [(float(p), float(q)) for p, q in ((x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y))]


def test_points_in_polygons_where_both_crowd(spark):
    pts = crowd(1000, 1) + [(2000, 0.5, 0.5), (2001, 0.5, 0.5), (2002, None, 0.5), (2003, 5000.0, -3.0)]
    polys = [box(i, 0.05 * (i % 20), 0.05 * (i // 20), 0.05) for i in range(400)] + [box(500, 0, 0, 700), box(501, -10, -10, 20)]
    polys += [box(501, -10, -10, 20), (502, []), (503, None)]
    nodes, subs = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(polys, POLY)
    inside = lambda p, q: q[1] and p[1] is not None and q[1][0][0] < p[1] < q[1][2][0] and q[1][0][1] < p[2] < q[1][2][1]
    want = sorted((p[0], q[0]) for p in pts for q in polys if inside(p, q))
    got = spatial.nodes_to_subs(nodes, subs, 250.0, full=32)
    assert got.columns == ["id", "x", "y", "sub_id"]
    assert sorted((r["id"], r["sub_id"]) for r in got.collect()) == want
    left = spatial.nodes_to_subs(nodes, subs, 250.0, how="left", full=32).collect()
    lone = {p[0] for p in pts} - {w[0] for w in want}
    assert sorted((r["id"], r["sub_id"]) for r in left if r["sub_id"] is not None) == want
    assert {r["id"] for r in left if r["sub_id"] is None} == lone and {2002, 2003} <= lone
    assert spatial.nodes_to_subs(nodes.limit(0), subs, 250.0).count() == 0
    assert spatial.nodes_to_subs(nodes, subs.limit(0), 250.0, how="left").count() == len(pts)


def test_no_tile_far_above_its_share(spark):
    pts = spark.createDataFrame(crowd(4000, 2), "id long, x double, y double")
    parted = spatial.splits(pts, 250.0, Scratch(spark, "t"), 100)
    assert parted and spatial.splits(pts, 250.0, Scratch(spark, "t"), 4000) == []
    tiles = spatial.place_points(pts, 250.0, parted).groupBy("_level", "_bx", "_by").count().toPandas()["count"]
    assert tiles.sum() == 4000 and tiles.max() <= 100


@pytest.mark.parametrize("full", [16, 10**6])
def test_nearest_and_pairs(spark, full):
    a, b = crowd(400, 3), crowd(300, 4) + [(900, 0.25, 0.25), (901, 0.25, 0.25)]
    r = 90.0
    fa, fb = (spark.createDataFrame(p, "id long, x double, y double") for p in (a, b))
    want = {}
    for i, x, y in a:
        d, near = min((math.hypot(x - p, y - q), j) for j, p, q in b)
        if d <= r:
            want[i] = near
    got = spatial.nearest_within(fa, fb, r, full).collect()
    assert {g["id"]: g["near"] for g in got} == want and len(got) == len(want)
    near = 0.2
    pairs = sorted((i, j) for i, x, y in b for j, p, q in b if i < j and math.hypot(x - p, y - q) <= near)
    assert sorted((g["id_a"], g["id_b"]) for g in spatial.pairs_within(fb, near, full).collect()) == pairs
