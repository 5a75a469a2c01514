"""Terrain of more length than rounds: valleys, lakes behind lakes, straight streams."""

import heapq
import itertools
import random
import warnings

import pytest

from urbanflow.operators import raster
from urbanflow.scratch import Scratch


@pytest.fixture
def counted(monkeypatch):
    """How many tables were written."""
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, by=None: names.append(name) or table(self, df, name, by))
    return names


def flooded(z):
    near = lambda p: [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (p[0] + i, p[1] + j) in z]
    heap = [(h, p) for p, h in z.items() if len(near(p)) < 8]
    level = {p: h for h, p in heap}
    heapq.heapify(heap)
    while heap:
        h, p = heapq.heappop(heap)
        for q in near(p):
            if q not in level:
                level[q] = max(z[q], h)
                heapq.heappush(heap, (level[q], q))
    return level


def filled(spark, z):
    cells = spark.createDataFrame([(r, c, h) for (r, c), h in z.items()], "r int, c int, z double")
    return {(r["r"], r["c"]): r["z"] for r in raster.fill_pits(cells, Scratch(spark, "t")).collect()}


def test_lakes_behind_lakes(spark):
    """Rough ground, terraces of equal height, and a bowl whose pits only drain over one another."""
    rnd = random.Random(8)
    rough = {(r, c): float(rnd.randrange(6)) for r in range(14) for c in range(14)}
    bowl = {(r, 40 + c): float(max(abs(r - 8), abs(c - 8)) + rnd.randrange(4)) for r in range(17) for c in range(17)}
    assert filled(spark, rough | bowl) == flooded(rough | bowl)


def test_a_long_valley_takes_few_rounds(spark, counted):
    """A gutter of 2,000 cells with a dam at its end, and a pit in every tenth cell."""
    n = 2_000
    z = {(r, c): (10.0 * n if r != 1 else float(n - c) - 3.0 * (c % 10 == 5)) for r in range(3) for c in range(n)}
    z[1, n - 1] = z[1, 0] = 700.5
    assert filled(spark, z) == flooded(z)
    assert len(counted) < 90


def strahler(to):
    kids = {}
    for a, b in to.items():
        kids.setdefault(b, []).append(a)
    out = {}
    for p in sorted(to, key=lambda p: -sum(1 for _ in itertools.takewhile(lambda q: q is not None, _walk(to, p)))):
        orders = [out[k] for k in kids.get(p, [])]
        top = max(orders, default=1)
        out[p] = top + (orders.count(top) > 1)
    return out


def _walk(to, p):
    while p in to:
        yield p
        p = to[p]


def test_stream_order(spark, counted):
    """A random tree of streams, and a straight one of 2,000 cells."""
    rnd = random.Random(9)
    to = {(r, c): (r + 1, min(7, max(0, c + rnd.choice((-1, 0, 1))))) for r in range(12) for c in range(8)} | {(12, c): None for c in range(8)}
    rows = [(*p, *(q or (None, None))) for p, q in to.items()]
    ddl = "r int, c int, to_r int, to_c int"
    got = {(r["r"], r["c"]): r["strahler"] for r in raster.stream_order(spark.createDataFrame(rows, ddl), Scratch(spark, "t")).collect()}
    assert got == strahler(to) and max(got.values()) > 2
    counted.clear()
    line = [(0, c, *((0, c + 1) if c < 1_999 else (None, None))) for c in range(2_000)] + [(1, 1_990, 0, 1_991)]
    got = {(r["r"], r["c"]): r["strahler"] for r in raster.stream_order(spark.createDataFrame(line, ddl), Scratch(spark, "t")).collect()}
    assert all(got[0, c] == 1 + (c > 1_990) for c in range(2_000)) and got[1, 1_990] == 1
    assert len(counted) < 30
    with pytest.raises(ValueError, match="circle"):
        raster.stream_order(spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0)], ddl), Scratch(spark, "t")).collect()


def test_subbasins_warn_where_no_stream_is_high_enough(spark):
    flow = spark.createDataFrame([(0, 0, 0, 1), (0, 1, None, None)], "r int, c int, to_r int, to_c int")
    with pytest.warns(UserWarning, match="order 3"):
        assert {r["basin"] for r in raster.subbasins(flow, 3, Scratch(spark, "t")).collect()} == {"0_1"}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        raster.subbasins(flow, 1, Scratch(spark, "t")).collect()
