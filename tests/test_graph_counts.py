"""Betweenness and neighbourhoods against brute force, on both sides of their bounds."""

import random
from collections import deque

import pytest

from urbanflow.operators import paths
from urbanflow.scratch import Scratch


def by_hand(edges, sources):
    """Flow of each edge and through each node, from every source, path by path count."""
    edges = sorted({(u, v) for u, v in edges if u != v})
    nodes = sorted({x for e in edges for x in e})
    on, flow, through = {x: [v for u, v in edges if u == x] for x in nodes}, dict.fromkeys(edges, 0.0), dict.fromkeys(nodes, 0.0)
    for s in sources:
        if s not in on:
            continue
        hops, ways, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in on[x]:
                if y not in hops:
                    hops[y], ways[y] = hops[x] + 1, 0
                    queue.append(y)
                if hops[y] == hops[x] + 1:
                    ways[y] += ways[x]
        dep = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in order:
                if hops[x] + 1 == hops[y] and (x, y) in flow:
                    f = ways[x] / ways[y] * (1 + dep[y])
                    flow[x, y] += f
                    dep[x] += f
            if y != s:
                through[y] += dep[y]
    n, lift = len(nodes), len(nodes) / len(set(sources))
    return {e: f * lift / (n * (n - 1)) for e, f in flow.items()}, {x: f * lift / max(1, (n - 1) * (n - 2)) for x, f in through.items()}


def graph(seed):
    """A ring with chords, trees in, out and both ways on it, a part of two nodes, repeated edges and a loop."""
    rnd = random.Random(seed)
    rows = [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)] + [("r0", "r4"), ("r4", "r0"), ("r2", "r6"), ("r2", "r6"), ("r1", "r1")]
    for i in range(18):
        a, b = f"t{i}", rnd.choice([f"r{k}" for k in range(8)] + [f"t{k}" for k in range(i)])
        rows += [[(a, b)], [(b, a)], [(a, b), (b, a)]][rnd.randrange(3)]
    return rows + [("x", "y"), ("y", "x"), ("p", "q")]


@pytest.mark.parametrize("seed, state, least, some, of", [(1, 10**9, 0.05, False, "node"), (2, 60, 0.0, True, "node"), (2, 60, 0.0, True, "edge"), (3, 500, 2.0, False, "edge")])
def test_betweenness(spark, seed, state, least, some, of):
    """One batch and many, leaves folded to the end, for a while and not at all, all sources and some."""
    rows = graph(seed)
    ids = sorted({x for e in rows for x in e})
    sources = ids[::3] if some else ids
    want = by_hand(rows, sources)[of == "node"]
    e = spark.createDataFrame(rows, "u string, v string").coalesce(1)
    starts = spark.createDataFrame([(i,) for i in sources], "id string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = paths.betweenness(e, starts, Scratch(spark, "t"), of, state, least).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["id"] if of == "node" else (r["u"], r["v"]): r["value"] for r in got} == pytest.approx(want)


@pytest.mark.parametrize("heavy", [0, 3, 1_000])
def test_neighbourhoods(spark, heavy):
    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(0, 40, 2)] + [("hub", f"l{i}") for i in range(9)]
    near = {}
    for u, v in rows:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {}
    for i, m in near.items():
        inside = m | {i}
        out = [n for j in inside for n in near[j] - inside]
        want[i] = (sum(len(near[j] & inside) for j in inside) // 2, len(set(out)), len(out))
    got = paths.ego(spark.createDataFrame(rows, "u string, v string"), heavy).collect()
    assert {r["id"]: (r["ego_edges"], r["ego_neighbours"], r["ego_out"]) for r in got} == want
