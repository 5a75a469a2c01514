"""Hard negatives and threshold joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanflow.llm import hardnegatives
from urbanflow.llm.common import Scratch

DDL = "vec_id long, label int, vector array<double>, score int, key string, home int"


def plain(rows, anchors, positives=5, negatives=5, low=80, high=100):
    sound = {(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, c, q in {r for r in sound if r[0] in anchors}:
        score = [(-int(np.dot(q, v)), i, l) for i, l, v in sound if i != a and len(v) == len(q)]
        for s, p, _ in sorted(x for x in score if x[2] == c)[:positives]:
            own = sorted((t, i) for t, i, l in score if l != c and low * -s <= high * -t <= high * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(own)]
    return sorted(out)


def found(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == cols
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, c, v, 1, "x", 2) for i, c, v in rows], DDL)


def test_clusters_copies_and_odd_rows(spark):
    """A hot group of copies and near copies, ties, ids that repeat, other lengths, nulls, zeros."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12)) * 60
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.floor(centres[i % 4] + rng.normal(size=12) * 30)]) for i in range(240)]
    hot = [float(x) for x in np.floor(centres[0])]
    rows += [(300 + i, i % 3, hot) for i in range(120)] + [(500 + i, i % 2, [*hot[:-1], hot[-1] + i % 4]) for i in range(80)]
    rows += [(600, None, hot), (601, 1, None), (602, 1, [None, *hot[1:]]), (603, 1, [float("nan"), *hot[1:]]), (604, 1, [float("inf"), *hot[1:]]), (None, 1, hot)]
    rows += [(605, 1, [0.0] * 12), (606, 2, [0.0] * 12), (610, 1, [3.0, 4.0]), (611, 2, [3.0, 4.0]), (612, 1, [3.0, 4.0]), (620, 1, []), (621, 1, []), (622, 0, [])]
    rows += [rows[0], rows[7], (305, 1, hot), (0, 2, hot), (630, 0, [-x for x in hot])]
    anchors = {0, 7, 20, 40, 41, 300, 305, 501, 600, 601, 605, 610, 620, 630}
    df = frame(spark, rows)
    asked = df.where(F.col("vec_id").isin(*anchors))
    want = plain(rows, anchors)
    assert len(want) > 100
    assert found(hardnegatives.mine(df, asked, Scratch(spark, "t"))) == want
    assert found(hardnegatives.mine(df, asked, Scratch(spark, "t"), shard_rows=40, block_rows=3, shares=(0.1, 0.2, 0.7, 1.0))) == want
    assert found(hardnegatives.mine(df, asked, Scratch(spark, "t"), positives=2, negatives=9, low=30, high=70, shares=(1.0,))) == plain(rows, anchors, 2, 9, 30, 70)


def test_no_rows_and_no_positives(spark):
    one = frame(spark, [(0, 1, [1.0, 2.0]), (1, 2, [1.0, 2.0])])
    assert found(hardnegatives.mine(one, one, Scratch(spark, "t"))) == []
    assert found(hardnegatives.mine(one.where("false"), one, Scratch(spark, "t"))) == []
    assert found(hardnegatives.mine(one, one.where("false"), Scratch(spark, "t"))) == []


@pytest.mark.parametrize("scale", [3.0, 300.0, 3e6, 2e8])
def test_threshold_join(scale):
    """All pairs at or above each query's threshold, in single, double and unbounded precision."""
    rng = np.random.default_rng(6)
    weight = rng.random(37) ** 3
    x, q = (np.floor(rng.normal(size=(n, 37)) * weight * scale) for n in (400, 150))
    exact = q.astype(np.int64).astype(object) @ x.T.astype(np.int64).astype(object)
    for level in (-1e30, 0.0, 0.3, 0.8, 2.0):
        least = np.floor(level * np.sort(exact.astype(float), 1)[:, -20]) if level >= 0 else np.full(150, level)
        least[:10] = -np.inf
        got = {(int(a), int(b)): int(s) for own in hardnegatives.Index(x).pairs(q, least, 16) for a, b, s in zip(*own)}
        assert got == {(a, b): exact[a, b] for a, b in np.ndindex(exact.shape) if float(exact[a, b]) >= least[a]}


def test_quantised(spark):
    row = spark.createDataFrame([([0.5, -0.001, 0.99609375, None],)], "e array<float>").select(hardnegatives.quantised(F.col("e")).alias("q")).first()
    assert row["q"] == [128.0, -1.0, 255.0, None]


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    """Shards, anchors and scores are merged, however few bytes they take on disk; only the number of shards is broadcast."""
    plans, write = {}, Scratch.table

    def table(self, df, name, by=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, by)

    monkeypatch.setattr(Scratch, "table", table)
    rng = np.random.default_rng(3)
    df = frame(spark, [(i, i % 3, [float(x) for x in rng.integers(-50, 50, 6)]) for i in range(60)])
    plans["last"] = hardnegatives.mine(df, df.where("vec_id < 6"), Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert {n for n, p in plans.items() if "BroadcastHashJoin" in p} == {"indexes", "anchors"} and {"near", "far", "positives", "last"} <= set(plans)
