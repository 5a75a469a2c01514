"""Queries against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from urbanflow.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"p1_components", "p2_reach", "p3_shortest_paths", "p4_levels", "p5_accumulate_general", "p7_greedy_in_tree", "p9_edge_betweenness", "p10_betweenness",
        "m14_kstest_betweenness", "o1_pair_rivers", "o5_identify_outfalls_withtopo", "o8_derive_topology_withtopo", "r7_regions", "m6_dominant_outfall"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(v) if math.isinf(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    at = [sql.columns.index(c) for c in cols]
    ours = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(str(tuple(plain(r[i]) for i in at)) for r in sql.fetchall())
    assert ours == theirs


def test_alignment_takes_all_nodes(spark):
    """On the larger tables, where most ids lie above 90."""
    from urbanflow.fixtures import with_views
    from urbanflow.queries import results

    sf, con = SF.replace("0.001", "0.01"), duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    total = "SELECT date, sum(value) AS {} FROM fx_results WHERE part = '{}' AND variable = 'click' AND id IN (SELECT id FROM fx_nodes) GROUP BY date"
    sql = f""", a AS ({total.format("s", "syn")}), b AS ({total.format("r", "real")}), j AS (SELECT date, s, r FROM a FULL JOIN b USING (date))"""
    sql += results._fill("j", "") + " SELECT count(*), sum(s), sum(r) FROM f WHERE r IS NOT NULL"
    n, syn, real = con.sql(with_views("fx_results", "fx_nodes") + sql).fetchall()[0]
    rows = QUERIES["t5_align_by_id"](spark, sf).toPandas()
    assert len(rows) == n
    assert math.isclose(rows["value_syn"].sum(), syn, rel_tol=1e-6) and math.isclose(rows["value_real"].sum(), real, rel_tol=1e-6)


def test_netsimile_of_whole_graphs(spark):
    """Against brute force over all driving and walking edges."""
    import numpy as np

    from urbanflow.fixtures import view

    def moments(rows):
        near = {}
        for r in rows:
            if r["u"] != r["v"]:
                near.setdefault(r["u"], set()).add(r["v"])
                near.setdefault(r["v"], set()).add(r["u"])
        own = {i: (len(m), sum(len(near[j] & m) for j in m) / 2) for i, m in near.items()}
        cl = {i: 2 * t / (d * (d - 1)) if d > 1 else 0.0 for i, (d, t) in own.items()}
        table = []
        for i, m in near.items():
            ego = m | {i}
            out = [n for j in ego for n in near[j] - ego]
            inside = sum(len(near[j] & ego) for j in ego) // 2
            table.append([len(m), cl[i], np.mean([len(near[j]) for j in m]), np.mean([cl[j] for j in m]), inside, len(set(out)), len(out)])
        x = np.array(table, float)
        z, sd = x - x.mean(0), x.std(0)
        by = np.where(sd > 0, sd, 1)
        return np.array([x.mean(0), np.median(x, 0), sd, (z**3).mean(0) / by**3, np.where(sd > 0, (z**4).mean(0) / by**4 - 3, 0)])

    e = view(spark, SF, "fx_edges").select("u", "v", "network_type").collect()
    a, b = (moments([r for r in e if r["network_type"] == t]) for t in ("drive", "walk"))
    size = np.abs(a) + np.abs(b)
    want = np.where(size < 1e-12, 1.0, np.abs(a - b) / np.maximum(size, 1e-12)).sum()
    assert math.isclose(QUERIES["c9_netsimile"](spark, SF).first()["value"], want, rel_tol=1e-6)
