"""Golden values and invariants on small frames."""

import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from urbanflow.functions import geometry as g
from urbanflow.model import HydraulicDesign, Network
from urbanflow.operators import design, metrics, network, paths, raster, sections, series
from urbanflow.operators.components import components
from urbanflow.scratch import Scratch


def test_utm(spark):
    row = spark.range(1).select(g.to_utm(F.lit(-0.1276), F.lit(51.5074), F.lit(30), F.lit(False)).alias("p"), g.utm_epsg(F.lit(-1.0), F.lit(-51.0)).alias("e")).first()
    assert math.isclose(row["p"]["x"], 699330.110690, abs_tol=1e-4)
    assert math.isclose(row["p"]["y"], 5710164.303007, abs_tol=1e-4)
    assert row["e"] == "EPSG:32730"


def test_angles(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    row = spark.range(1).select(g.angle_deg(p(1, 0), p(0, 0), p(0, 1)).alias("a"), g.angle_deg(p(1, 0), p(0, 0), p(-1, 0)).alias("b"), g.angle_deg(p(0, 0), p(0, 0), p(1, 0)).alias("c")).first()
    assert (round(row["a"], 9), round(row["b"], 9), row["c"]) == (90.0, 180.0, math.inf)


def test_bilinear(spark):
    cells = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0), (1, 0, 1.0), (1, 1, 2.0)], "r int, c int, z double")
    nodes = spark.createDataFrame([("a", 0.25, 0.25), ("b", 0.75, 0.25)], "id string, x double, y double")
    from urbanflow.model import GridSpec

    z = raster.set_elevation(nodes, cells, GridSpec(0, 0, 0.5, 0.5, 2, 2))
    assert {r["id"]: r["surface_elevation"] for r in z.collect()} == {"a": 2.75, "b": 3.25}


def test_components_and_forest(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "u long, v long")
    got = {r["id"]: r["component"] for r in components(e, Scratch(spark, "t")).collect()}
    assert got == {i: i - i % 20 for i in range(60)}
    s = spark.createDataFrame([("a", "b", 0, 1.0), ("b", "c", 0, 2.0), ("a", "c", 0, 3.0), ("d", "e", 0, 1.0)], "u string, v string, key int, length double")
    tree = paths.min_spanning_forest(s, Scratch(spark, "t"))
    assert {(r["u"], r["v"]) for r in tree.collect()} == {("a", "b"), ("b", "c"), ("d", "e")}


def test_shortest_paths_small(spark):
    e = spark.createDataFrame([("1", "2", 1.0), ("2", "3", 1.0), ("1", "3", 5.0), ("4", "5", 1.0)], "u string, v string, weight double")
    src = spark.createDataFrame([("3",)], "id string")
    got = {r["id"]: (r["dist"], r["parent"], r["outfall"]) for r in paths.shortest_paths(e, src, Scratch(spark, "t")).collect()}
    assert got == {"3": (0.0, None, "3"), "2": (1.0, "3", "3"), "1": (2.0, "2", "3")}
    with pytest.raises(ValueError):
        paths.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "u string, v string"), Scratch(spark, "t")).collect()


def test_filter_streets(spark):
    edges = spark.createDataFrame([("1", "2", 0, "street"), ("2", "3", 0, "street"), ("3", "4", 0, "outfall"), ("4", "5", 0, "river")], "u string, v string, key int, edge_type string")
    nodes = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    net = network.filter_streets(Network(nodes, edges))
    assert {r["id"] for r in net.nodes.collect()} == {"1", "2", "3"}
    assert net.edges.count() == 2


def test_interpolation_is_positional(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (9, 3.0), (10, None)], "t int, v double").withColumn("g", F.lit(0))
    assert [r["v"] for r in series.interpolate_by(df, ["g"], "t", "v").orderBy("t").collect()] == [1.0, 2.0, 3.0, 3.0]


def test_coefficients(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "value_real double, value_syn double")
    one = {n: metrics.coef_of(df, c).first()["value"] for n, c in metrics.COEFFICIENTS.items()}
    assert {k: round(v, 9) for k, v in one.items()} == {"relerror": 0.0, "nse": 1.0, "kge": 1.0}
    flat = df.withColumn("value_real", F.lit(2.0))
    assert metrics.coef_of(flat, metrics.nse).first()["value"] == math.inf
    for bad in ("grid_nse", "grid_nse_length", "city_nse_flow"):
        with pytest.raises(ValueError):
            metrics.metric_factory(bad)


def test_fill_pits(spark):
    cells = spark.createDataFrame([(r, c, 1.0 if (r, c) == (2, 2) else 5.0 if 0 < r < 4 and 0 < c < 4 else 7.0 if (r, c) != (0, 2) else 4.0) for r in range(5) for c in range(5)], "r int, c int, z double")
    z = {(r["r"], r["c"]): r["z"] for r in raster.fill_pits(cells, Scratch(spark, "t")).collect()}
    assert z[2, 2] == 5.0 and z[0, 2] == 4.0 and z[1, 1] == 5.0


def test_pipe_by_pipe(spark):
    nodes = spark.createDataFrame([("a", 10.0, 100.0), ("b", 9.0, 100.0), ("c", 8.0, 0.0)], "id string, surface_elevation double, contributing_area double")
    edges = spark.createDataFrame([("a", "b", 0, 50.0), ("b", "c", 0, 50.0)], "u string, v string, key int, length double")
    net = design.pipe_by_pipe(Network(nodes, edges), HydraulicDesign(), Scratch(spark, "t"))
    assert net.edges.where("diameter > 0 and cost_usd > 0").count() == 2
    assert net.nodes.where("chamber_floor_elevation < surface_elevation").count() == 3


def test_pipeline_contract(spark):
    net = Network(spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("1", "2", 0)], "u string, v string, key int"))

    @sections.requires(edges=("length",))
    def needs_length(n, **_):
        return n

    with pytest.raises(ValueError, match="length"):
        sections.run_pipeline(net, [needs_length])


def test_entry_imports_without_llm(tmp_path):
    """In a copy without the folders, but for a leftover cache."""
    repo = Path(__file__).parent.parent
    shutil.copytree(repo / "urbanflow", tmp_path / "urbanflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    (tmp_path / "urbanflow/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'grid_nse_flooding' in q and set(e.oracle_sql()) <= set(q); print(*q)"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""}).stdout.split()
    assert len(names) > 100 and not [n for n in names if re.match(r"op\d+_|pipeline", n)]


def test_betweenness_of_a_long_chain(spark):
    n = 103
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long").coalesce(1)
    first = spark.createDataFrame([(0,)], "id long").coalesce(1)
    try:
        got = {r["u"]: r["value"] for r in paths.betweenness(e, first, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # from the start, edge u lies on the paths to all nodes after it; one source stands for all n
    assert all(math.isclose(got[u], (n - 1 - u) * n / (n * (n - 1))) for u in range(n - 1))
