"""Long lines are cut, or their parts counted, by plain expressions."""

import pytest
from pyspark.sql import functions as F

from urbanflow.functions.geometry import segmentize, segmentized_size
from urbanflow.model import Network
from urbanflow.operators.network import split_long_edges


def test_vertices_are_counted_without_making_them(spark):
    lines = [[(0.0, 0.0), (130.0, 0.0), (130.0, 59.0)], [(0.0, 0.0), (0.0, 0.0)], [(5.0, 5.0)], [], [(0.0, 0.0), (60.0, 0.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(line,) for line in [*lines, None]], "line array<struct<x:double,y:double>>")
    rows = df.select(segmentized_size(F.col("line"), 60.0).alias("n"), F.size(segmentize(F.col("line"), 60.0)).alias("made"), "line").collect()
    assert all(r["n"] == r["made"] for r in rows if r["line"] is not None) and [r["n"] for r in rows][:5] == [5, 2, 1, 0, 3]
    far = spark.createDataFrame([([(0.0, 0.0), (6e10, 0.0)],)], df.schema)  # a billion parts
    assert far.select(segmentized_size(F.col("line"), 60.0)).first()[0] == 1_000_000_001


def test_pieces_are_cut_by_generated_code(spark):
    line = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([("a", "b", 0, [(0.0, 0.0), (100.0, 0.0)]), ("b", "c", 0, [(100.0, 0.0), (100.0, 30.0), (7.0, 1.0)])], f"u string, v string, key int, geometry {line}")
    got = split_long_edges(Network(edges.select(F.col("u").alias("id")), edges), 40.0).edges
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((round(r["geometry"][0]["x"], 3), round(r["geometry"][1]["x"], 3), r["length"]) for r in got.collect())
    assert [r[:2] for r in rows] == [(0.0, 33.333), (33.333, 66.667), (38.0, 7.0), (66.667, 100.0), (69.0, 38.0), (100.0, 69.0), (100.0, 100.0)]
    assert sum(r[2] for r in rows) == pytest.approx(130 + (93**2 + 29**2) ** 0.5, abs=1e-5)
