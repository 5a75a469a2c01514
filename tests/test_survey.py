"""Operators against brute force, and readers, sections and pipelines on small inputs."""

import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from urbanflow.model import GridSpec, HydraulicDesign, Network
from urbanflow.operators import metrics, paths, raster, sections, topology
from urbanflow.scratch import Scratch
from urbanflow.sources import io


def test_accumulate_over_a_long_path(spark):
    """A path of 300 nodes with a short cut and a cycle at its end: each ancestor counts once."""
    edges = [(str(i), str(i + 1)) for i in range(299)] + [("0", "200"), ("299", "298")]
    e = spark.createDataFrame(edges, "u string, v string")
    values = spark.createDataFrame([(str(i), 1.0) for i in range(300)], "id string, value double")
    got = {int(r["id"]): r["total"] for r in paths.accumulate(e, values, Scratch(spark, "t")).collect()}
    assert got == {i: float(i + 1 if i < 298 else 300) for i in range(300)}


def test_spanning_forest_against_kruskal(spark):
    import random

    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", 0, float(rnd.randrange(9))) for _ in range(120)]
    edges = list({(u, v): (u, v, k, w) for u, v, k, w in edges if u != v}.values())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = set()
    for w, u, v, k in sorted((w, u, v, k) for u, v, k, w in edges):
        if find(u) != find(v):
            root[find(u)] = find(v)
            want.add((u, v, k))
    tree = paths.min_spanning_forest(spark.createDataFrame(edges, "u string, v string, key int, length double"), Scratch(spark, "t"))
    assert {(r["u"], r["v"], r["key"]) for r in tree.collect()} == want


def test_communities_of_cliques(spark):
    """Cliques in a ring: one community each, at a modularity no lower than that of the cliques."""
    edges = [(f"{c}-{i}", f"{c}-{j}", 1.0) for c in range(4) for i in range(5) for j in range(i)]
    edges += [(f"{c}-0", f"{(c + 1) % 4}-1", 1.0) for c in range(4)]
    e = spark.createDataFrame(edges, "u string, v string, length double")
    label = paths.communities(e, Scratch(spark, "t"))
    by = {}
    for r in label.collect():
        by.setdefault(r["community"], set()).add(r["id"].split("-")[0])
    assert sorted(map(sorted, by.values())) == [["0"], ["1"], ["2"], ["3"]]
    assert paths.modularity(e, label).first()["value"] > 0.6


def test_communities_of_planted_groups(spark):
    """Four groups that hardly stand out: moves that spoil each other must not end a level short of them."""
    draw = random.Random(1)
    edges = [(f"{i:02d}", f"{j:02d}", 1.0) for i in range(40) for j in range(i) if draw.random() < (0.6 if i % 4 == j % 4 else 0.1)]
    e = spark.createDataFrame(edges, "u string, v string, length double")
    label = Scratch(spark, "t").table(paths.communities(e, Scratch(spark, "t")), "label")
    assert label.count() == 40 and paths.modularity(e, label).first()["value"] > 0.34  # that of the groups is 0.358


def test_negative_cycles(spark):
    def net(*edges):
        return Network(None, spark.createDataFrame(edges, "u string, v string, weight double"))

    assert not topology.negative_cycle(net(("a", "b", 1.0), ("b", "a", 0.0)), Scratch(spark, "t"))
    assert not topology.negative_cycle(net(("a", "b", -3.0), ("b", "c", -2.0), ("c", "a", 5.0)), Scratch(spark, "t"))
    assert topology.negative_cycle(net(("a", "b", -3.0), ("b", "c", 1.0), ("c", "a", 1.5)), Scratch(spark, "t"))


def test_elevation_by_rings(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, 6.0), (1, 0, 7.0), (1, 1, 8.0), (30, 40, 9.0)], "r int, c int, z double")
    spec = GridSpec(0, 0, 1.0, 1.0, 50, 50)
    nodes = spark.createDataFrame([("in", 0.5, 0.5), ("far", 25.0, 30.0), ("near", 3.0, 0.5)], "id string, x double, y double")
    got = {r["id"]: r["surface_elevation"] for r in raster.set_elevation(nodes, cells, spec, Scratch(spark, "t")).collect()}
    fx = 0.5 * 49 / 50
    assert math.isclose(got["in"], 5 + fx + 2 * fx, rel_tol=1e-9) and got["near"] == 6.0
    points = {(0, 0): 5.0, (0, 1): 6.0, (1, 0): 7.0, (1, 1): 8.0, (30, 40): 9.0}
    want = min(points, key=lambda p: math.hypot(p[0] - 30 * 49 / 50, p[1] - 25 * 49 / 50))
    assert got["far"] == points[want]
    empty = raster.set_elevation(nodes, cells.where("false"), spec, Scratch(spark, "t")).collect()
    assert len(empty) == 3 and all(r["surface_elevation"] is None for r in empty)


def test_fill_pits_against_a_queue(spark):
    import random

    rnd, n = random.Random(5), 9
    z = {(r, c): float(rnd.randrange(20)) for r in range(n) for c in range(n) if rnd.random() > 0.05}
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
    cells = spark.createDataFrame([(r, c, h) for (r, c), h in z.items()], "r int, c int, z double")
    assert {(r["r"], r["c"]): r["z"] for r in raster.fill_pits(cells, Scratch(spark, "t")).collect()} == level


def test_attach_parts_takes_every_cell(spark):
    """A loose cell far from its own main part goes to the nearest kept cell; none is left out."""
    parts = [("a", 0, c) for c in range(4)] + [("b", 50, 50 + c) for c in range(3)] + [("a", 47, 50), ("b", 2, 2)]
    got = raster.attach_parts(spark.createDataFrame(parts, "id string, r int, c int"), Scratch(spark, "t")).collect()
    assert len(got) == len(parts) and {(r["r"], r["c"]): r["id"] for r in got}[47, 50] == "b" and {(r["r"], r["c"]): r["id"] for r in got}[2, 2] == "a"


def test_node_link_graph(spark, tmp_path):
    graph = {
        "graph": {"crs": "EPSG:32630"},
        "nodes": [{"id": 1, "x": 0.0, "y": 0.0}, {"id": 2, "x": 3.0, "y": 4.0}],
        "links": [{"source": 1, "target": 2, "key": 0, "geometry": "LINESTRING (0 0, 1 1, 3 4)"}, {"source": 2, "target": 1, "key": 0, "geometry": None}],
    }
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    net = io.load_network(spark, str(tmp_path / "graph.json"))
    lines = {(r["u"], r["v"]): [(p["x"], p["y"]) for p in r["geometry"]] for r in net.edges.collect()}
    assert net.crs == "EPSG:32630" and lines == {("1", "2"): [(0, 0), (1, 1), (3, 4)], ("2", "1"): [(3, 4), (0, 0)]}
    with pytest.raises(ValueError):
        io.read_table(spark, "table.xyz")


def test_feature_collection_and_lines(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"id": "a"}}
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    (tmp_path / "lines.geojson").write_text("\n".join([json.dumps(feature)] * 3))
    assert io.read_table(spark, str(tmp_path / "one.geojson")).count() == 2
    assert io.read_table(spark, str(tmp_path / "lines.geojson")).select("id").first()["id"] == "a"


def test_bbox_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "boxes.parquet")
    spark.range(10).select(F.struct(*((F.col("id") + k).cast("double").alias(c) for k, c in enumerate(("xmin", "ymin", "xmax", "ymax")))).alias("bbox")).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = io.scan_bbox(spark.read.parquet(path), 1.0, 2.0, 4.0, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(bbox.xmin,4.0)" in plan


def test_boxes_by_place_skip_row_groups(spark, tmp_path):
    """A hundredth of the area: few of the row groups overlap it, and the scan reads no others."""
    import pyarrow.parquet as pq

    side = 300
    boxes = spark.range(side * side).select("id", ((F.col("id") * 7919) % (side * side)).alias("k"))
    x, y = (F.col("k") % side).cast("double"), F.floor(F.col("k") / side).cast("double")
    boxes = boxes.select("id", F.struct(x.alias("xmin"), y.alias("ymin"), (x + 1).alias("xmax"), (y + 1).alias("ymax")).alias("bbox"))
    boxes = boxes.union(spark.range(1).select(F.lit(-1).alias("id"), F.lit(None).cast(boxes.schema["bbox"].dataType).alias("bbox")))
    path = str(tmp_path / "boxes.parquet")
    io.write_by_place(boxes, path, files=8, row_group=64 * 1024)
    box = (100.5, 200.5, 129.5, 229.5)
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in sorted((tmp_path / "boxes.parquet").glob("*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    stats = [{g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)} for g in groups]
    hit = [g.num_rows for g, s in zip(groups, stats) if s["bbox.xmin"].min < box[2] and s["bbox.xmax"].max > box[0] and s["bbox.ymin"].min < box[3] and s["bbox.ymax"].max > box[1]]
    assert len(groups) >= 16 and len(hit) <= len(groups) / 4
    found = io.scan_bbox(spark.read.parquet(path), *box)
    rows = found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert len(rows) == 30 * 30 and scan.metrics().apply("numOutputRows").value() <= sum(hit)
    assert spark.read.parquet(path).where("bbox IS NULL").count() == 1


def test_pipelines_check_and_stop(spark):
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")
    net = Network(nodes, spark.createDataFrame([("1", "2", 0, "street")], "u string, v string, key int, edge_type string"))
    seen = []

    def drop_all(n, **_):
        seen.append("drop")
        return n.with_(edges=n.edges.where("false"))

    @sections.requires(edges=("weight",))
    def needs_weight(n, **_):
        seen.append("weight")
        return n

    assert sections.run_pipeline(net, [drop_all, drop_all]).edges.count() == 0 and seen == ["drop"]
    with pytest.raises(ValueError, match="weight"):
        sections.run_pipeline(net, [needs_weight])
    with pytest.raises(ValueError):
        metrics.metric_factory("outfall_nse_length")
    assert set(sections.SECTIONS) >= {"JUNCTIONS", "VERTICES", "RAINGAGES"}


def test_designs_inside_the_row(spark):
    """The same choice as from all designs as rows: falls, rises, ties, no cost, no flow."""
    from urbanflow.operators import design

    rows = [(str(i), float(10 + i % 7), float(9 + i % 5 - (i == 30) * 80), float(5 + i % 90), 0.001 * (i % 13)) for i in range(60)] + [("null", None, 1.0, 2.0, 0.1)]
    pipes = spark.createDataFrame(rows, "u string, ds_elevation double, floor double, length double, q double")
    params = HydraulicDesign()
    plain = design.select_design(design.evaluate_design(pipes.crossJoin(F.broadcast(design.design_grid(spark, params))), params), ["u"])
    want = {r["u"]: tuple(r) for r in plain.collect()}
    chosen = design.choose_design(pipes, params, ["u"])
    assert chosen.columns == plain.columns
    assert {r["u"]: tuple(r) for r in chosen.collect()} == want and len(want) > 50
    assert "Exchange" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_outfall_flow_counts_pipes_into_ends_that_are_no_nodes(spark):
    """A pipe whose lower end no edge leaves drains the network, though that end isn't among its nodes."""
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = lambda rows: spark.createDataFrame(rows, "u string, v string, id string")
    syn = Network(nodes, edges([("a", "b", "a"), ("c", "gone", "c"), ("d", "c", "d")]))
    real = Network(nodes.where("id in ('a', 'b')"), edges([("a", "b", "a")]))
    rows = [(i, "flow", f"2024-01-01 0{h}:00:00", float(v + h)) for i, v in (("a", 1), ("c", 2), ("d", 50)) for h in (0, 1)]
    results = spark.createDataFrame(rows, "id string, variable string, date string, value double").withColumn("date", F.to_timestamp("date"))
    # real: 1, 2; synthetic: 1 + 2, 2 + 3
    assert metrics.metric_factory("outfall_relerror_flow")(syn, real, results, results).first().value == pytest.approx((4 - 1.5) / 1.5)


@pytest.mark.parametrize("variable", ["flow", "flooding"])
def test_outfall_series_leave_out_real_dates_before_the_first_synthetic(spark, variable):
    """The coefficients look at dates where both sides have a value; the real one's earlier dates don't enter its mean."""
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    net = Network(nodes, spark.createDataFrame([("a", "b", "a")], "u string, v string, id string"))
    series = lambda first, *values: spark.createDataFrame([("a", variable, f"2024-01-01 0{first + h}:00:00", v) for h, v in enumerate(values)], "id string, variable string, date string, value double").withColumn("date", F.to_timestamp("date"))
    syn, real = series(2, 3.0, 6.0), series(0, 100.0, 50.0, 1.0, 3.0)
    # both: (3, 1), (6, 3)
    assert metrics.metric_factory(f"outfall_relerror_{variable}")(net, net, syn, real).first().value == pytest.approx((4.5 - 2) / 2)
    assert metrics.metric_factory(f"outfall_nse_{variable}")(net, net, syn, real).first().value == pytest.approx(1 - (4 + 9) / 2)
