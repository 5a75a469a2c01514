"""Queries of readers and writers, model sections, pipelines of steps and comparisons of many networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.fixtures import view
from urbanflow.functions.geometry import box_ring
from urbanflow.model import Network
from urbanflow.operators import metrics as m
from urbanflow.operators import sections as x
from urbanflow.operators.network import double_directed
from urbanflow.queries.base import Area, forest, streets
from urbanflow.queries.geometry import _G2
from urbanflow.scratch import Scratch
from urbanflow.sources import io

_ = Area()
QUERIES, ORACLES = _.queries, _.oracles
N, NE, NF = ("fx_nodes",), ("fx_nodes", "fx_edges"), ("fx_nodes", "fx_forest")


def _point(x: str, y: str):
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def _lined(net: Network) -> Network:
    """Edges with a straight line between their ends."""
    e = net.edges
    for end in "uv":
        e = e.join(net.nodes.select(F.col("id").alias(end), _point("x", "y").alias(f"_{end}")), end)
    return net.with_(edges=e.withColumn("geometry", F.array("_u", "_v")).drop("_u", "_v"))


@_("s1_s2_tables", " SELECT format, id, x, y, contributing_area FROM fx_nodes, (SELECT unnest(['parquet', 'geojson', 'ndgeojson', 'json']) AS format)", N)
def s1(spark, sf) -> DataFrame:
    """Nodes written and read again in every format."""
    scratch, n, out = Scratch(spark, "s1"), view(spark, sf, "fx_nodes"), None
    for kind in ("parquet", "geojson", "ndgeojson", "json"):
        path = scratch.path(f"nodes.{kind}")
        io.write_table(n, path)
        back = io.read_table(spark, path)
        if "geometry" in back.columns:
            back = back.withColumns({"x": F.col("geometry.coordinates")[0], "y": F.col("geometry.coordinates")[1]})
        own = back.select(F.lit(kind).alias("format"), "id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "contributing_area")))
        out = own if out is None else out.union(own)
    return out


@_("s4_save_network", """ SELECT 'node' AS kind, count(*) AS n, round(sum(x), 3) AS total FROM fx_nodes UNION ALL SELECT 'edge', count(*), round(sum(length), 3) FROM fx_edges""", NE)
def s4(spark, sf) -> DataFrame:
    path = Scratch(spark, "s4").path("network")
    io.save_network(streets(spark, sf), path)
    net = io.saved_network(spark, path)
    one = lambda df, kind, c: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 3).alias("total"))
    return one(net.nodes, "node", "x").union(one(net.edges, "edge", "length"))


@_("s5_s6_features", """ SELECT f.u || '-' || f.v AS id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, f.length, '["' || f.u || '","' || f.v || '"]' AS ends
FROM fx_forest f JOIN fx_nodes a ON a.id = f.u JOIN fx_nodes b ON b.id = f.v""", NF)
def s6(spark, sf) -> DataFrame:
    """Pipes as line features and as flat Parquet rows, joined again by id."""
    path, net = Scratch(spark, "s6").path("features"), _lined(forest(spark, sf))
    net = net.with_(edges=net.edges.withColumns({"id": F.concat_ws("-", "u", "v"), "ends": F.array("u", "v")}))
    io.write_features(net, path, "geojson")
    io.write_features(net, path, "geoparquet")
    lines = io.read_table(spark, f"{path}/edges.ndgeojson").select("id", "geometry")
    at = lambda i, k: F.col("geometry.coordinates")[i][k]
    flat = io.read_table(spark, f"{path}/edges.geoparquet").select("id", "length", "ends")
    return lines.join(flat, "id").select("id", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"), "length", "ends")


@_("s7_scan_bbox", " SELECT sub_id FROM fx_boxes WHERE xmin < 900 AND xmax > 300 AND ymin < 900 AND ymax > -20", ("fx_boxes",))
def s7(spark, sf) -> DataFrame:
    path = Scratch(spark, "s7").path("boxes.parquet")
    io.write_by_place(view(spark, sf, "fx_boxes").select("sub_id", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox")), path)
    return io.scan_bbox(io.read_table(spark, path), 300.0, -20.0, 900.0, 900.0).select("sub_id")


@_("s8_country_iso3", """SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN upper(substr(n_name, 1, 3)) ELSE '' END AS iso3 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def s8(spark, sf) -> DataFrame:
    """Country codes from the nation table; some customers' nations have none."""
    codes = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 20").select(F.col("n_nationkey").alias("iso2"), F.upper(F.substring("n_name", 1, 3)).alias("iso3"))
    own = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    return io.country_iso3(own, codes, "c_nationkey").select("c_custkey", "iso3")


@_("s9_prepare_precipitation", _G2 + " SELECT id, 'm/hr' AS unit, round(ux, 4) AS x, round(uy, 4) AS y FROM utm", ("fx_lonlat",))
def s9(spark, sf) -> DataFrame:
    own = io.prepare_precipitation(view(spark, sf, "fx_lonlat").withColumnsRenamed({"lon": "longitude", "lat": "latitude"}))
    return own.select("id", "unit", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_("s3_load_network", """ SELECT f.u, f.v, f.length, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_forest f JOIN fx_nodes a ON a.id = f.u JOIN fx_nodes b ON b.id = f.v""", NF)
def s3(spark, sf) -> DataFrame:
    """The forest as records of a node-link document a pipe, each with its two nodes and no line, read again."""
    path = Scratch(spark, "s3").path("links.json")
    ends = forest(spark, sf)
    n = ends.nodes.select("id", "x", "y")
    both = ends.edges.join(n.select(F.col("id").alias("u"), F.struct("id", "x", "y").alias("a")), "u").join(n.select(F.col("id").alias("v"), F.struct("id", "x", "y").alias("b")), "v")
    # both ends carry the pipe's name, so that each record is a network of its own
    name = lambda c: F.concat_ws(":", "u", "v", c)
    node = lambda c: F.struct(name(F.lit(c)).alias("id"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y"))
    link = F.struct(name(F.lit("a")).alias("source"), name(F.lit("b")).alias("target"), "u", "v", "length")
    both.select(F.array(node("a"), node("b")).alias("nodes"), F.array(link.withField("tail", F.col("u")).withField("head", F.col("v")).dropFields("u", "v")).alias("links")).write.json(path)
    e = io.load_network(spark, path, lines=True).edges
    return e.select(F.col("tail").alias("u"), F.col("head").alias("v"), "length", *(F.col("geometry")[k][c].alias(f"{c}{k + 1}") for k in (0, 1) for c in "xy"))


@_("s10_read_storm", """ SELECT id AS station, date AS ts, round(sum(value), 4) AS value FROM fx_results WHERE variable = 'click' GROUP BY id, date""", ("fx_results",))
def s10(spark, sf) -> DataFrame:
    """Click sums as a storm file with a comment, read again."""
    path = Scratch(spark, "s10").path("storm.dat")
    r = view(spark, sf, "fx_results").where("variable = 'click'").groupBy("id", "date").agg(F.round(F.sum("value"), 4).alias("value"))
    lines = r.select(F.concat_ws(" ", "id", F.date_format("date", "yyyy MM dd HH mm"), F.col("value").cast("string")).alias("value"))
    lines.union(spark.range(1).select(F.lit("; a comment").alias("value"))).write.text(path)
    return io.read_storm(spark, path)


@_("s11_compose_networks", """, w AS (SELECT u, v, key, max(length) AS length FROM fx_edges WHERE network_type = 'walk' GROUP BY ALL), d AS (SELECT u, v, key, max(length) AS length FROM fx_edges WHERE network_type = 'drive' GROUP BY ALL)
SELECT coalesce(d.u, w.u) AS u, coalesce(d.v, w.v) AS v, coalesce(d.key, w.key) AS key, coalesce(d.length, w.length * 2) AS length FROM w FULL JOIN d ON d.u = w.u AND d.v = w.v AND d.key = w.key""", NE)
def s11(spark, sf) -> DataFrame:
    """Walking and driving streets; where both have an edge, the later one's length holds."""
    net = streets(spark, sf)
    part = lambda t, k: net.with_(edges=net.edges.where(F.col("network_type") == t).select("u", "v", "key", (F.col("length") * k).alias("length")))
    return io.compose_networks([part("walk", 2.0), part("drive", 1.0)]).edges.select("u", "v", "key", "length")


@_("s12_starting_network", """ SELECT u, v, key, 'street' AS edge_type FROM fx_edges UNION ALL SELECT u, v, key, 'river' FROM fx_forest f WHERE (u, v, key) NOT IN (SELECT (u, v, key) FROM fx_edges)""", ("fx_nodes", "fx_edges", "fx_forest"))
def s12(spark, sf) -> DataFrame:
    return io.starting_network(forest(spark, sf), streets(spark, sf)).edges.select("u", "v", "key", "edge_type")


@_("s13_read_results", " SELECT variable, count(*) AS n, round(sum(value), 3) AS total FROM fx_results GROUP BY variable", ("fx_results",))
def s13(spark, sf) -> DataFrame:
    path = Scratch(spark, "s13").path("results.parquet")
    io.write_table(view(spark, sf, "fx_results"), path)
    return io.read_results(spark, path).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


# --- sections -------------------------------------------------------------------------------------------


def _model(spark, sf) -> tuple[Network, DataFrame]:
    """The forest with floors 2 below the surface, and a subcatchment of 120 by 120 around some nodes."""
    net = forest(spark, sf)
    nodes = net.nodes.withColumn("chamber_floor_elevation", F.col("surface_elevation") - 2)
    net = net.with_(nodes=nodes, edges=net.edges.withColumn("id", F.concat_ws("-", "u", "v")))
    b = view(spark, sf, "fx_boxes")
    subs = b.select(
        F.col("sub_id").alias("id"), F.lit(14400.0).alias("area"), F.lit(50.0).alias("rc"), F.lit(120.0).alias("width"), F.lit(0.02).alias("slope"),
        box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("ring"),
    )
    return net, subs


_SINKS = ", sk AS (SELECT * FROM fx_nodes WHERE id NOT IN (SELECT u FROM fx_forest))"


@_("x1_section_tables", _SINKS + """, k AS (SELECT (SELECT count(*) FROM fx_nodes) AS n, (SELECT count(*) FROM fx_forest) AS e, (SELECT count(*) FROM sk) AS s, (SELECT count(*) FROM fx_boxes WHERE sub_id IN (SELECT id FROM fx_nodes)) AS b)
SELECT section, n FROM (SELECT unnest(['CONDUITS', 'XSECTIONS', 'STORAGE', 'JUNCTIONS', 'OUTFALLS', 'COORDINATES', 'MAP', 'SYMBOLS', 'RAINGAGES', 'SUBCATCHMENTS', 'SUBAREAS', 'INFILTRATION', 'POLYGONS', 'VERTICES']) AS section,
unnest([e + s, e + s, k.n, k.n, s, k.n + s, 1, 1, 1, b, b, b, b * 5, 0]) AS n FROM k)""", (*NF, "fx_boxes"))
def x1(spark, sf) -> DataFrame:
    tables = x.section_tables(*_model(spark, sf))
    out = None
    for name, t in tables.items():
        own = t.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.union(own)
    return out


@_("x1_subcatchments", """ SELECT sub_id || '-sub' AS c0, '1' AS c1, sub_id AS c2, 1.44::DOUBLE AS c3, 50.0::DOUBLE AS c4, 120.0::DOUBLE AS c5, 2.0::DOUBLE AS c6, '0' AS c7, 'empty' AS c8 FROM fx_boxes WHERE sub_id IN (SELECT id FROM fx_nodes)""", ("fx_nodes", "fx_boxes"))
def x1s(spark, sf) -> DataFrame:
    return x.section_tables(*_model(spark, sf))["SUBCATCHMENTS"]


@_("x2_outfall_twins", _SINKS + """ SELECT id || '_outfall' AS id, round(surface_elevation - 7, 6) AS floor, x - 50 AS x, y - 50 AS y, id AS u, round(sqrt(5000), 6) AS length, round((SELECT max(diameter) FROM fx_forest), 6) AS diameter FROM sk""", NF)
def x2(spark, sf) -> DataFrame:
    out, links = x.outfall_twins(_model(spark, sf)[0])
    both = out.join(links.select(F.col("v").alias("id"), "u", "length", "diameter"), "id")
    return both.select("id", F.round("chamber_floor_elevation", 6).alias("floor"), "x", "y", "u", F.round("length", 6).alias("length"), F.round("diameter", 6).alias("diameter"))


@_("x3_extents", " SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fx_nodes", N)
def x3(spark, sf) -> DataFrame:
    return x.extents(view(spark, sf, "fx_nodes"))


@_("x4_to_section", " SELECT id AS c0, CASE WHEN contributing_area > 25 THEN contributing_area ELSE 0 END AS c1, 'FREE' AS c2 FROM fx_nodes", N)
def x4(spark, sf) -> DataFrame:
    n = view(spark, sf, "fx_nodes").withColumn("a", F.when(F.col("contributing_area") > 25, F.col("contributing_area")))
    return x.to_section(n, ("id", "a", x.Const("FREE")))


@_("x5_write_sections", " SELECT rtrim(rpad(id, 16, ' ') || rpad(CAST(x AS VARCHAR), 16, ' ') || CAST(y AS VARCHAR)) AS value FROM fx_nodes", N)
def x5(spark, sf) -> DataFrame:
    path = Scratch(spark, "x5").path("sections")
    x.write_sections({"COORDINATES": x.to_section(view(spark, sf, "fx_nodes"), x.SECTIONS["COORDINATES"])}, path)
    return spark.read.text(f"{path}/COORDINATES")


# --- pipelines, users' own coefficients and scales, many pairs --------------------------------------------


@x.requires(edges=("length",), adds_edges=("weight",))
def weigh(net: Network, factor: float = 2.0, **_) -> Network:
    return net.with_(edges=net.edges.withColumn("weight", F.col("length") * factor))


@x.requires(edges=("weight",))
def keep_light(net: Network, most: float = 80.0, **_) -> Network:
    return net.with_(edges=net.edges.where(F.col("weight") <= most))


@x.requires(edges=("length",))
def both_ways(net: Network, **_) -> Network:
    return double_directed(net)


@_("u1_run_pipeline", """, l AS (SELECT u, v, length * 2 AS weight FROM fx_edges WHERE length * 2 <= 80) SELECT count(*) AS n, round(sum(weight), 3) AS total FROM l""", NE)
def u1(spark, sf) -> DataFrame:
    net = x.run_pipeline(streets(spark, sf), [weigh, keep_light], factor=2.0, most=80.0)
    return net.edges.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("total"))


def _mean_gap(y, yhat):
    """A user's coefficient: mean absolute gap."""
    return F.avg(F.abs(y - yhat))


def _scale_network(coef, variable: str, syn: Network, real: Network) -> DataFrame:
    """A user's scale: an edge column of both networks, edge by edge."""
    both = syn.edges.select("u", "v", "key", F.col(variable).alias("value_syn")).join(real.edges.select("u", "v", "key", F.col(variable).alias("value_real")), ["u", "v", "key"])
    return m.coef_of(both, coef)


@_("u2_own_metric", " SELECT round(avg(length), 6) AS value FROM fx_edges", NE)
def u2(spark, sf) -> DataFrame:
    net = streets(spark, sf)
    twice = net.with_(edges=net.edges.withColumn("length", F.col("length") * 2))
    run = m.metric_factory("network_gap_length", coefficients={"gap": _mean_gap}, scales={"network": _scale_network})
    return run(twice, net).select(F.round("value", 6).alias("value"))


@_("m17_compare_all", """, n AS (SELECT network_type AS t, count(*) AS n, sum(length) AS l FROM fx_edges GROUP BY 1), p AS (SELECT a.t || '-' || b.t AS pair_id, a.n AS an, b.n AS bn, a.l AS al, b.l AS bl FROM n a, n b)
SELECT pair_id, 'npipes' AS metric, round((an - bn) / bn, 9) AS value FROM p UNION ALL SELECT pair_id, 'length', round((al - bl) / bl, 9) FROM p""", NE)
def m17(spark, sf) -> DataFrame:
    """Every pair of the driving and walking networks by two metrics."""
    net = streets(spark, sf)
    parts = {t: net.with_(edges=net.edges.where(F.col("network_type") == t)) for t in ("drive", "walk")}
    pairs = {f"{a}-{b}": (parts[a], parts[b]) for a in parts for b in parts}
    out = m.compare_all(pairs, {k: m.metric_factory(f"outfall_relerror_{k}") for k in ("npipes", "length")})
    return out.withColumn("value", F.round("value", 9))
