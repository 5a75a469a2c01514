"""Queries of joins, cleaning and weighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.fixtures import view
from urbanflow.functions import geometry as g
from urbanflow.model import Network, TopologyDerivation
from urbanflow.operators import network as op
from urbanflow.operators import spatial as sp
from urbanflow.queries.base import Area, streets
from urbanflow.scratch import Scratch

_ = Area()
QUERIES, ORACLES = _.queries, _.oracles
NE = ("fx_nodes", "fx_edges")


def _boxes(spark, sf):
    return view(spark, sf, "fx_boxes").select("sub_id", g.box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("ring"))


@_("j1_with_endpoints", """SELECT e.u, e.v, e.key, a.x AS x_u, a.y AS y_u, b.x AS x_v, b.y AS y_v
FROM fx_edges e JOIN fx_nodes a ON a.id = e.u JOIN fx_nodes b ON b.id = e.v""", NE)
def j1(spark, sf):
    return op.with_endpoints(streets(spark, sf), ["x", "y"]).select("u", "v", "key", "x_u", "y_u", "x_v", "y_v")


@_("j2_edge_pairs", "SELECT a.u, a.v, a.key, b.v AS w FROM fx_edges a JOIN fx_edges b ON a.v = b.u WHERE b.v <> a.u", NE)
def j2(spark, sf):
    return op.edge_pairs(streets(spark, sf))


_INSIDE = "n.x > b.xmin AND n.x < b.xmax AND n.y > b.ymin AND n.y < b.ymax"


@_("j3_nodes_to_subs", f"SELECT n.id, b.sub_id FROM fx_nodes n JOIN fx_boxes b ON {_INSIDE}", ("fx_nodes", "fx_boxes"))
def j3(spark, sf):
    return sp.nodes_to_subs(view(spark, sf, "fx_nodes"), _boxes(spark, sf), 100.0).select("id", "sub_id")


@_("j4_classify", f"SELECT n.id, b.sub_id FROM fx_nodes n LEFT JOIN fx_boxes b ON {_INSIDE}", ("fx_nodes", "fx_boxes"))
def j4(spark, sf):
    return sp.classify(view(spark, sf, "fx_nodes"), _boxes(spark, sf), 100.0).select("id", "sub_id")


@_("j6_nearest_within", """SELECT id, near, round(dist, 9) AS dist FROM (SELECT n.id, r.id AS near, sqrt((n.x - r.x) ** 2 + (n.y - r.y) ** 2) AS dist,
row_number() OVER (PARTITION BY n.id ORDER BY sqrt((n.x - r.x) ** 2 + (n.y - r.y) ** 2), r.id) AS k FROM fx_nodes n, fx_river r) WHERE k = 1 AND dist <= 60""", ("fx_nodes", "fx_river"))
def j6(spark, sf):
    near = sp.nearest_within(view(spark, sf, "fx_nodes"), view(spark, sf, "fx_river"), 60.0)
    return near.withColumn("dist", F.round("dist", 9))


@_("j7_pairs_within", """, p AS (SELECT CAST(vec_id AS STRING) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT a.id AS id_a, b.id AS id_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS dist FROM p a JOIN p b ON a.id < b.id
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02""", ("fx_nodes",))
def j7(spark, sf):
    return sp.pairs_within(_vectors(spark, sf), 0.02).withColumn("dist", F.round("dist", 9))


def _vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@_("j9_keep_ids", "SELECT id, variable, date, value FROM fx_results WHERE id IN (SELECT id FROM fx_nodes WHERE x < 2000)", ("fx_results", "fx_nodes"))
def j9(spark, sf):
    return op.keep_ids(view(spark, sf, "fx_results"), view(spark, sf, "fx_nodes").where("x < 2000")).select("id", "variable", "date", "value")


@_("j10_sinks", "SELECT id FROM fx_nodes WHERE id NOT IN (SELECT u FROM fx_edges)", NE)
def j10(spark, sf):
    return op.sinks(streets(spark, sf)).select("id")


_ID = ", e1 AS (SELECT * EXCLUDE k FROM (SELECT *, u || '-' || v AS id, row_number() OVER (PARTITION BY u, v ORDER BY key) AS k FROM fx_edges) WHERE k = 1)"


@_("n1_assign_id", _ID + " SELECT id, key, length FROM e1", NE)
def n1(spark, sf):
    return op.assign_id(streets(spark, sf)).edges.select("id", "key", "length")


@_("n2_remove_parallel_edges", "SELECT u, v, key, length FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, key) AS k FROM fx_edges) WHERE k = 1", NE)
def n2(spark, sf):
    return op.remove_parallel_edges(streets(spark, sf)).edges.select("u", "v", "key", "length")


@_("n3_remove_non_pipe_allowable_links", "SELECT u, v, key FROM fx_edges WHERE highway NOT IN ('motorway', 'bridge') AND bridge IS NULL", NE)
def n3(spark, sf):
    return op.remove_non_pipe_allowable_links(streets(spark, sf), ["motorway", "bridge"]).edges.select("u", "v", "key")


@_("n4_street_cover", """SELECT e.u, e.v, e.key, l AS lanes, round(2 * 3.5 * l * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS area
FROM (SELECT *, CASE WHEN lanes = '2;1' THEN 3.0 ELSE CAST(lanes AS DOUBLE) END AS l FROM fx_edges WHERE network_type = 'drive') e
JOIN fx_nodes a ON a.id = e.u JOIN fx_nodes b ON b.id = e.v WHERE l > 0""", NE)
def n4(spark, sf):
    c = op.street_cover(streets(spark, sf), 3.5)
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: s + g.ring_area(r))
    return c.select("u", "v", "key", "lanes", F.round(area, 4).alias("area"))


@_("n5_double_directed", _ID + """ SELECT u, v, id FROM e1 UNION ALL
SELECT v, u, id || '.reversed' FROM e1 a WHERE NOT EXISTS (SELECT 1 FROM e1 b WHERE b.u = a.v AND b.v = a.u)""", NE)
def n5(spark, sf):
    return op.double_directed(op.assign_id(streets(spark, sf))).edges.select("u", "v", "id")


@_("n6_to_undirected", """SELECT least(u, v) AS u, greatest(u, v) AS v, key, length FROM (SELECT *,
row_number() OVER (PARTITION BY least(u, v), greatest(u, v), key ORDER BY u DESC, v DESC) AS k FROM fx_edges) WHERE k = 1""", NE)
def n6(spark, sf):
    return op.to_undirected(streets(spark, sf)).edges.select("u", "v", "key", "length")


def _lined(spark, sf):
    net = streets(spark, sf)
    e = op.with_endpoints(op.remove_parallel_edges(net), ["x", "y"])
    p = lambda n: F.struct(F.col(f"x_{n}").alias("x"), F.col(f"y_{n}").alias("y"))
    return net.with_(edges=e.withColumn("geometry", F.array(p("u"), p("v"))).select(*net.edges.columns, "geometry"))


_STRAIGHT = """, s AS (SELECT DISTINCT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM fx_edges e JOIN fx_nodes a ON a.id = e.u JOIN fx_nodes b ON b.id = e.v),
c AS (SELECT *, greatest(1, CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 60) AS INT)) AS n FROM s),
q AS (SELECT *, unnest(range(0, n)) AS i FROM c),
seg AS (SELECT DISTINCT round(ax + (bx - ax) * i / n, 6) AS x1, round(ay + (by_ - ay) * i / n, 6) AS y1, round(ax + (bx - ax) * (i + 1) / n, 6) AS x2, round(ay + (by_ - ay) * (i + 1) / n, 6) AS y2 FROM q)"""


@_("n7_split_long_edges", _STRAIGHT + " SELECT x1, y1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) <= 60.001 AS short FROM seg", NE)
def n7(spark, sf):
    e = op.split_long_edges(_lined(spark, sf), 60.0).edges
    at = lambda i, c: F.round(F.col("geometry")[i][c], 6)
    return e.select(at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2"), (F.col("length") <= 60.001).alias("short"))


_CLUSTERS = """, p AS (SELECT CAST(vec_id AS STRING) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
near AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.004),
reach AS (SELECT u AS id, u AS other FROM near UNION SELECT r.id, n.v FROM reach r JOIN near n ON r.other = n.u),
head AS (SELECT id, min(other) AS head FROM reach GROUP BY id)"""


@_("n8_merge_points", _CLUSTERS + """ SELECT h.id, h.head, round(avg(p.x) OVER (PARTITION BY h.head), 9) AS x, round(avg(p.y) OVER (PARTITION BY h.head), 9) AS y
FROM head h JOIN p ON p.id = h.id""", ("fx_nodes",), recursive=True)
def n8(spark, sf):
    m = op.merge_points(_vectors(spark, sf), 0.004, Scratch(spark, "n8"))
    return m.select("id", "head", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _ring_net(spark, sf):
    """Points of the embeddings in a chain of streets."""
    p = _vectors(spark, sf)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("u"), (F.col("vec_id") + 1).cast("string").alias("v"), F.lit(0).alias("key"), F.lit("street").alias("edge_type"))
    return Network(p, e.join(p.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "key", "edge_type"))


@_("n9_merge_street_nodes", _CLUSTERS + """, e AS (SELECT id AS u, CAST(CAST(id AS BIGINT) + 1 AS STRING) AS v FROM p WHERE CAST(CAST(id AS BIGINT) + 1 AS STRING) IN (SELECT id FROM p))
SELECT * FROM (SELECT coalesce(a.head, e.u) AS u, coalesce(b.head, e.v) AS v FROM e LEFT JOIN head a ON a.id = e.u LEFT JOIN head b ON b.id = e.v) WHERE u <> v""", ("fx_nodes",), recursive=True)
def n9(spark, sf):
    return op.merge_street_nodes(_ring_net(spark, sf), 0.004, Scratch(spark, "n9")).edges.select("u", "v")


@_("n10_fix_geometries", """SELECT u, v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, key) AS k FROM fx_edges) e
JOIN fx_nodes a ON a.id = u JOIN fx_nodes b ON b.id = v WHERE k = 1""", NE)
def n10(spark, sf):
    net = _lined(spark, sf)
    odd = F.when(F.col("length") > 25, F.reverse("geometry")).when(F.col("length") > 10, F.slice("geometry", 1, 1)).otherwise(F.col("geometry"))
    e = op.fix_geometries(net.with_(edges=net.edges.withColumn("geometry", odd))).edges
    at = lambda i, c: F.element_at("geometry", i)[c]
    return e.select("u", "v", at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(-1, "x").alias("x2"), at(-1, "y").alias("y2"))


def _typed(spark, sf):
    net = streets(spark, sf)
    kind = F.expr("CASE WHEN length > 49 THEN 'river' WHEN length > 48 THEN 'outfall' ELSE 'street' END")
    return net.with_(edges=net.edges.withColumn("edge_type", kind))


_TYPED = ", t AS (SELECT u, v, key, length, CASE WHEN length > 49 THEN 'river' WHEN length > 48 THEN 'outfall' ELSE 'street' END AS kind FROM fx_edges)"


@_("n11_filter_streets", _TYPED + """, gone AS (SELECT v AS id FROM t WHERE kind = 'outfall' UNION SELECT u FROM t WHERE kind = 'river' UNION SELECT v FROM t WHERE kind = 'river')
SELECT u, v, key FROM t WHERE kind = 'street' AND u NOT IN (SELECT id FROM gone) AND v NOT IN (SELECT id FROM gone)""", NE)
def n11(spark, sf):
    return op.filter_streets(_typed(spark, sf)).edges.select("u", "v", "key")


_BASIN = "CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL ELSE CAST(floor(x / 1500) AS INT) END"


@_("n12_clip_subbasin", f""", b AS (SELECT id, {_BASIN} AS basin FROM fx_nodes)
SELECT u, v, key FROM fx_edges JOIN b a ON a.id = u JOIN b c ON c.id = v WHERE a.basin = c.basin""", NE)
def n12(spark, sf):
    net = streets(spark, sf)
    return op.clip_to_catchments(net, net.nodes.select("id", F.expr(_BASIN).alias("basin"))).edges.select("u", "v", "key")


@_("n12_clip_community", f""", b AS (SELECT id, coalesce({_BASIN}, -1) AS basin, CAST(CAST(id AS BIGINT) % 5 AS INT) AS community FROM fx_nodes),
weak AS (SELECT community, basin FROM (SELECT community, basin, count(*) / sum(count(*)) OVER (PARTITION BY community) AS share FROM b GROUP BY community, basin) WHERE share <= 0.3)
SELECT u, v, key FROM fx_edges JOIN b a ON a.id = u JOIN b c ON c.id = v
WHERE NOT (a.community <> c.community AND key = 0 AND ((a.community, c.basin) IN (SELECT (community, basin) FROM weak) OR (c.community, a.basin) IN (SELECT (community, basin) FROM weak)))""", NE)
def n12c(spark, sf):
    net = streets(spark, sf)
    basins = net.nodes.select("id", F.expr(_BASIN).alias("basin"))
    communities = net.nodes.select("id", F.expr("CAST(CAST(id AS BIGINT) % 5 AS INT)").alias("community"))
    return op.clip_to_catchments(net, basins, "community", 0.3, communities).edges.select("u", "v", "key")


@_("n12_clip_own_communities", None)
def n12o(spark, sf):
    net = streets(spark, sf)
    basins = net.nodes.select("id", F.expr(_BASIN).alias("basin"))
    return op.clip_to_catchments(net, basins, "community", 0.3).edges.select("u", "v", "key")


@_("n13_points_by_type", _TYPED + " SELECT DISTINCT kind AS edge_type, unnest([u, v]) AS id FROM t", NE)
def n13(spark, sf):
    return op.points_by_type(_typed(spark, sf))


@_("n14_subgraph", """SELECT u, v, key FROM fx_edges WHERE u IN (SELECT id FROM fx_nodes WHERE x < 2500) AND v IN (SELECT id FROM fx_nodes WHERE x < 2500)""", NE)
def n14(spark, sf):
    net = streets(spark, sf)
    return op.subgraph(net, net.nodes.where("x < 2500")).edges.select("u", "v", "key")


_SLOPE = ", sl AS (SELECT e.*, (a.surface_elevation - b.surface_elevation) / e.length AS slope FROM fx_edges e JOIN fx_nodes a ON a.id = e.u JOIN fx_nodes b ON b.id = e.v)"
_W3 = "CASE WHEN s < -1 THEN 1 WHEN s <= 0.3 THEN 1 - (s + 1) / 1.3 WHEN s <= 0.7 THEN 0 WHEN s <= 10 THEN (s - 0.7) / 9.3 ELSE 1 END"


@_("w2_surface_slope", _SLOPE + " SELECT u, v, key, round(slope, 9) AS surface_slope FROM sl", NE)
def w2(spark, sf):
    return op.set_surface_slope(streets(spark, sf)).edges.select("u", "v", "key", F.round("surface_slope", 9).alias("surface_slope"))


@_("w3_chahinian_slope", _SLOPE + f" SELECT u, v, key, round({_W3}, 9) AS chahinian_slope FROM (SELECT *, 100 * slope AS s FROM sl)", NE)
def w3(spark, sf):
    return op.set_chahinian_slope(op.set_surface_slope(streets(spark, sf))).edges.select("u", "v", "key", F.round("chahinian_slope", 9).alias("chahinian_slope"))


_W4 = """, pr AS (SELECT a.u, a.v, a.key, p.x - q.x AS ax, p.y - q.y AS ay, r.x - q.x AS bx, r.y - q.y AS by_
FROM fx_edges a JOIN fx_edges b ON a.v = b.u AND b.v <> a.u JOIN fx_nodes p ON p.id = a.u JOIN fx_nodes q ON q.id = a.v JOIN fx_nodes r ON r.id = b.v),
an AS (SELECT u, v, key, CASE WHEN sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) = 0 THEN 'inf'::DOUBLE
  ELSE degrees(acos(least(greatest((ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)), -1), 1))) END AS g FROM pr),
wt AS (SELECT u, v, key, min(CASE WHEN g <= 90 THEN 1 - 0.8 * g / 90 WHEN g <= 135 THEN 0.2 + 0.5 * (g - 90) / 45 WHEN g <= 180 THEN 0.7 - 0.7 * (g - 135) / 45 ELSE 1 END) AS w FROM an GROUP BY u, v, key)"""


@_("w4_chahinian_angle", _W4 + " SELECT e.u, e.v, e.key, round(coalesce(w, 0), 6) AS chahinian_angle FROM fx_edges e LEFT JOIN wt ON wt.u = e.u AND wt.v = e.v AND wt.key = e.key", NE)
def w4(spark, sf):
    return op.set_chahinian_angle(streets(spark, sf)).edges.select("u", "v", "key", F.round("chahinian_angle", 6).alias("chahinian_angle"))


@_("w5_calculate_weights", _SLOPE + """, m AS (SELECT min(length) AS a, max(length) AS b, min(slope) AS c, max(slope) AS d FROM sl)
SELECT u, v, key, round(2 * greatest((length - a) / (b - a), 2.220446049250313e-16) ** 1.5 + 3 * greatest((slope - c) / (d - c), 2.220446049250313e-16), 9) AS weight FROM sl, m""", NE)
def w5(spark, sf):
    net = op.set_surface_slope(streets(spark, sf))
    net = net.with_(edges=net.edges.withColumn("flat", F.lit(1.0)))
    p = TopologyDerivation(weights=("length", "surface_slope", "flat"), scaling={"length": 2.0, "surface_slope": 3.0}, exponent={"length": 1.5})
    return op.calculate_weights(net, p).edges.select("u", "v", "key", F.round("weight", 9).alias("weight"))
