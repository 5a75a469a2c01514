"""Queries of graph primitives, outfalls, topology and design."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from urbanflow.fixtures import view
from urbanflow.model import HydraulicDesign, Network, OutfallDerivation
from urbanflow.operators import design as d
from urbanflow.operators import metrics
from urbanflow.operators import paths as p
from urbanflow.operators import topology as t
from urbanflow.operators.components import components
from urbanflow.queries.base import Area, forest, streets
from urbanflow.scratch import Scratch, dealt

_ = Area()
QUERIES, ORACLES = _.queries, _.oracles
NF, NE = ("fx_nodes", "fx_forest"), ("fx_nodes", "fx_edges")
#: Every pair of a node and one downstream of it, with hops, length and largest length of the path.
_DOWN = """, dn AS (SELECT u AS a, v AS b, 1 AS hops, length AS len, length AS most FROM fx_forest
UNION ALL SELECT dn.a, f.v, dn.hops + 1, dn.len + f.length, greatest(dn.most, f.length) FROM dn JOIN fx_forest f ON f.u = dn.b)"""


@_("p1_components", """, e AS (SELECT u, v FROM fx_forest WHERE length <= 60), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS id, v AS o FROM s UNION SELECT r.id, s.v FROM r JOIN s ON s.u = r.o) SELECT id, least(id, min(o)) AS component FROM r GROUP BY id""", NF, recursive=True)
def p1(spark, sf):
    return components(view(spark, sf, "fx_forest").where("length <= 60"), Scratch(spark, "p1"))


@_("p2_reach", _DOWN + " SELECT a AS id FROM dn WHERE b = '3' UNION SELECT '3'", NF, recursive=True)
def p2(spark, sf):
    net = forest(spark, sf)
    return p.reach(net.edges, net.nodes.where("id = '3'"), Scratch(spark, "p2"))


@_("p3_shortest_paths", _DOWN + """, c AS (SELECT a AS id, b AS outfall, len FROM dn WHERE CAST(b AS BIGINT) BETWEEN 1 AND 12 UNION ALL SELECT id, id, 0 FROM fx_nodes WHERE CAST(id AS BIGINT) BETWEEN 1 AND 12),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len) AS k FROM c) SELECT k.id, len AS dist, CASE WHEN len > 0 THEN f.v END AS parent, outfall FROM k LEFT JOIN fx_forest f ON f.u = k.id WHERE k = 1""", NF, recursive=True)
def p3(spark, sf):
    net = forest(spark, sf)
    return p.shortest_paths(net.edges, net.nodes.where("CAST(id AS BIGINT) BETWEEN 1 AND 12"), Scratch(spark, "p3"), "length")


@_("p4_levels", _DOWN + ", n AS (SELECT u AS id FROM fx_forest UNION SELECT v FROM fx_forest) SELECT n.id, coalesce(max(hops), 0) AS level FROM n LEFT JOIN dn ON dn.b = n.id GROUP BY n.id", NF, recursive=True)
def p4(spark, sf):
    return p.levels(view(spark, sf, "fx_forest"), Scratch(spark, "p4"))


_UP = _DOWN + ", up AS (SELECT b AS id, a FROM dn UNION ALL SELECT id, id FROM fx_nodes), acc AS (SELECT up.id, sum(n.contributing_area) AS total FROM up JOIN fx_nodes n ON n.id = up.a GROUP BY up.id)"


@_("p5_accumulate_forest", _UP + " SELECT id, total FROM acc", NF, recursive=True)
def p5(spark, sf):
    net = forest(spark, sf)
    return p.accumulate_forest(net.edges.select(F.col("u").alias("id"), F.col("v").alias("parent")), net.nodes.select("id", F.col("contributing_area").alias("value")), Scratch(spark, "p5"))


@_("p5_accumulate_general", _UP + " SELECT id, total FROM acc", NF, recursive=True)
def p5g(spark, sf):
    net = forest(spark, sf)
    return p.accumulate(net.edges, net.nodes.select("id", F.col("contributing_area").alias("value")), Scratch(spark, "p5g"))


@_("p6_min_spanning_forest", None)
def p6(spark, sf):
    return p.min_spanning_forest(streets(spark, sf).edges, Scratch(spark, "p6"))


@_("p7_greedy_in_tree", _DOWN + " SELECT dn.a AS id, f.v AS parent, most AS bottleneck, hops FROM dn JOIN fx_forest f ON f.u = dn.a WHERE b = '1' UNION ALL SELECT '1', NULL, '-inf'::DOUBLE, 0", NF, recursive=True)
def p7(spark, sf):
    return p.greedy_in_tree(view(spark, sf, "fx_forest"), "1", Scratch(spark, "p7"), "length")


@_("p8_communities", None)
def p8(spark, sf):
    return p.communities(streets(spark, sf).edges, Scratch(spark, "p8"))


_BT = _DOWN + """, n AS (SELECT u AS id FROM fx_forest UNION SELECT v FROM fx_forest), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n),
up AS (SELECT n.id, count(dn.a) AS above FROM n LEFT JOIN dn ON dn.b = n.id GROUP BY n.id), below AS (SELECT n.id, count(dn.b) AS below FROM n LEFT JOIN dn ON dn.a = n.id GROUP BY n.id)"""


@_("p9_edge_betweenness", _BT + " SELECT f.u, f.v, round((above + 1) * (below + 1) / (n * (n - 1)), 12) AS value FROM fx_forest f JOIN up ON up.id = f.u JOIN below ON below.id = f.v, c", NF, recursive=True)
def p9(spark, sf):
    net = forest(spark, sf)
    every = net.edges.select(F.col("u").alias("id")).union(net.edges.select("v")).distinct()
    return p.betweenness(net.edges, every, Scratch(spark, "p9")).withColumn("value", F.round("value", 12))


@_("p10_betweenness", _BT + " SELECT up.id, round(above * below / ((n - 1) * (n - 2)), 12) AS value FROM up JOIN below USING (id), c", NF, recursive=True)
def p10(spark, sf):
    net = forest(spark, sf)
    every = net.edges.select(F.col("u").alias("id")).union(net.edges.select("v")).distinct()
    return p.betweenness(net.edges, every, Scratch(spark, "p10"), "node").withColumn("value", F.round("value", 12))


@_("p11_degree", """, e AS (SELECT u AS id, 1 AS o, 0 AS i FROM fx_edges UNION ALL SELECT v, 0, 1 FROM fx_edges)
SELECT id, sum(i) AS in_degree, sum(o) AS out_degree, count(*) AS degree FROM e GROUP BY id""", NE)
def p11(spark, sf):
    return p.degree(streets(spark, sf).edges)


_SIMPLE = ", s AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM fx_edges), b2 AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)"


@_("p12_clustering", _SIMPLE + """, dg AS (SELECT a AS id, count(*) AS degree FROM b2 GROUP BY a),
tr AS (SELECT x.a AS id, count(*) / 2 AS t FROM b2 x JOIN b2 y ON x.a = y.a AND x.b <> y.b JOIN b2 z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT dg.id, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN coalesce(t, 0) * 2.0 / (degree * (degree - 1)) ELSE 0 END, 9) AS clustering FROM dg LEFT JOIN tr USING (id)""", NE)
def p12(spark, sf):
    return p.clustering(streets(spark, sf).edges).withColumn("clustering", F.round("clustering", 9))


_FSIMPLE = ", s AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM fx_forest), b2 AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)"


@_("p13_ego", _FSIMPLE + """, mem AS (SELECT a AS id, b AS m FROM b2 UNION SELECT a, a FROM b2),
st AS (SELECT mem.id, b2.b AS n, (mem.id, b2.b) IN (SELECT (id, m) FROM mem) AS inside FROM mem JOIN b2 ON b2.a = mem.m)
SELECT id, CAST(count(*) FILTER (inside) / 2 AS BIGINT) AS ego_edges, count(DISTINCT n) FILTER (NOT inside) AS ego_neighbours, count(*) FILTER (NOT inside) AS ego_out FROM st GROUP BY id""", NF)
def p13(spark, sf):
    return p.ego(view(spark, sf, "fx_forest"))


@_("p14_spmv", " SELECT u AS i, round(sum(e.length * n.x), 6) AS x FROM fx_edges e JOIN fx_nodes n ON n.id = e.v GROUP BY u", NE)
def p14(spark, sf):
    net = streets(spark, sf)
    coo = net.edges.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("length").alias("w"))
    return p.spmv(coo, net.nodes.select(F.col("id").alias("i"), "x")).withColumn("x", F.round("x", 6))


# --- outfalls -------------------------------------------------------------------------------------------


def _with_river(spark, sf) -> Network:
    """The forest cut in parts as streets, the supplier points chained as a river."""
    net = forest(spark, sf)
    street = net.edges.where("length <= 65").select("u", "v", "key", "length", F.lit("street").alias("edge_type"))
    r = view(spark, sf, "fx_river")
    nxt = r.select(F.col("id").alias("u"), F.concat(F.lit("river"), (F.substring("id", 6, 20).cast("long") + 1).cast("string")).alias("v"), F.lit(0).alias("key"), F.lit(10.0).alias("length"), F.lit("river").alias("edge_type"))
    chain = nxt.join(r.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "key", "length", "edge_type")
    nodes = net.nodes.select("id", "x", "y", "surface_elevation").unionByName(r, allowMissingColumns=True)
    return Network(nodes, street.union(chain).withColumn("weight", F.col("length")))


_PAIRED = """, st AS (SELECT u, v, length FROM fx_forest WHERE length <= 65), sp AS (SELECT id, x, y, surface_elevation FROM fx_nodes WHERE id IN (SELECT u FROM st UNION SELECT v FROM st)),
near AS (SELECT u, v FROM (SELECT n.id AS u, r.id AS v, sqrt((n.x - r.x) ** 2 + (n.y - r.y) ** 2) AS d, row_number() OVER (PARTITION BY n.id ORDER BY sqrt((n.x - r.x) ** 2 + (n.y - r.y) ** 2), r.id) AS k FROM sp n, fx_river r) WHERE k = 1 AND d <= 40),
sy AS (SELECT u, v FROM st UNION SELECT v, u FROM st), r AS (SELECT u AS id, v AS o FROM sy UNION SELECT r.id, sy.v FROM r JOIN sy ON sy.u = r.o), cc AS (SELECT id, least(id, min(o)) AS c FROM r GROUP BY id),
lost AS (SELECT cc.c, cc.id, n.surface_elevation, row_number() OVER (PARTITION BY cc.c ORDER BY n.surface_elevation, cc.id) AS k FROM cc JOIN fx_nodes n USING (id) WHERE cc.c NOT IN (SELECT c FROM cc JOIN near ON near.u = cc.id)),
outf AS (SELECT u, v FROM near UNION ALL SELECT id, id || '-dummy_river' FROM lost WHERE k = 1)"""
NFR = ("fx_nodes", "fx_forest", "fx_river")


@_("o1_pair_rivers", _PAIRED + " SELECT u, v, 40.0::DOUBLE AS length, u || '-' || v || '-outfall' AS id FROM outf", NFR, recursive=True)
def o1(spark, sf):
    return t.pair_rivers(_with_river(spark, sf), 40.0, 40.0, Scratch(spark, "o1")).edges.where("edge_type = 'outfall'").select("u", "v", "length", "id")


@_("o3_river_weights", """ SELECT CAST(s_suppkey AS STRING) AS u, 0.0::DOUBLE AS length, 0.0::DOUBLE AS weight FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)""", NFR)
def o3(spark, sf):
    e = t.river_weights(_with_river(spark, sf)).edges.where("edge_type = 'river'")
    return e.select(F.substring("u", 6, 20).alias("u"), "length", "weight")


@_("o4_root_nodes", " SELECT id AS u, 'waste' AS v, 0.0::DOUBLE AS weight FROM fx_nodes WHERE id NOT IN (SELECT u FROM fx_forest)", NF)
def o4(spark, sf):
    net = forest(spark, sf)
    return t.root_nodes(net).edges.where("edge_type = 'waste-outfall'").select("u", "v", "weight")


@_("o5_identify_outfalls_withtopo", _PAIRED + " SELECT edge_type, count(*) AS n FROM (SELECT 'street' AS edge_type FROM st UNION ALL SELECT 'outfall' FROM outf UNION ALL SELECT 'river' FROM fx_river r WHERE 'river' || CAST(CAST(substring(r.id, 6) AS BIGINT) + 1 AS STRING) IN (SELECT id FROM fx_river)) GROUP BY 1", NFR, recursive=True)
def o5(spark, sf):
    net = t.identify_outfalls(_with_river(spark, sf), OutfallDerivation("withtopo", 40.0, 40.0), Scratch(spark, "o5"))
    return net.edges.where("edge_type <> 'waste-outfall'").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@_("o5_identify_outfalls_separate", None)
def o5s(spark, sf):
    net = t.identify_outfalls(_with_river(spark, sf), OutfallDerivation("separate", 40.0, 40.0), Scratch(spark, "o5s"))
    return net.edges.where("edge_type = 'outfall'").select("u", "v", "id")


@_("o7_derive_topology", None)
def o7(spark, sf):
    scratch = Scratch(spark, "o7")
    net = t.identify_outfalls(_with_river(spark, sf), OutfallDerivation("separate", 40.0, 40.0), scratch)
    return t.derive_topology(net, scratch).nodes.select("id", "outfall", "shortest_path")


#: Outfalls of 40.5 tie with no street. Streets of up to 40 make clusters, which the tree joins first; a cluster keeps its
#: first outfall edge, unless a sink without one gives it a free way to the waste node.
_CHOSEN = _PAIRED + """, sh AS (SELECT u, v FROM st WHERE length <= 40 UNION SELECT v, u FROM st WHERE length <= 40), rs AS (SELECT u AS id, v AS o FROM sh UNION SELECT rs.id, sh.v FROM rs JOIN sh ON sh.u = rs.o),
cl AS (SELECT sp.id, least(sp.id, coalesce(min(rs.o), sp.id)) AS c FROM sp LEFT JOIN rs ON rs.id = sp.id GROUP BY sp.id),
fr AS (SELECT DISTINCT c FROM cl WHERE id NOT IN (SELECT u FROM st) AND id NOT IN (SELECT u FROM outf)),
pick AS (SELECT u, v FROM (SELECT outf.u, outf.v, row_number() OVER (PARTITION BY cl.c ORDER BY outf.u, outf.v) AS k FROM outf JOIN cl ON cl.id = outf.u WHERE cl.c NOT IN (SELECT c FROM fr)) WHERE k = 1)"""


def _separate(spark, sf, scratch) -> Network:
    return t.identify_outfalls(_with_river(spark, sf), OutfallDerivation("separate", 40.0, 40.5), scratch)


@_("o5_separate_by_cluster", _CHOSEN + " SELECT u, v, u || '-' || v || '-outfall' AS id FROM pick", NFR, recursive=True)
def o5c(spark, sf):
    return _separate(spark, sf, Scratch(spark, "o5c")).edges.where("edge_type = 'outfall'").select("u", "v", "id")


@_("o7_topology_by_cluster", _CHOSEN + """, dt AS (SELECT u AS a, v AS b, length AS len FROM st UNION ALL SELECT dt.a, st.v, dt.len + st.length FROM dt JOIN st ON st.u = dt.b), hd AS (SELECT DISTINCT u FROM pick),
w AS (SELECT a AS id, b AS outfall, len FROM dt WHERE b IN (SELECT u FROM hd) UNION ALL SELECT u, u, 0 FROM hd)
SELECT id, outfall, len AS shortest_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len) AS k FROM w) WHERE k = 1""", NFR, recursive=True)
def o7c(spark, sf):
    scratch = Scratch(spark, "o7c")
    return t.derive_topology(_separate(spark, sf, scratch), scratch).nodes.select("id", "outfall", "shortest_path")


@_("o8_derive_topology_withtopo", None)
def o8(spark, sf):
    scratch = Scratch(spark, "o8")
    net = forest(spark, sf)
    # every root drains to the waste node over an outfall edge
    e = net.edges.select("u", "v", "key", F.col("length").alias("weight"), F.lit("street").alias("edge_type"))
    roots = net.nodes.join(e.select(F.col("u").alias("id")), "id", "left_anti")
    out = roots.select(F.col("id").alias("u"), F.lit(t.WASTE).alias("v"), F.lit(0).alias("key"), F.lit(0.0).alias("weight"), F.lit("outfall").alias("edge_type"))
    nodes = net.nodes.unionByName(spark.range(1).select(F.lit(t.WASTE).alias("id")), allowMissingColumns=True)
    return t.derive_topology(Network(nodes, e.union(out)), scratch, "withtopo").nodes.select("id", "outfall", "shortest_path")


ORACLES["o8_derive_topology_withtopo"] = ORACLES["p3_shortest_paths"].split(", c AS (")[0] + """, root AS (SELECT id FROM fx_nodes WHERE id NOT IN (SELECT u FROM fx_forest))
SELECT a AS id, b AS outfall, len AS shortest_path FROM dn WHERE b IN (SELECT id FROM root) UNION ALL SELECT id, id, 0 FROM root"""


@_("o9_negative_weights", " SELECT coalesce(min(length) < 0, false) AS negative FROM fx_edges", NE)
def o9(spark, sf):
    net = streets(spark, sf)
    return t.negative_weights(net.with_(edges=net.edges.withColumn("weight", F.col("length"))))


#: In a forest walked both ways every simple cycle is a pipe there and back.
@_("o9_negative_cycle", """, w AS (SELECT min(length) - 25 AS least FROM fx_forest) SELECT way_back, least + way_back < 0 AS negative FROM w, (VALUES (3.0::DOUBLE), (4.5::DOUBLE)) v(way_back)""", ("fx_forest",))
def o9_cycle(spark, sf):
    """Pipes cost their length less 25, the way back 3 or 4.5."""
    e = forest(spark, sf).edges.select("u", "v", (F.col("length") - 25).alias("weight"))
    net = lambda back: Network(None, e.union(e.select("v", "u", F.lit(back))))
    found = [(back, t.negative_cycle(net(back), Scratch(spark, "o9"))) for back in (3.0, 4.5)]
    return spark.createDataFrame(found, "way_back double, negative boolean")


@_("o10_total_weight", " SELECT sum(length) AS total_weight FROM fx_edges", NE)
def o10(spark, sf):
    net = streets(spark, sf)
    return t.total_weight(net.with_(edges=net.edges.withColumn("weight", F.col("length"))))


# --- design ---------------------------------------------------------------------------------------------

_PARAMS = HydraulicDesign()


@_("j11_design_grid", """, p AS (SELECT count(*) AS pipes, sum(length) AS length FROM fx_forest)
SELECT 0.15::DOUBLE + 2.85::DOUBLE * i / 38 AS diam, 0.5::DOUBLE + 4.5::DOUBLE * j / 9 AS depth, pipes, round(length * (0.45::DOUBLE + 2.85::DOUBLE * i / 38), 4) AS trench_area FROM range(39) a(i), range(10) b(j), p""", ("fx_forest",))
def j11(spark, sf):
    """What trenches of all pipes take up under each design."""
    pipes = forest(spark, sf).edges.agg(F.count(F.lit(1)).alias("pipes"), F.sum("length").alias("length"))  # one row
    return d.design_grid(spark, _PARAMS).crossJoin(F.broadcast(pipes)).select("diam", "depth", "pipes", F.round(F.col("length") * (F.col("diam") + 0.3), 4).alias("trench_area"))


@_("d1_design_flow", _UP + " SELECT id, round(total * 0.006 / 3600, 12) AS q FROM acc", NF, recursive=True)
def d1(spark, sf):
    net = forest(spark, sf)
    return d.design_flow(net.edges, net.nodes, 0.006, Scratch(spark, "d1")).withColumn("q", F.round("q", 12))


_CAND = """, cand AS (SELECT f.u, b.surface_elevation AS ds_elevation, a.surface_elevation - 0.5 AS floor, f.length, a.contributing_area * 0.006 / 3600 AS q, diam, depth
FROM fx_forest f JOIN fx_nodes a ON a.id = f.u JOIN fx_nodes b ON b.id = f.v, (SELECT 0.15::DOUBLE + 2.85::DOUBLE * i / 38 AS diam FROM range(39) g(i)), (SELECT 0.5::DOUBLE + 4.5::DOUBLE * j / 9 AS depth FROM range(10) h(j))),
e1 AS (SELECT *, floor - (ds_elevation - depth) AS diff FROM cand),
e2 AS (SELECT *, CASE WHEN diff > 0 THEN 0 ELSE (floor(-diff / 0.05) + 1) * 0.05 END AS surcharge_feasibility FROM e1),
e3 AS (SELECT *, diff / length AS slope, sqrt((diff + surcharge_feasibility) / length) * (diam / 4) ** (2.0::DOUBLE / 3) / 0.012 AS v, length * (diam + 0.3) * ((depth + floor) / 2 + 0.1) AS vol FROM e2),
e4 AS (SELECT *, q / (v * diam ** 2 * (pi() / 4)) AS fr, CASE WHEN vol >= 0 THEN 1.32 / 2000 * (9579.31 * diam ** 0.5737 + 1163.77 * vol ** 1.31) END AS cost_usd,
 greatest(0.75 - v, 0) + greatest(v - 5, 0) AS v_feasibility FROM e3), e5 AS (SELECT *, greatest(fr - 0.8, 0) AS fr_feasibility FROM e4)"""


def _pipes(spark, sf):
    """A row for each pipe, with all that its design depends on."""
    net = forest(spark, sf)
    n = net.nodes
    e = net.edges.join(n.select(F.col("id").alias("u"), (F.col("surface_elevation") - 0.5).alias("floor"), (F.col("contributing_area") * 0.006 / 3600).alias("q")), "u")
    return dealt(e.join(n.select(F.col("id").alias("v"), F.col("surface_elevation").alias("ds_elevation")), "v").select("u", "floor", "q", "ds_elevation", "length"))


def _candidates(spark, sf):
    return d.evaluate_design(_pipes(spark, sf).crossJoin(F.broadcast(d.design_grid(spark, _PARAMS))), _PARAMS)  # 390 designs a pipe


@_("d2_evaluate_design", _CAND + " SELECT u, round(diam, 6) AS diam, round(depth, 6) AS depth, round(slope, 6) AS slope, round(v, 6) AS v, round(fr, 6) AS fr, round(surcharge_feasibility, 6) AS surcharge, round(v_feasibility, 6) AS v_feasibility, round(fr_feasibility, 6) AS fr_feasibility FROM e5", NF)
def d2(spark, sf):
    r = lambda c, n=None: F.round(c, 6).alias(n or c)
    return _candidates(spark, sf).select("u", r("diam"), r("depth"), r("slope"), r("velocity", "v"), r("fr"), r("surcharge_feasibility", "surcharge"), r("v_feasibility"), r("fr_feasibility"))


@_("d3_pipe_cost", _CAND + " SELECT u, round(diam, 6) AS diam, round(depth, 6) AS depth, round(cost_usd, 4) AS cost_usd FROM e5", NF)
def d3(spark, sf):
    return _candidates(spark, sf).select("u", F.round("diam", 6).alias("diam"), F.round("depth", 6).alias("depth"), F.round("cost_usd", 4).alias("cost_usd"))


@_("d4_select_design", _CAND + """ SELECT u, round(diam, 6) AS diam, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY surcharge_feasibility, v_feasibility, fr_feasibility, depth, cost_usd, diam) AS k FROM e5 WHERE cost_usd IS NOT NULL) WHERE k = 1""", NF)
def d4(spark, sf):
    return d.choose_design(_pipes(spark, sf), _PARAMS, ["u"]).select("u", F.round("diam", 6).alias("diam"), F.round("depth", 6).alias("depth"))


@_("d5_pipe_by_pipe", None)
def d5(spark, sf):
    net = forest(spark, sf)
    return d.pipe_by_pipe(net, _PARAMS, Scratch(spark, "d5")).edges.select("u", "v", "diameter", F.round("cost_usd", 4).alias("cost_usd"))


_KS = """, q AS (SELECT round(value, 12) AS v, sum(x) AS a, sum(y) AS b FROM ({x} UNION ALL {y}) GROUP BY 1),
w AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM q) AS fa, sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM q) AS fb FROM q) SELECT round(max(abs(fa - fb)), 9) AS value FROM w"""


@_("m14_kstest_betweenness", _BT + ", val AS (SELECT up.id, above * below / ((n - 1) * (n - 2)) AS value FROM up JOIN below USING (id), c)" + _KS.format(x="SELECT value, 1 AS x, 0 AS y FROM val", y="SELECT value * 2, 0, 1 FROM val"), NF, recursive=True)
def m14(spark, sf):
    net = forest(spark, sf)
    every = net.edges.select(F.col("u").alias("id")).union(net.edges.select("v")).distinct()
    b = p.betweenness(net.edges, every, Scratch(spark, "m14"), "node")
    return metrics.ks_2samp(b, b.select((F.col("value") * 2).alias("value"))).select(F.round("value", 9).alias("value"))


@_("m14_kstest_edge_betweenness", _BT + ", val AS (SELECT (above + 1) * (below + 1) / (n * (n - 1)) AS value FROM fx_forest f JOIN up ON up.id = f.u JOIN below ON below.id = f.v, c)" + _KS.format(x="SELECT value, 1 AS x, 0 AS y FROM val", y="SELECT value * 2, 0, 1 FROM val"), NF, recursive=True)
def m14_edges(spark, sf):
    net, scratch = forest(spark, sf), Scratch(spark, "m14e")
    every = net.edges.select(F.col("u").alias("id")).union(net.edges.select("v")).distinct()
    b = scratch.table(p.betweenness(net.edges, every, scratch), "value")
    return metrics.ks_2samp(b, b.select((F.col("value") * 2).alias("value"))).select(F.round("value", 9).alias("value"))


assert math.isclose(_PARAMS.diameters[-1], 3.0)
