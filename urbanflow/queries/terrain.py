"""Queries of raster and catchment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.fixtures import view
from urbanflow.functions.geometry import EASTING, ECCENTRICITY, INVERSE, RADIUS, SCALE, box_ring
from urbanflow.model import GridSpec
from urbanflow.operators import raster as r
from urbanflow.queries.base import Area, forest
from urbanflow.scratch import Scratch

_ = Area()
QUERIES, ORACLES = _.queries, _.oracles
C = ("fx_cells",)


def _spec(spark, sf) -> GridSpec:
    rows = view(spark, sf, "fx_cells").agg(F.max("r")).first()[0] + 1  # one row
    return GridSpec(0.0, 0.0, 1.0, 1.0, rows, 50)


_LINES = "SELECT id, y / 50 AS y1, x / 50 AS x1, y / 50 + 2.5 AS y2, x / 50 + 1.5 AS x2 FROM fx_river"


def _lines(spark, sf):
    """A short line from every river point, in cells."""
    x, y = F.col("x") / 50, F.col("y") / 50
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return view(spark, sf, "fx_river").select("id", F.array(p(x, y), p(x + 1.5, y + 2.5)).alias("line"))


@_("r1_burn", f""", l AS ({_LINES}), q AS (SELECT *, CAST(ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5) AS INT) AS n FROM l), i AS (SELECT *, unnest(range(0, n + 1)) AS i FROM q),
m AS (SELECT DISTINCT CAST(floor(y1 + (y2 - y1) * i / n) AS INT) AS r, CAST(floor(x1 + (x2 - x1) * i / n) AS INT) AS c FROM i)
SELECT r, c, round(z - CASE WHEN (r, c) IN (SELECT (r, c) FROM m) THEN 2 ELSE 0 END, 6) AS z FROM fx_cells""", (*C, "fx_river"))
def r1(spark, sf):
    marked = r.line_cells(_lines(spark, sf), _spec(spark, sf))
    return r.burn(view(spark, sf, "fx_cells"), marked, 2.0).select("r", "c", F.round("z", 6).alias("z"))


_STEP = ", s(d8, dr, dc) AS (VALUES (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))"


@_("r2_fill_pits", _STEP + """, nb AS (SELECT a.r, a.c, a.z, b.r AS br, b.c AS bc, b.z AS bz FROM fx_cells a, s JOIN fx_cells b ON b.r = a.r + s.dr AND b.c = a.c + s.dc),
rim AS (SELECT r, c, z FROM fx_cells WHERE (r, c) NOT IN (SELECT (r, c) FROM nb GROUP BY r, c HAVING count(*) = 8)),
w(r, c, z) USING KEY (r, c) AS (SELECT r, c, z FROM rim UNION SELECT nb.br, nb.bc, min(greatest(nb.bz, w.z)) FROM w JOIN nb ON nb.r = w.r AND nb.c = w.c LEFT JOIN recurring.w AS old ON old.r = nb.br AND old.c = nb.bc
 WHERE old.z IS NULL OR greatest(nb.bz, w.z) < old.z GROUP BY nb.br, nb.bc) SELECT r, c, z FROM w""", C, recursive=True)
def r2(spark, sf):
    return r.fill_pits(view(spark, sf, "fx_cells"), Scratch(spark, "r2"))


_FLOW = _STEP + """, nb AS (SELECT a.r, a.c, s.d8, b.r AS to_r, b.c AS to_c, (a.z - b.z) / CASE WHEN dr = 0 OR dc = 0 THEN 1 ELSE sqrt(2) END AS drop FROM fx_cells a, s JOIN fx_cells b ON b.r = a.r + s.dr AND b.c = a.c + s.dc),
fl AS (SELECT k.r, k.c, q.d8, q.to_r, q.to_c FROM fx_cells k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY drop DESC, d8) AS n FROM nb WHERE drop > 0) q ON q.r = k.r AND q.c = k.c AND q.n = 1)"""


@_("r3_d8", _FLOW + " SELECT * FROM fl", C)
def r3(spark, sf):
    return r.d8(view(spark, sf, "fx_cells"))


@_("r3_recode", _FLOW + " SELECT r, c, CASE d8 WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 4 THEN 6 WHEN 8 THEN 5 WHEN 16 THEN 4 WHEN 32 THEN 3 WHEN 64 THEN 2 WHEN 128 THEN 1 END AS d8 FROM fl", C)
def r3r(spark, sf):
    return r.recode_d8(r.d8(view(spark, sf, "fx_cells")), {1: 0, 2: 7, 4: 6, 8: 5, 16: 4, 32: 3, 64: 2, 128: 1}).select("r", "c", "d8")


_SLOPE = _STEP + """, sl AS (SELECT a.r, a.c, sqrt((sum(b.z * CASE d8 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 128 THEN 1 WHEN 16 THEN -2 WHEN 8 THEN -1 WHEN 32 THEN -1 ELSE 0 END) / 8) ** 2
 + (sum(b.z * CASE d8 WHEN 4 THEN 2 WHEN 2 THEN 1 WHEN 8 THEN 1 WHEN 64 THEN -2 WHEN 32 THEN -1 WHEN 128 THEN -1 ELSE 0 END) / 8) ** 2) AS slope
FROM fx_cells a, s JOIN fx_cells b ON b.r = a.r + s.dr AND b.c = a.c + s.dc GROUP BY a.r, a.c HAVING count(*) = 8)"""


@_("r4_cell_slope", _SLOPE + " SELECT r, c, round(slope, 6) AS slope FROM sl", C)
def r4(spark, sf):
    return r.cell_slope(view(spark, sf, "fx_cells")).withColumn("slope", F.round("slope", 6))


_BASINS = _FLOW + """, w AS (SELECT r, c, r AS r0, c AS c0 FROM fl WHERE d8 IS NULL UNION ALL SELECT fl.r, fl.c, w.r0, w.c0 FROM w JOIN fl ON fl.to_r = w.r AND fl.to_c = w.c)"""


@_("r5_basins", _BASINS + " SELECT r, c, r0 || '_' || c0 AS basin FROM w", C, recursive=True)
def r5(spark, sf):
    return r.basins(r.d8(view(spark, sf, "fx_cells")), None, Scratch(spark, "r5"))


#: A cell is of order k + 1 or more where, at it or above it, two cells of order k or more meet.
_ORDER = _FLOW + """, e AS (SELECT r || '_' || c AS u, to_r || '_' || to_c AS v FROM fl WHERE to_r IS NOT NULL), dn AS (SELECT r || '_' || c AS a, r || '_' || c AS b FROM fl UNION ALL SELECT dn.a, e.v FROM dn JOIN e ON e.u = dn.b),
s1 AS (SELECT r || '_' || c AS id FROM fl)""" + "".join(
    f", j{k} AS (SELECT v FROM e JOIN s{k} ON s{k}.id = e.u GROUP BY v HAVING count(*) > 1), s{k + 1} AS (SELECT DISTINCT dn.b AS id FROM dn JOIN j{k} ON j{k}.v = dn.a)" for k in range(1, 9)
) + ", so AS (SELECT r, c, r || '_' || c AS id, " + " + ".join(["1", *(f"CASE WHEN r || '_' || c IN (SELECT id FROM s{k}) THEN 1 ELSE 0 END" for k in range(2, 10))]) + " AS strahler FROM fl)"


@_("r6_stream_order", _ORDER + " SELECT r, c, strahler FROM so", C, recursive=True)
def r6(spark, sf):
    return r.stream_order(r.d8(view(spark, sf, "fx_cells")), Scratch(spark, "r6"))


@_("r6_subbasins", _ORDER + """, hi AS (SELECT * FROM so WHERE strahler >= 2), o AS (SELECT hi.r, hi.c, hi.id FROM hi LEFT JOIN e ON e.u = hi.id LEFT JOIN hi b ON b.id = e.v WHERE b.id IS NULL OR b.strahler > hi.strahler),
w AS (SELECT r, c, id FROM o UNION ALL SELECT fl.r, fl.c, w.id FROM w JOIN fl ON fl.to_r = w.r AND fl.to_c = w.c AND (fl.r, fl.c) NOT IN (SELECT (r, c) FROM o)),
q AS (SELECT fl.r, fl.c, w.id FROM fl LEFT JOIN w USING (r, c)) SELECT r, c, id AS basin FROM q""", C, recursive=True)
def r6s(spark, sf):
    return r.subbasins(r.d8(view(spark, sf, "fx_cells")), 2, Scratch(spark, "r6s"))


_R7 = _STEP + """, v AS (SELECT r, c, CAST(z * 100 AS BIGINT) % 4 AS value FROM fx_cells), e AS (SELECT a.r || '_' || a.c AS u, b.r || '_' || b.c AS v FROM v a, s JOIN v b ON b.r = a.r + s.dr AND b.c = a.c + s.dc AND a.value = b.value),
w AS (SELECT u AS id, v AS o FROM e UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.o), m AS (SELECT id, min(o) AS o FROM w GROUP BY id),
rg AS (SELECT r, c, value, least(r || '_' || c, coalesce(o, r || '_' || c)) AS region FROM v LEFT JOIN m ON m.id = r || '_' || c)"""


@_("r7_regions", _R7 + " SELECT r, c, value, region FROM rg", C, recursive=True)
def r7(spark, sf):
    v = view(spark, sf, "fx_cells").select("r", "c", (F.expr("CAST(z * 100 AS BIGINT) % 4")).alias("value"))
    return r.regions(v, Scratch(spark, "r7"))


def _polys(spark, sf):
    b = view(spark, sf, "fx_boxes")
    k = [(F.col(c) / 50) for c in ("xmin", "ymin", "xmax", "ymax")]
    return b.select(F.col("sub_id").alias("id"), box_ring(*k).alias("ring"))


_COVER = ", cv AS (SELECT b.sub_id AS id, y AS r, x AS c FROM fx_boxes b, range(-10, 200) a(x), range(-10, 200) d(y) WHERE x + 0.5 > xmin / 50 AND x + 0.5 < xmax / 50 AND y + 0.5 > ymin / 50 AND y + 0.5 < ymax / 50)"
B = ("fx_boxes", "fx_cells")


@_("r8_cover", _COVER + " SELECT id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM cv", B)
def r8(spark, sf):
    return r.cover(_polys(spark, sf), _spec(spark, sf))


@_("r8_buffer_cover", f""", l AS ({_LINES}),
k AS (SELECT l.*, x + 0.5 AS px, y + 0.5 AS py, x, y FROM l, range(-5, 100) a(x), range(-5, 100) b(y))
SELECT id, CAST(y AS INT) AS r, CAST(x AS INT) AS c FROM k WHERE ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) BETWEEN 0 AND 1
AND abs((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)) <= 0.8 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)""", ("fx_river",))
def r8b(spark, sf):
    return r.buffer_cover(_lines(spark, sf).withColumn("w", F.lit(0.8)), _spec(spark, sf), "w")


_NODEC = ", nc AS (SELECT CAST(floor(y / 50) AS INT) AS r, CAST(floor(x / 50) AS INT) AS c, min(id) AS id FROM fx_nodes GROUP BY 1, 2)"


@_("r9_delineate", _FLOW + _NODEC + """, o AS (SELECT nc.* FROM nc JOIN fl ON fl.r = nc.r AND fl.c = nc.c), w AS (SELECT r, c, id FROM o UNION ALL SELECT fl.r, fl.c, w.id FROM w JOIN fl ON fl.to_r = w.r AND fl.to_c = w.c AND (fl.r, fl.c) NOT IN (SELECT (r, c) FROM o)) SELECT r, c, id FROM w""", ("fx_nodes", "fx_cells"), recursive=True)
def r9(spark, sf):
    n = view(spark, sf, "fx_nodes").withColumns({"x": F.col("x") / 50, "y": F.col("y") / 50})
    return r.delineate(r.d8(view(spark, sf, "fx_cells")), n, _spec(spark, sf), Scratch(spark, "r9"))


@_("r10_remove_overlaps", _COVER + ", ar AS (SELECT id, count(*) AS a FROM cv GROUP BY id) SELECT id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT cv.*, row_number() OVER (PARTITION BY r, c ORDER BY a, cv.id) AS k FROM cv JOIN ar USING (id)) WHERE k = 1", B)
def r10(spark, sf):
    return r.remove_overlaps(r.cover(_polys(spark, sf), _spec(spark, sf)))


@_("r11_attach_parts", _R7 + """, k AS (SELECT region, row_number() OVER (PARTITION BY value ORDER BY count(*) DESC, region) AS k FROM rg GROUP BY value, region),
p AS (SELECT r, c, CAST(value AS STRING) AS id, region, k FROM rg JOIN k USING (region)),
d AS (SELECT a.region, b.id, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM p a JOIN p b ON a.k > 1 AND b.k = 1 GROUP BY a.region, b.id),
n AS (SELECT region, id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY d, id) AS o FROM d) WHERE o = 1)
SELECT id, r, c FROM p WHERE k = 1 UNION ALL SELECT n.id, r, c FROM p JOIN n USING (region) WHERE k > 1""", C, recursive=True)
def r11(spark, sf):
    v = view(spark, sf, "fx_cells").select(F.expr("CAST(CAST(z * 100 AS BIGINT) % 4 AS STRING)").alias("id"), "r", "c")
    return r.attach_parts(v, Scratch(spark, "r11"))


@_("r12_zonal_slope", _SLOPE + _COVER + " SELECT id, round(greatest(avg(slope), 0), 6) AS slope FROM cv JOIN sl USING (r, c) GROUP BY id", B)
def r12(spark, sf):
    s = r.zonal_slope(r.cover(_polys(spark, sf), _spec(spark, sf)), r.cell_slope(view(spark, sf, "fx_cells")))
    return s.withColumn("slope", F.round("slope", 6))


@_("r13_derive_subcatchments", None)
def r13(spark, sf):
    n = view(spark, sf, "fx_nodes").withColumns({"x": F.col("x") / 50, "y": F.col("y") / 50})
    return r.derive_subcatchments(view(spark, sf, "fx_cells"), n, _spec(spark, sf), Scratch(spark, "r13"))[0]


_RC = _COVER + ", rc AS (SELECT cv.id, CAST(count(*) AS DOUBLE) AS area, CAST(count(h.r) AS DOUBLE) AS imp FROM cv LEFT JOIN (SELECT DISTINCT r, c FROM fx_cells WHERE z > 1000) h ON h.r = cv.r AND h.c = cv.c GROUP BY cv.id)"


@_("r14_derive_rc", _RC + " SELECT id, area, imp AS impervious_area, round(100 * imp / area, 6) AS rc FROM rc", B)
def r14(spark, sf):
    hard = view(spark, sf, "fx_cells").where("z > 1000")
    return r.derive_rc(r.cover(_polys(spark, sf), _spec(spark, sf)), hard.union(hard), 1.0).withColumn("rc", F.round("rc", 6))


@_("r15_contributing_area", _RC + " SELECT f.u, f.v, coalesce(imp, 0) AS contributing_area FROM fx_forest f LEFT JOIN rc ON rc.id = f.u", ("fx_boxes", "fx_cells", "fx_forest"))
def r15(spark, sf):
    rc = r.derive_rc(r.cover(_polys(spark, sf), _spec(spark, sf)), view(spark, sf, "fx_cells").where("z > 1000"), 1.0)
    return r.contributing_area(forest(spark, sf), rc).edges.select("u", "v", "contributing_area")


@_("w1_set_elevation", """, b AS (SELECT max(r) + 1 AS rows FROM fx_cells), n AS (SELECT id, (x / 101) * 49.0 / 50 AS fx, y / 50 * (rows - 1) / rows AS fy, rows FROM fx_nodes, b),
q AS (SELECT *, CAST(least(floor(fx), 48) AS INT) AS c, CAST(least(floor(fy), rows - 2) AS INT) AS r FROM n),
k AS (SELECT q.id, sum(z * (CASE WHEN cc.c = q.c THEN 1 - (fx - q.c) ELSE fx - q.c END) * (CASE WHEN cc.r = q.r THEN 1 - (fy - q.r) ELSE fy - q.r END)) AS z, count(*) AS n FROM q JOIN fx_cells cc ON cc.r IN (q.r, q.r + 1) AND cc.c IN (q.c, q.c + 1) GROUP BY q.id)
SELECT id, round(z, 5) AS surface_elevation FROM k""", ("fx_nodes", "fx_cells"))
def w1(spark, sf):
    n = view(spark, sf, "fx_nodes").withColumns({"x": F.col("x") / 101, "y": F.col("y") / 50})
    return r.set_elevation(n, view(spark, sf, "fx_cells"), _spec(spark, sf)).select("id", F.round("surface_elevation", 5).alias("surface_elevation"))


_G5 = f""", b AS (SELECT max(r) + 1 AS rows FROM fx_cells), g AS (SELECT t.r, q.c, ((q.c + 0.5) * 50 + 500000 - {EASTING}) / {SCALE * RADIUS!r} AS eta, ((t.r + 0.5) * 50 + 5649800) / {SCALE * RADIUS!r} AS xi FROM b, LATERAL (SELECT unnest(range(2 * rows)) AS r) t, range(80) q(c)),
k AS (SELECT r, c, eta - ({" + ".join(f"{f!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, f in enumerate(INVERSE, 1))}) AS e,
xi - ({" + ".join(f"{f!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, f in enumerate(INVERSE, 1))}) AS n FROM g),
s0 AS (SELECT r, c, degrees(atan2(sinh(e), cos(n))) - 3 AS lon, sin(n) / sqrt(sinh(e) ** 2 + cos(n) ** 2) AS t, t / sqrt(t * t + 1) AS s FROM k),
{", ".join(f"s{i} AS (SELECT r, c, lon, t, tanh(asinh(t) + atanh(s * {ECCENTRICITY!r}) * {ECCENTRICITY!r}) AS s FROM s{i - 1})" for i in range(1, 7))}
SELECT CAST(a.r AS INT) AS r, CAST(a.c AS INT) AS c, z FROM s6 a JOIN fx_cells f ON f.r = CAST(floor((degrees(asin(s)) - 51.0) / 0.001) AS INT) AND f.c = CAST(floor((lon + 3.0) / 0.001) AS INT)"""


@_("g5_reproject_cells", _G5, ("fx_cells",))
def g5(spark, sf):
    rows = _spec(spark, sf).rows
    source = GridSpec(-3.0, 51.0, 0.001, 0.001, rows, 50)
    return r.reproject_cells(view(spark, sf, "fx_cells"), source, GridSpec(500000.0, 5649800.0, 50.0, 50.0, 2 * rows, 80), 30)
