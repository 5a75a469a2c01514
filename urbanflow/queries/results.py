"""Queries of result series, coefficients and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanflow.fixtures import view
from urbanflow.functions.geometry import box_ring
from urbanflow.model import Network
from urbanflow.operators import metrics as m
from urbanflow.operators import series as s
from urbanflow.queries.base import Area, forest
from urbanflow.scratch import Scratch

_ = Area()
QUERIES, ORACLES = _.queries, _.oracles
R = ("fx_results",)
RN = ("fx_results", "fx_nodes")


def _parts(spark, sf):
    r = view(spark, sf, "fx_results")
    return r.where("part = 'syn'").drop("part"), r.where("part = 'real'").drop("part")


@_("t1_apply_warmup", """, b AS (SELECT epoch_us(min(date)) AS a, epoch_us(max(date)) AS b FROM fx_results WHERE part = 'syn')
SELECT id, variable, date, value FROM fx_results, b WHERE part = 'syn' AND epoch_us(date) >= b.a + (b.b - b.a) * 0.3""", R)
def t1(spark, sf):
    return s.apply_warmup(_parts(spark, sf)[0], 0.3)


@_("t2_extract_var", """SELECT id, date, value, epoch(date) - (SELECT min(epoch(date)) FROM fx_results WHERE part = 'real' AND variable = 'click') AS duration
FROM fx_results WHERE part = 'real' AND variable = 'click'""", R)
def t2(spark, sf):
    return s.extract_var(_parts(spark, sf)[1], "click").select("id", "date", "value", "duration")


_TRAP = """, d AS (SELECT id, value, epoch(date) AS t, part FROM fx_results WHERE variable = 'view'),
st AS (SELECT part, id, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS s FROM d WINDOW w AS (PARTITION BY part, id ORDER BY t, value)),
tr AS (SELECT part, id, coalesce(sum(s), 0.0) AS integral FROM st GROUP BY part, id)"""


@_("t3_trapezoid", _TRAP + " SELECT id, round(integral, 4) AS integral FROM tr WHERE part = 'syn'", R)
def t3(spark, sf):
    return s.trapezoid_by(s.extract_var(_parts(spark, sf)[0], "view")).select("id", F.round("integral", 4).alias("integral"))


def _fill(cte: str, keys: str) -> str:
    """CTE ``f``: gaps of ``s`` filled by row position in the groups of ``cte`` (keys, date, s, r)."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f""", n AS (SELECT *, row_number() OVER ({part} ORDER BY date) AS k FROM {cte}),
g AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN k END IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk,
 last_value(s IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
 first_value(CASE WHEN s IS NOT NULL THEN k END IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nk,
 first_value(s IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM n),
f AS (SELECT * EXCLUDE s, CASE WHEN s IS NOT NULL THEN s WHEN nk IS NULL THEN pv WHEN pk IS NOT NULL THEN pv + (nv - pv) * (k - pk) / (nk - pk) END AS s FROM g)"""


_T4 = ", x AS (SELECT DISTINCT id, date FROM fx_results), y AS (SELECT id, date, avg(value) AS s FROM fx_results WHERE variable = 'click' GROUP BY id, date), z AS (SELECT x.id, x.date, y.s FROM x LEFT JOIN y USING (id, date))"


@_("t4_interpolate", _T4 + _fill("z", "id") + " SELECT id, date, round(s, 6) AS value FROM f", R)
def t4(spark, sf):
    r = view(spark, sf, "fx_results")
    y = r.where("variable = 'click'").groupBy("id", "date").agg(F.avg("value").alias("value"))
    gaps = r.select("id", "date").distinct().join(y, ["id", "date"], "left")
    return s.interpolate_by(gaps, ["id"], "date", "value").withColumn("value", F.round("value", 6))


_T5 = """, a AS (SELECT date, sum(value) AS s FROM fx_results WHERE part = 'syn' AND variable = 'click' AND id IN (SELECT id FROM fx_nodes) GROUP BY date),
b AS (SELECT date, sum(value) AS r FROM fx_results WHERE part = 'real' AND variable = 'click' AND id IN (SELECT id FROM fx_nodes) GROUP BY date),
j AS (SELECT date, s, r FROM a FULL JOIN b USING (date))"""


def _t5(spark, sf):
    syn, real = _parts(spark, sf)
    n = view(spark, sf, "fx_nodes")
    return s.align_by_id(syn, real, "click", n, n)


@_("t5_align_by_id", _T5 + _fill("j", "") + " SELECT date, round(s, 6) AS value_syn, round(r, 6) AS value_real FROM f WHERE r IS NOT NULL", RN)
def t5(spark, sf):
    return _t5(spark, sf).select("date", F.round("value_syn", 6).alias("value_syn"), F.round("value_real", 6).alias("value_real"))


_T6 = """, pl AS (SELECT n.id, b.sub_id FROM fx_nodes n JOIN fx_boxes b ON n.x > b.xmin AND n.x < b.xmax AND n.y > b.ymin AND n.y < b.ymax),
v AS (SELECT r.part, pl.sub_id, r.date, sum(r.value) AS value FROM fx_results r JOIN pl USING (id) WHERE variable = 'view' GROUP BY ALL),
j AS (SELECT coalesce(a.sub_id, b.sub_id) AS sub_id, coalesce(a.date, b.date) AS date, a.value AS s, b.value AS r
FROM (SELECT * FROM v WHERE part = 'syn') a FULL JOIN (SELECT * FROM v WHERE part = 'real') b ON a.sub_id = b.sub_id AND a.date = b.date)"""
RNB = ("fx_results", "fx_nodes", "fx_boxes")


def _boxes(spark, sf):
    return view(spark, sf, "fx_boxes").select("sub_id", box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("ring"))


def _t6(spark, sf):
    n = view(spark, sf, "fx_nodes")
    return s.align_by_shape("view", *_parts(spark, sf), n, n, _boxes(spark, sf), 100.0)


@_("t6_align_by_shape", _T6 + _fill("j", "sub_id") + " SELECT sub_id, date, round(s, 6) AS value_syn, round(r, 6) AS value_real FROM f WHERE r IS NOT NULL", RNB)
def t6(spark, sf):
    return _t6(spark, sf).select("sub_id", "date", F.round("value_syn", 6).alias("value_syn"), F.round("value_real", 6).alias("value_real"))


@_("t7_thin_results", """, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM fx_results WHERE variable IN ('click', 'view')
 AND epoch(date) <= (SELECT min(epoch(date)) FROM fx_results WHERE variable IN ('click', 'view')) + 864000))
SELECT id, variable, date, value FROM fx_results JOIN d USING (date) WHERE variable IN ('click', 'view') AND k % 3 = 1""", R)
def t7(spark, sf):
    return s.thin_results(view(spark, sf, "fx_results").drop("part"), 3, 864000, ["click", "view"])


_COEF = {
    "relerror": "CASE WHEN avg(r) = 0 THEN 'inf'::DOUBLE ELSE (avg(s) - avg(r)) / avg(r) END",
    "nse": "CASE WHEN stddev_pop(r) = 0 THEN 'inf'::DOUBLE ELSE 1 - sum((r - s) ** 2) / (var_pop(r) * count(r)) END",
    "kge": "CASE WHEN stddev_pop(r) = 0 OR avg(r) = 0 THEN 'inf'::DOUBLE ELSE 1 - sqrt((CASE WHEN stddev_pop(s) = 0 THEN 0 ELSE corr(r, s) END - 1) ** 2 + (stddev_pop(s) / stddev_pop(r) - 1) ** 2 + (avg(s) / avg(r) - 1) ** 2) END",
}


def _coefficients():
    for k, (name, sql) in enumerate(_COEF.items(), 1):

        @_(f"m{k}_{name}", _T5 + _fill("j", "") + f" SELECT round({sql}, 6) AS value FROM f WHERE r IS NOT NULL AND s IS NOT NULL", RN)
        def one(spark, sf, name=name):
            whole = _t5(spark, sf).where("value_syn is not null")
            return m.coef_of(whole, m.COEFFICIENTS[name]).select(F.round("value", 6).alias("value"))

        @_(f"m7_subcatchment_{name}", _T6 + _fill("j", "sub_id") + f", c AS (SELECT sub_id, {sql} AS c FROM f WHERE r IS NOT NULL GROUP BY sub_id) SELECT round(median(c), 6) AS value FROM c WHERE isfinite(c)", RNB)
        def by_sub(spark, sf, name=name):
            n = view(spark, sf, "fx_nodes")
            run = m.metric_factory(f"subcatchment_{name}_flooding")
            return run(*_parts(spark, sf), n, n, _boxes(spark, sf), 100.0, variable="view").select(F.round("value", 6).alias("value"))

        @_("grid_nse_flooding" if name == "nse" else f"m8_grid_{name}", _T8 + _fill("j", "sub_id") + f", c AS (SELECT sub_id, {sql} AS c FROM f WHERE r IS NOT NULL GROUP BY sub_id) SELECT round(median(c), 6) AS value FROM c WHERE isfinite(c)", ("fx_results", "fx_nodes"))
        def by_cell(spark, sf, name=name):
            run = m.metric_factory(f"grid_{name}_flooding")
            return run(*_parts(spark, sf), view(spark, sf, "fx_nodes"), 400.0, -30.0, -30.0, variable="view").select(F.round("value", 6).alias("value"))


_T8 = """, pl AS (SELECT id, CAST(floor((x + 30) / 400) AS BIGINT) || '_' || CAST(floor((y + 30) / 400) AS BIGINT) AS sub_id FROM fx_nodes WHERE (x + 30) / 400 <> floor((x + 30) / 400) AND (y + 30) / 400 <> floor((y + 30) / 400)),
v AS (SELECT r.part, pl.sub_id, r.date, sum(r.value) AS value FROM fx_results r JOIN pl USING (id) WHERE variable = 'view' GROUP BY ALL),
j AS (SELECT coalesce(a.sub_id, b.sub_id) AS sub_id, coalesce(a.date, b.date) AS date, a.value AS s, b.value AS r
FROM (SELECT * FROM v WHERE part = 'syn') a FULL JOIN (SELECT * FROM v WHERE part = 'real') b ON a.sub_id = b.sub_id AND a.date = b.date)"""
_coefficients()


@_("m4_median_by_group", _T6 + _fill("j", "sub_id") + f", c AS (SELECT sub_id, {_COEF['relerror']} AS c FROM f WHERE r IS NOT NULL GROUP BY sub_id) SELECT round(median(c), 6) AS value FROM c WHERE isfinite(c)", RNB)
def m4(spark, sf):
    return m.median_coef_by_group(_t6(spark, sf), "sub_id", m.relerror).select(F.round("value", 6).alias("value"))


def _drained(spark, sf):
    """The forest with each node's outfall: the top bits of its number."""
    net = forest(spark, sf)
    k = F.col("id").cast("long")
    out = F.when(k > 0, F.conv(F.substring(F.bin(k), 1, 4), 2, 10))
    e = net.edges.withColumn("id", F.concat_ws("-", "u", "v"))
    return Network(net.nodes.withColumn("outfall", out), e)


_DRAIN = """, dn AS (SELECT *, CASE WHEN CAST(id AS BIGINT) > 0 THEN CAST(CASE WHEN CAST(id AS BIGINT) >= 8 THEN CAST(id AS BIGINT) >> CAST(floor(log2(CAST(id AS BIGINT))) - 3 AS INT) ELSE CAST(id AS BIGINT) END AS STRING) END AS outfall FROM fx_nodes),
best AS (SELECT outfall FROM dn JOIN fx_boxes b ON x > xmin AND x < xmax AND y > ymin AND y < ymax WHERE outfall IS NOT NULL GROUP BY outfall ORDER BY count(*) DESC, outfall LIMIT 1),
own AS (SELECT dn.* FROM dn JOIN best USING (outfall))"""
NFB = ("fx_nodes", "fx_forest", "fx_boxes")


@_("m5_best_outfall", _DRAIN + " SELECT id, outfall FROM own", NFB)
def m5(spark, sf):
    return m.best_outfall_network(_drained(spark, sf), _boxes(spark, sf), 100.0).nodes.select("id", "outfall")


@_("m6_dominant_outfall", """, fl AS (SELECT CAST(p_partkey AS STRING) AS id, CAST(p_size AS DOUBLE) AS value FROM part),
s AS (SELECT id FROM fx_nodes WHERE id NOT IN (SELECT u FROM fx_forest)),
b AS (SELECT f.v AS id FROM fx_forest f JOIN s ON s.id = f.v JOIN fl ON fl.id = f.u GROUP BY f.v ORDER BY median(fl.value) DESC, f.v LIMIT 1),
up AS (SELECT id FROM b UNION SELECT f.u FROM up JOIN fx_forest f ON f.v = up.id) SELECT id FROM up""", NFB, recursive=True)
def m6(spark, sf):
    net = forest(spark, sf)
    net = net.with_(edges=net.edges.withColumn("id", F.col("u")))
    flow = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.lit("flow").alias("variable"), F.col("p_size").cast("double").alias("value"))
    return m.dominant_outfall(net, flow, Scratch(spark, "m6"))[0].nodes.select("id")


_MEASURES = {
    "length": "sum(length)",
    "npipes": "CAST(count(*) AS DOUBLE)",
    "diameter": "avg(diameter)",
}


def _outfall_measures():
    for name, sql in _MEASURES.items():

        @_(f"m9_outfall_{name}", _DRAIN + f""", o AS (SELECT f.* FROM fx_forest f WHERE f.u IN (SELECT id FROM own) AND f.v IN (SELECT id FROM own)),
q AS (SELECT (SELECT {sql} FROM fx_forest) AS s, (SELECT {sql} FROM o) AS r) SELECT round((s - r) / r, 6) AS value FROM q""", NFB)
        def one(spark, sf, name=name):
            net = _drained(spark, sf)
            best = m.best_outfall_network(net, _boxes(spark, sf), 100.0)
            return m.metric_factory(f"outfall_relerror_{name}")(net, best).select(F.round("value", 6).alias("value"))


_outfall_measures()


@_("m9_outfall_nmanholes", _DRAIN + ", q AS (SELECT (SELECT count(*) FROM dn) AS s, (SELECT count(*) FROM own) AS r) SELECT round((s - r) / r, 6) AS value FROM q", NFB)
def m9n(spark, sf):
    net = _drained(spark, sf)
    return m.metric_factory("outfall_relerror_nmanholes")(net, m.best_outfall_network(net, _boxes(spark, sf), 100.0)).select(F.round("value", 6).alias("value"))


_M9F = _DRAIN + """, a AS (SELECT date, sum(value) AS s FROM fx_results WHERE part = 'syn' AND variable = 'view' AND id IN (SELECT id FROM dn) GROUP BY date),
b AS (SELECT date, sum(value) AS r FROM fx_results WHERE part = 'real' AND variable = 'view' AND id IN (SELECT id FROM own) GROUP BY date),
j AS (SELECT date, s, r FROM a FULL JOIN b USING (date))"""


def _outfall_series():
    for name, sql in _COEF.items():

        @_(f"m9_outfall_{name}_flooding", _M9F + _fill("j", "") + f" SELECT round({sql}, 5) AS value FROM f WHERE r IS NOT NULL AND s IS NOT NULL", (*RNB, "fx_forest"))
        def one(spark, sf, name=name):
            net = _drained(spark, sf)
            best = m.best_outfall_network(net, _boxes(spark, sf), 100.0)
            syn, real = (r.withColumn("variable", F.when(F.col("variable") == "view", "flooding").otherwise("-")) for r in _parts(spark, sf))
            return m.metric_factory(f"outfall_{name}_flooding")(net, best, syn, real).select(F.round("value", 5).alias("value"))


_outfall_series()

_M9E = _DRAIN + """, oe AS (SELECT f.u FROM fx_forest f WHERE f.u IN (SELECT id FROM own) AND f.v IN (SELECT id FROM own) AND f.v NOT IN (SELECT u FROM fx_forest WHERE u IN (SELECT id FROM own) AND v IN (SELECT id FROM own))),
se AS (SELECT u FROM fx_forest WHERE v NOT IN (SELECT u FROM fx_forest)),
a AS (SELECT date, sum(value) AS s FROM fx_results WHERE part = 'syn' AND variable = 'view' AND id IN (SELECT u FROM se) GROUP BY date),
b AS (SELECT date, sum(value) AS r FROM fx_results WHERE part = 'real' AND variable = 'view' AND id IN (SELECT u FROM oe) GROUP BY date),
j AS (SELECT date, s, r FROM a FULL JOIN b USING (date))"""


def _outfall_flows():
    """Flow of the pipes into the sinks; a pipe's series is that of its upper node."""
    for name, sql in _COEF.items():

        @_(f"m9_outfall_{name}_flow", _M9E + _fill("j", "") + f" SELECT coalesce(round({sql}, 5), 'inf'::DOUBLE) AS value FROM f WHERE r IS NOT NULL AND s IS NOT NULL", (*RNB, "fx_forest"))
        def one(spark, sf, name=name):
            net = _drained(spark, sf)
            net = net.with_(edges=net.edges.withColumn("id", F.col("u")))
            best = m.best_outfall_network(net, _boxes(spark, sf), 100.0)
            syn, real = (r.withColumn("variable", F.when(F.col("variable") == "view", "flow").otherwise("-")) for r in _parts(spark, sf))
            return m.metric_factory(f"outfall_{name}_flow")(net, best, syn, real).select(F.round("value", 5).alias("value"))


_outfall_flows()


@_("m12_bias_flood_depth", _TRAP + """, t AS (SELECT part, sum(integral) AS i FROM tr GROUP BY part), ar AS (SELECT sum(contributing_area) AS a FROM fx_nodes)
SELECT round(((SELECT i FROM t WHERE part = 'syn') / a - (SELECT i FROM t WHERE part = 'real') / (a * 2)) / ((SELECT i FROM t WHERE part = 'real') / (a * 2)), 6) AS value FROM ar""", ("fx_results", "fx_nodes"))
def m12(spark, sf):
    subs = view(spark, sf, "fx_nodes").select(F.col("contributing_area").alias("impervious_area"))
    return m.bias_flood_depth(*_parts(spark, sf), subs, subs.select((F.col("impervious_area") * 2).alias("impervious_area")), "view").select(F.round("value", 6).alias("value"))


@_("m13_ks_2samp", """, c AS (SELECT round(value, 12) AS v, sum(CASE WHEN part = 'syn' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN part = 'real' THEN 1 ELSE 0 END) AS b FROM fx_results GROUP BY 1),
w AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM c) AS fa, sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM c) AS fb FROM c) SELECT round(max(abs(fa - fb)), 9) AS value FROM w""", R)
def m13(spark, sf):
    return m.ks_2samp(*_parts(spark, sf)).select(F.round("value", 9).alias("value"))


@_("m15_outfall_kstest_diameters", _DRAIN + """, o AS (SELECT f.diameter AS value FROM fx_forest f WHERE f.u IN (SELECT id FROM own) AND f.v IN (SELECT id FROM own)),
c AS (SELECT round(value, 12) AS v, sum(x) AS a, sum(y) AS b FROM (SELECT diameter AS value, 1 AS x, 0 AS y FROM fx_forest UNION ALL SELECT value, 0, 1 FROM o) GROUP BY 1),
w AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM c) AS fa, sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM c) AS fb FROM c) SELECT round(max(abs(fa - fb)), 9) AS value FROM w""", NFB)
def m15(spark, sf):
    net = _drained(spark, sf)
    best = m.best_outfall_network(net, _boxes(spark, sf), 100.0)
    return m.ks_2samp(net.edges, best.edges, "diameter").select(F.round("value", 9).alias("value"))


@_("m16_run_metrics", _T5 + _fill("j", "") + f" SELECT 'relerror' AS metric, round({_COEF['relerror']}, 6) AS value FROM f WHERE r IS NOT NULL AND s IS NOT NULL UNION ALL SELECT 'nse', round({_COEF['nse']}, 6) FROM f WHERE r IS NOT NULL AND s IS NOT NULL", RN)
def m16(spark, sf):
    whole = _t5(spark, sf).where("value_syn is not null")
    plans = {n: (lambda n=n: m.coef_of(whole, m.COEFFICIENTS[n])) for n in m.COEFFICIENTS}
    return m.run_metrics(plans, ["relerror", "nse"]).withColumn("value", F.round("value", 6))
