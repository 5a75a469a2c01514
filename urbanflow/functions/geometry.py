"""Coordinates and plane geometry as Column expressions.

Lines and rings are ``array<struct<x:double,y:double>>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.model import Network

# WGS84 and the transverse Mercator grid.
A, FLATTENING, SCALE, EASTING, SOUTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Row ``j`` holds the factors of n^j, n^(j+1), ..."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row, 1)) for j, row in enumerate(rows)]


# Factors of the six-term Krueger series, forward and inverse.
FORWARD = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """``EPSG:326zz`` north and ``EPSG:327zz`` south of the equator."""
    return F.format_string("EPSG:%d%02d", F.when(lat < 0, 327).otherwise(326), utm_zone(lon))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """struct(x, y): geographic degrees to metres of a UTM zone."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * ECCENTRICITY) * ECCENTRICITY)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(FORWARD, 1):
        east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
        north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
    return F.struct(
        (east * (SCALE * RADIUS) + EASTING).alias("x"),
        (north * (SCALE * RADIUS) + F.when(south, SOUTHING).otherwise(0.0)).alias("y"),
    )


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct(lon, lat): metres of a UTM zone to geographic degrees."""
    eta = (x - EASTING) / (SCALE * RADIUS)
    xi = (y - F.when(south, SOUTHING).otherwise(0.0)) / (SCALE * RADIUS)
    e, n = eta, xi
    for j, b in enumerate(INVERSE, 1):
        e = e - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
        n = n - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
    lam = F.atan2(F.sinh(e), F.cos(n))
    # the latitude's tangent from the conformal one, by fixed-point steps that converge in a few rounds
    conformal = F.sin(n) / F.sqrt(F.sinh(e) ** 2 + F.cos(n) ** 2)
    s = conformal / F.sqrt(conformal * conformal + 1)
    for _ in range(6):
        psi = F.asinh(conformal) + F.atanh(s * ECCENTRICITY) * ECCENTRICITY
        s = F.tanh(psi)
    return F.struct((F.degrees(lam) + zone * 6 - 183).alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def reproject_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """``x, y`` in the row's own UTM zone in place of the geographic columns."""
    at = to_utm(F.col(lon), F.col(lat), utm_zone(F.col(lon)), F.col(lat) < 0)
    return df.withColumn("_p", at).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", lon, lat)


def reproject_network(net: Network, zone: int, south: bool = False) -> Network:
    """Node coordinates and every vertex to UTM; edges without geometry get the straight line."""
    z, s = F.lit(zone), F.lit(south)
    moved = net.nodes.withColumn("_p", to_utm(F.col("x"), F.col("y"), z, s))
    nodes = moved.withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
    ends = nodes.select("id", F.struct("x", "y").alias("p"))
    edges = net.edges
    if "geometry" not in edges.columns:
        edges = edges.withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    edges = edges.join(ends.select(F.col("id").alias("u"), F.col("p").alias("_a")), "u").join(ends.select(F.col("id").alias("v"), F.col("p").alias("_b")), "v")
    line = F.transform("geometry", lambda p: to_utm(p["x"], p["y"], z, s))
    edges = edges.withColumn("geometry", F.coalesce(line, F.array("_a", "_b"))).drop("_a", "_b")
    return net.with_(nodes=nodes, edges=edges, crs=f"EPSG:{'327' if south else '326'}{zone:02d}")


def segments(line: Column) -> Column:
    """Array of struct(a, b): consecutive vertices."""
    n = F.size(line) - 1
    return F.when(
        n >= 1, F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def segment_parts(e: Column, longest: float) -> Column:
    """The fewest equal parts of a segment that are no longer than ``longest``."""
    return F.greatest(F.lit(1), F.ceil(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / longest)).cast("int")


def segmentized_size(line: Column, longest: float) -> Column:
    """How many vertices ``segmentize`` gives; none of them is made."""
    return F.aggregate(segments(line), F.least(F.size(line), F.lit(1)), lambda s, e: s + segment_parts(e, longest))


def segmentize(line: Column, longest: float) -> Column:
    """The line with each segment cut into the fewest equal parts no longer than ``longest``."""

    def cut(e: Column) -> Column:
        n = segment_parts(e, longest)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                (e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / n).alias("x"), (e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / n).alias("y")
            ),
        )

    return F.concat(F.flatten(F.transform(segments(line), cut)), F.slice(line, F.lit(-1), F.lit(1)))


def angle_deg(p1: Column, p2: Column, p3: Column) -> Column:
    """Angle at ``p2`` in [0, 180] degrees; an arm of no length gives infinity."""
    ax, ay, bx, by = p1["x"] - p2["x"], p1["y"] - p2["y"], p3["x"] - p2["x"], p3["y"] - p2["y"]
    return arms_deg(ax, ay, bx, by, F.hypot(ax, ay) * F.hypot(bx, by))


def arms_deg(ax: Column, ay: Column, bx: Column, by: Column, size: Column) -> Column:
    """Angle between two arms in [0, 180] degrees; ``size`` is the product of their lengths, infinity where that is 0."""
    cos = F.least(F.greatest((ax * bx + ay * by) / size, F.lit(-1.0)), F.lit(1.0))
    return F.when(size == 0, float("inf")).otherwise(F.degrees(F.acos(cos)))


def interp1(x: Column, xs: list[float], ys: list[float], left: float | None = None, right: float | None = None) -> Column:
    """Piecewise linear; beyond the ends ``left`` and ``right``, by default the end values."""
    out = F.when(x < xs[0], ys[0] if left is None else left)
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= b, F.lit(float(p)) + (x - a) * ((q - p) / (b - a)))
    return out.when(x.isNotNull(), float(ys[-1] if right is None else right))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: ray casting; points on the boundary are outside."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]))

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (
            (cross == 0)
            & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )

    edges = segments(ring)
    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
    return odd & ~F.exists(edges, touches)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    return F.abs(F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_width(ring: Column) -> Column:
    """Radius of the circle of the ring's area."""
    return F.sqrt(ring_area(ring) / math.pi)


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    def p(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(p(xmin, ymin), p(xmin, ymax), p(xmax, ymax), p(xmax, ymin), p(xmin, ymin))


def buffer_flat(line: Column, d: Column) -> Column:
    """Flat-capped cover of a line: for each segment of some length, a closed quad ``d`` to either side."""

    def quad(e: Column) -> Column:
        a, b = e["a"], e["b"]
        size = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        nx, ny = -(b["y"] - a["y"]) / size * d, (b["x"] - a["x"]) / size * d

        def p(q: Column, sign: int) -> Column:
            return F.struct((q["x"] + nx * sign).alias("x"), (q["y"] + ny * sign).alias("y"))

        return F.array(p(a, 1), p(b, 1), p(b, -1), p(a, -1), p(a, 1))

    real = F.filter(segments(line), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    return F.transform(real, quad)


def within_buffer(x: Column, y: Column, line: Column, d: Column) -> Column:
    """Whether a point lies in the flat-capped buffer: within ``d`` of a segment, beside it."""

    def beside(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy)
        return t.between(0, 1) & (F.abs((x - a["x"]) * dy - (y - a["y"]) * dx) <= d * F.hypot(dx, dy))

    return F.exists(segments(line), beside)


def ring_vertices(df: DataFrame, ring: str = "ring", id: str = "id") -> DataFrame:
    """Rows ``x, y, id, pos``: the vertices in order, the closing one repeated."""
    return df.select(id, F.posexplode(ring).alias("pos", "p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), id, "pos")


def create_grid(spark, bbox: tuple[float, float, float, float], scale: float | tuple[float, float]) -> DataFrame:
    """``sub_id, ring``: rectangles over ``bbox``; numbered along y within x; the last may overshoot."""
    dx, dy = scale if isinstance(scale, tuple) else (scale, scale)
    xmin, ymin, xmax, ymax = bbox
    nx, ny = (max(0, math.ceil((b - a) / s)) for a, b, s in ((xmin, xmax, dx), (ymin, ymax, dy)))
    i, j = F.floor(F.col("sub_id") / ny) if ny else F.lit(0), F.col("sub_id") % max(1, ny)
    x, y = i * dx + xmin, j * dy + ymin
    return spark.range(nx * ny).withColumnRenamed("id", "sub_id").withColumn("ring", box_ring(x, y, x + dx, y + dy))


def sum_over_delimiter(s: Column) -> Column:
    """Sum of the whole numbers in a text, whatever parts them."""
    numbers = F.filter(F.split(s.cast("string"), "\\D+"), lambda w: w != "")
    return F.when(s.isNotNull(), F.aggregate(numbers, F.lit(0.0), lambda t, w: t + w.cast("int")))
