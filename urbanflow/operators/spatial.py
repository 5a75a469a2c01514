"""Spatial joins by tile keys: every candidate pair meets in an equi-join, then an exact test decides.

A tile that holds too much is parted in four, and so are its heavy quarters. Rows are counted tile by tile
over all the input, and at most ``TILES`` tiles of a level can hold more than their share: that table is
broadcast, whatever the input's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geometry import point_in_ring, ring_bbox
from urbanflow.scratch import Scratch

FULL = 4096  # rows of a tile before it is parted
TILES = 65536  # bound on the parted tiles of a level
LEVELS = 20  # halvings of the first tile's sides


def _cell(c: Column, size: float, level: Column | None = None) -> Column:
    """Scaling by powers of two is exact, so a level's tiles nest in those of the level above."""
    q = c / size
    return F.floor(q if level is None else q * F.pow(F.lit(2.0), level)).cast("long")


def _tiled(points: DataFrame, size: float, level: Column | None = None) -> DataFrame:
    return points.withColumns({"_bx": _cell(F.col("x"), size, level), "_by": _cell(F.col("y"), size, level)})


def _heavy(points: DataFrame, size: float, full: int) -> tuple[DataFrame | None, int]:
    """``_bx, _by, _n`` of the tiles with more rows than the limit (None if there are none), and the limit."""
    counts = _tiled(points, size).groupBy("_bx", "_by").agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(full, math.ceil((total or 0) / TILES))
    return (counts.where(F.col("_n") > limit) if (most or 0) > limit else None), limit


def splits(points: DataFrame, size: float, scratch: Scratch, full: int = FULL) -> list[DataFrame]:
    """``_bx, _by``: the tiles of each level that are parted. Even density needs no level at all."""
    heavy, limit = _heavy(points, size, full)
    if heavy is None:
        return []
    out = [scratch.table(heavy.select("_bx", "_by"), "split")]
    crowded = _tiled(points, size).join(F.broadcast(out[0]), ["_bx", "_by"], "left_semi")
    fine = scratch.table(_tiled(crowded, size, F.lit(LEVELS)).groupBy("_bx", "_by").agg(F.count(F.lit(1)).alias("_n")), "fine")
    for k in range(1, LEVELS):
        up = fine.groupBy(*(F.shiftright(c, LEVELS - k).alias(c) for c in ("_bx", "_by"))).agg(F.sum("_n").alias("_n"))
        heavy = scratch.table(up.where(F.col("_n") > limit).select("_bx", "_by"), "split")
        if heavy.isEmpty():
            break
        out.append(heavy)
    return out


def place_points(points: DataFrame, size: float, parted: list[DataFrame]) -> DataFrame:
    """Points with ``_level, _bx, _by`` of the one tile that holds them and isn't parted."""
    at = points.withColumn("_level", F.lit(0))
    for k, tiles in enumerate(parted):
        at = _tiled(at, size, F.lit(k)).join(F.broadcast(tiles.withColumn("_in", F.lit(1))), ["_bx", "_by"], "left")
        at = at.withColumn("_level", F.col("_level") + F.coalesce("_in", F.lit(0))).drop("_in")
    return _tiled(at, size, F.col("_level"))


def place_boxes(boxes: DataFrame, size: float, parted: list[DataFrame]) -> DataFrame:
    """Boxes (``xmin, ymin, xmax, ymax``), once for each tile that they touch and that isn't parted."""
    at = boxes.withColumn("_level", F.lit(0))
    for own, low, high in (("_bx", "xmin", "xmax"), ("_by", "ymin", "ymax")):
        at = at.withColumn(own, F.explode(F.sequence(_cell(F.col(low), size), _cell(F.col(high), size))))
    for k, tiles in enumerate(parted):
        at = at.join(F.broadcast(tiles.withColumns({"_in": F.lit(True), "_level": F.lit(k)})), ["_level", "_bx", "_by"], "left")
        for own, low, high in (("_bx", "xmin", "xmax"), ("_by", "ymin", "ymax")):
            first = F.greatest(F.col(own) * 2, _cell(F.col(low), size, F.lit(k + 1)))
            last = F.least(F.col(own) * 2 + 1, _cell(F.col(high), size, F.lit(k + 1)))
            at = at.withColumn(own, F.explode(F.when(F.col("_in"), F.sequence(first, last)).otherwise(F.array(own))))
        at = at.withColumn("_level", F.col("_level") + F.when(F.col("_in"), 1).otherwise(0)).drop("_in")
    return at


def nodes_to_subs(
    nodes: DataFrame, polys: DataFrame, bucket: float, id: str = "sub_id", ring: str = "ring", how: str = "inner", full: int = FULL
) -> DataFrame:
    """Nodes with the ``id`` of each polygon they lie strictly inside; ``how='left'`` keeps the others.

    Distinct places meet boxes in tiles of at most ``bucket``; rings join the hits alone. Nodes without
    coordinates lie in no polygon, empty or null rings hold none, and a repeated polygon counts each time.
    """
    scratch = Scratch(nodes.sparkSession, "places")
    rings = polys.select(F.col(id).alias("_id"), F.col(ring).alias("_ring"), F.xxhash64(ring).alias("_key")).where("_ring is not null and _id is not null")
    rings = rings.groupBy("_id", "_key").agg(F.first("_ring").alias("_ring"), F.count(F.lit(1)).alias("_copies"))
    boxes = rings.select("_id", "_key", ring_bbox(F.col("_ring")).alias("_b")).select("_id", "_key", "_b.*")
    places = nodes.select("x", "y").where("x is not null and y is not null").distinct()
    middles = boxes.select(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y")).where("x is not null")
    parted = splits(places.union(middles), bucket, scratch, full)
    near = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    hits = place_points(places, bucket, parted).join(place_boxes(boxes, bucket, parted), ["_level", "_bx", "_by"]).where(near)
    inside = hits.select("x", "y", "_id", "_key").join(rings, ["_id", "_key"]).where(point_in_ring(F.col("x"), F.col("y"), F.col("_ring")))
    found = inside.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_id"), F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    own = nodes.select(F.struct("*").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return own.join(found, ["_x", "_y"], how).select("_n.*", F.col("_id").alias(id))


def classify(points: DataFrame, polys: DataFrame, bucket: float, id: str = "sub_id", ring: str = "ring") -> DataFrame:
    return nodes_to_subs(points, polys, bucket, id, ring, "left")


def _around(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Rows in the tiles at ``steps`` from their own, with the step."""
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    return df.withColumn("_s", at).withColumns({"_bx": F.col("_bx") + F.col("_s.i"), "_by": F.col("_by") + F.col("_s.j")})


_NINE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def nearest_within(a: DataFrame, b: DataFrame, r: float, full: int = FULL) -> DataFrame:
    """``id, near, dist``: for each point of ``a`` its nearest of ``b`` within ``r``; ties to the least id.

    Where tiles of ``r`` hold many places of ``b``, the search starts in tiles small enough and doubles
    them for the points that found none: what is found within a tile's side is the nearest.
    """
    scratch = Scratch(a.sparkSession, "nearest")
    places = b.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("near"))
    depth = len(splits(places, r, scratch, full))
    if depth:
        places = scratch.table(places, "places")
    own = a.select("id", "x", "y")
    done, rest = None, own
    for k in range(depth, -1, -1):
        side = r / 2**k
        left = _tiled(rest, side).select("id", F.col("x").alias("_ax"), F.col("y").alias("_ay"), "_bx", "_by")
        pairs = left.join(_around(_tiled(places, side), _NINE), ["_bx", "_by"])
        pairs = pairs.withColumn("dist", F.hypot(F.col("_ax") - F.col("x"), F.col("_ay") - F.col("y"))).where(F.col("dist") <= side)
        best = pairs.groupBy("id").agg(F.min(F.struct("dist", "near")).alias("m")).select("id", "m.near", "m.dist")
        if depth:
            best = scratch.table(best, "best")
        done = best if done is None else done.union(best)
        if k:
            rest = scratch.table(rest.join(best, "id", "left_anti"), "rest")
    return done


def pairs_within(points: DataFrame, r: float, full: int = FULL) -> DataFrame:
    """``id_a, id_b, dist``: pairs of points at most ``r`` apart, each once.

    A tile looks at itself and four of its neighbours; the rows of a crowded tile are dealt to parts.
    """
    tiled = _tiled(points.select("id", "x", "y"), r)
    own = tiled.select(F.col("id").alias("_a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), "_bx", "_by")
    other = _around(tiled, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
    keys, (heavy, limit) = ["_bx", "_by"], _heavy(points, r, full)
    if heavy is not None:
        parts = F.broadcast(heavy.select("_bx", "_by", F.ceil(F.col("_n") / limit).alias("_parts")))
        own = own.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64("_a"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        other = other.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        keys = [*keys, "_part"]
    # in one tile a pair meets both ways round, elsewhere once
    once = (F.col("_a") < F.col("id")) | ((F.col("_a") != F.col("id")) & ((F.col("_s.i") != 0) | (F.col("_s.j") != 0)))
    met = own.join(other, keys).where(once).withColumn("dist", F.hypot(F.col("_ax") - F.col("x"), F.col("_ay") - F.col("y"))).where(F.col("dist") <= r)
    return met.select(F.least("_a", "id").alias("id_a"), F.greatest("_a", "id").alias("id_b"), "dist")
