"""Terrain and catchments on cell tables ``(r, c, z)``; a missing cell is a missing row."""

from __future__ import annotations

import itertools
import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.functions.geometry import from_utm, point_in_ring, ring_bbox, segmentize, within_buffer
from urbanflow.model import GridSpec, Network
from urbanflow.operators.components import components
from urbanflow.operators.paths import ends_of
from urbanflow.scratch import Scratch, large

# Flow codes, the step of each in rows and columns, and its length in cells.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))


def _neighbours(cells: DataFrame, cols: list[str]) -> DataFrame:
    """``r, c`` and each neighbour's columns as ``n_<col>``, with the code of the step to it."""
    steps = F.array(*(F.struct(F.lit(k).alias("d8"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, dr, dc in D8))
    near = cells.select("r", "c", *(F.col(x).alias(f"n_{x}") for x in cols), F.explode(steps).alias("s"))
    # a cell at the far end of step s is the neighbour of the cell s away from it, seen backwards
    return large(near.select((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.d8").alias("d8"), *(f"n_{x}" for x in cols)))


def _dist(d8: Column) -> Column:
    return F.when(d8.isin(1, 4, 16, 64), 1.0).otherwise(2**0.5)


def line_cells(lines: DataFrame, spec: GridSpec, line: str = "line") -> DataFrame:
    """Distinct ``r, c`` that lines pass, sampled at half a cell."""
    p = lines.select(F.explode(segmentize(F.col(line), min(spec.dx, spec.dy) / 2)).alias("p"))
    at = p.select(F.floor((F.col("p.y") - spec.y0) / spec.dy).cast("int").alias("r"), F.floor((F.col("p.x") - spec.x0) / spec.dx).cast("int").alias("c"))
    return at.distinct()


def burn(cells: DataFrame, marked: DataFrame, depth: float) -> DataFrame:
    """Lower marked cells by ``depth``, once however many lines cross."""
    own = marked.select("r", "c").distinct().withColumn("_m", F.lit(True))
    return cells.join(large(own), ["r", "c"], "left").withColumn("z", F.col("z") - F.when(F.col("_m"), depth).otherwise(0.0)).drop("_m")


#: Name of all that drains over the rim; it sorts before every cell's name.
OUT = "!"


def fill_pits(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Depressionless surface: each cell at the height over which its water gets to the rim; rim cells drain.

    Every cell belongs to the pit that the way down leads to, or to the rim. Neighbouring basins are joined
    by their lowest pass, and on that small graph each round lets every basin that doesn't drain yet flow
    over its lowest pass, basins that meet becoming one. A cell stands as high as the highest such pass of
    its basin, or itself. Ways double and basins at least halve, so rounds grow with logarithms alone.
    """
    cells = cells.select("r", "c", "z")
    near = _neighbours(cells, ["z", "r", "c"]).join(cells, ["r", "c"])
    low = near.groupBy("r", "c", "z").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("n_z", "n_r", "n_c")).alias("m"))
    down = (F.col("n") == 8) & (F.col("m") < F.struct(F.col("z").alias("n_z"), F.col("r").alias("n_r"), F.col("c").alias("n_c")))
    at = cells.join(large(low.drop("z")), ["r", "c"], "left")
    at = scratch.table(at.select("r", "c", "z", (F.coalesce("n", F.lit(0)) < 8).alias("rim"), F.when(down, F.col("m.n_r")).alias("to_r"), F.when(down, F.col("m.n_c")).alias("to_c")), "fill-ways")
    ends = basins(at.select("r", "c", "to_r", "to_c"), None, scratch)
    rim = at.where("rim").select(_key().alias("basin"), F.lit(OUT).alias("out"))
    lake = ends.join(large(rim), "basin", "left").select("r", "c", F.coalesce("out", "basin").alias("basin")).join(large(cells), ["r", "c"])
    lake = scratch.table(lake, "fill-lakes")
    beside = lake.join(_neighbours(lake, ["z", "basin"]), ["r", "c"]).where("basin < n_basin")
    passes = scratch.table(beside.groupBy(F.col("basin").alias("u"), F.col("n_basin").alias("v")).agg(F.min(F.greatest("z", "n_z")).alias("h")), "fill-passes")
    start = lake.where(F.col("basin") != OUT).select(F.col("basin").alias("id")).distinct()
    label = scratch.table(start.select("id", F.col("id").alias("lake"), F.lit(float("-inf")).alias("level")), "fill-0")
    for k in itertools.count(1):
        open_ = label.where(F.col("lake") != OUT)
        if open_.isEmpty():
            break
        for end in "uv":  # names of what the pits have become
            own = label.select(F.col("id").alias(end), F.col("lake").alias(f"_{end}"))
            passes = passes.join(large(own), end, "left").withColumn(f"l{end}", F.coalesce(f"_{end}", F.lit(OUT))).drop(f"_{end}")
        across = passes.where("lu <> lv")
        both = across.select(F.col("lu").alias("lake"), F.struct("h", "u", "v", F.col("lv").alias("to")).alias("e")).union(across.select("lv", F.struct("h", "u", "v", F.col("lu").alias("to"))))
        least = scratch.table(both.where(F.col("lake") != OUT).groupBy("lake").agg(F.min("e").alias("e")).select("lake", "e.h", "e.to"), f"fill-least-{k}")
        passes = scratch.table(across.groupBy("u", "v").agg(F.min("h").alias("h")), f"fill-passes-{k}")
        # where two flow into each other the lesser name stays
        back = least.select(F.col("lake").alias("to"), F.col("to").alias("back"))
        way = least.join(large(back), "to", "left").select("lake", F.when((F.col("back") == F.col("lake")) & (F.col("lake") < F.col("to")), F.lit(None)).otherwise(F.col("to")).alias("to"))
        roots = ends_of(way.select(F.col("lake").alias("id"), "to"), scratch, f"fill-merge-{k}")
        new = label.join(large(least.select("lake", "h")), "lake", "left").join(large(roots.select(F.col("id").alias("lake"), F.col("end").alias("root"))), "lake", "left")
        label = scratch.table(new.select("id", F.coalesce("root", "lake").alias("lake"), F.greatest("level", F.coalesce("h", "level")).alias("level")), f"fill-{k}")
    return lake.join(large(label.select(F.col("id").alias("basin"), "level")), "basin", "left").select("r", "c", F.greatest("z", "level").alias("z"))


def d8(cells: DataFrame) -> DataFrame:
    """``r, c, d8, to_r, to_c``: steepest way down (ties: least code); cells without one have none."""
    pairs = cells.join(_neighbours(cells, ["z"]), ["r", "c"]).withColumn("drop", (F.col("z") - F.col("n_z")) / _dist(F.col("d8")))
    best = pairs.where("drop > 0").groupBy("r", "c").agg(F.min(F.struct((-F.col("drop")).alias("s"), "d8")).alias("m")).select("r", "c", F.col("m.d8").alias("d8"))
    step = lambda i: F.element_at(F.create_map(*(F.lit(x) for k in D8 for x in (k[0], k[i]))), F.col("d8"))
    return cells.select("r", "c").join(large(best), ["r", "c"], "left").select("r", "c", "d8", (F.col("r") + step(1)).alias("to_r"), (F.col("c") + step(2)).alias("to_c"))


def recode_d8(flow: DataFrame, codes: dict[int, int]) -> DataFrame:
    """Codes of another encoding to these."""
    return flow.withColumn("d8", F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.col("d8")])


def cell_slope(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``r, c, slope`` of cells with all eight neighbours, by Horn's weights."""
    near = _neighbours(cells, ["z"])
    wx = {1: 2, 2: 1, 128: 1, 16: -2, 8: -1, 32: -1}
    wy = {4: 2, 2: 1, 8: 1, 64: -2, 32: -1, 128: -1}
    part = lambda w: F.sum(F.col("n_z") * F.coalesce(F.create_map(*(F.lit(float(x)) if i % 2 else F.lit(x) for kv in w.items() for i, x in enumerate(kv)))[F.col("d8")], F.lit(0.0)))
    g = near.groupBy("r", "c").agg(part(wx).alias("gx"), part(wy).alias("gy"), F.count(F.lit(1)).alias("n")).where("n = 8")
    return g.join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", F.hypot(F.col("gx") / (8 * dx), F.col("gy") / (8 * dy)).alias("slope"))


def _key(r: str = "r", c: str = "c") -> Column:
    return F.concat_ws("_", r, c)


def basins(flow: DataFrame, outlets: DataFrame | None, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """``r, c, basin``: the first outlet downstream of each cell (or the cell where the way ends).

    Pointers double: after k rounds each cell knows the cell 2^k steps on, stopping at outlets.
    ``outlets`` is (r, c, basin); cells whose way ends outside any outlet get no basin then.
    """
    f = flow.select(_key().alias("id"), F.when(F.col("to_r").isNotNull(), _key("to_r", "to_c")).alias("to"), "r", "c")
    known = f.select("id").withColumnRenamed("id", "to")
    f = f.join(large(known.withColumn("_k", F.lit(1))), "to", "left").withColumn("to", F.when(F.col("_k") == 1, F.col("to"))).drop("_k")
    if outlets is None:
        stop = f.where("to is null").select("id", F.col("id").alias("basin"))
    else:
        stop = outlets.select(_key().alias("id"), "basin").groupBy("id").agg(F.min("basin").alias("basin"))
    f = f.join(large(stop), "id", "left")
    now = scratch.table(f.select("id", "r", "c", "basin", F.when(F.col("basin").isNull(), F.col("to")).alias("to")), "basin-0")
    for k in range(1, rounds + 1):
        far = now.select(F.col("id").alias("to"), F.col("basin").alias("_b"), F.col("to").alias("_t"))
        now = scratch.table(now.join(large(far), "to", "left").select("id", "r", "c", F.coalesce("basin", "_b").alias("basin"), F.col("_t").alias("to")), f"basin-{k}")
        if now.where("to is not null").isEmpty():
            return now.select("r", "c", "basin")
    raise RuntimeError("flow runs in a circle")


def stream_order(flow: DataFrame, scratch: Scratch) -> DataFrame:
    """``r, c, strahler``: headwaters 1; where two of the highest order meet, one more.

    Streams are pruned: the cells of order k are those below no confluence once all lesser orders are
    gone. Which cells lie below a confluence is told by doubling pointers, and orders are at most the
    logarithm of the headwaters, so a long stream takes few rounds.
    """
    f = flow.select(_key().alias("id"), F.when(F.col("to_r").isNotNull(), _key("to_r", "to_c")).alias("to"), "r", "c")
    known = f.select(F.col("id").alias("to"), F.lit(True).alias("_k"))
    left = scratch.table(f.join(large(known), "to", "left").select("id", "r", "c", F.when(F.col("_k"), F.col("to")).alias("to")), "so-0")
    out = None
    for k in itertools.count(1):
        meet = left.where("to is not null").groupBy("to").count().where("count > 1").select(F.col("to").alias("id"), F.lit(True).alias("below"))
        marked = scratch.table(left.join(large(meet), "id", "left").select("id", "r", "c", "to", F.coalesce("below", F.lit(False)).alias("below")), f"so-meet-{k}")
        if marked.where("below").isEmpty():
            last = left.select("r", "c", F.lit(k).alias("strahler"))
            return last if out is None else out.union(last)
        kept = _below(marked, scratch, f"so-{k}")
        own = marked.drop("below").join(large(kept), "id")
        own = scratch.table(own, f"so-left-{k}")
        gone = own.where("not below").select("r", "c", F.lit(k).alias("strahler"))
        out = gone if out is None else out.union(gone)
        left = own.where("below").drop("below")


def _below(marked: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, below``: whether an id is marked or lies on the way (id, to) from one that is."""
    now, longest = marked.select("id", "to", "below"), math.ceil(math.log2(max(2, marked.count()))) + 1
    for k in itertools.count(1):
        given = now.where("below and to is not null").groupBy(F.col("to").alias("id")).agg(F.lit(True).alias("_g"))
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_t"))
        now = now.join(large(given), "id", "left").join(large(far), "to", "left").select("id", F.col("_t").alias("to"), (F.col("below") | F.coalesce("_g", F.lit(False))).alias("below"))
        now = scratch.table(now, f"{name}-{k}")
        if now.where("to is not null").isEmpty():
            return now.select("id", "below")
        if k > longest:
            raise ValueError("flow runs in a circle")


def subbasins(flow: DataFrame, min_order: int, scratch: Scratch) -> DataFrame:
    """Basins of the cells where segments of at least ``min_order`` end; without any, whole basins."""
    order = scratch.table(stream_order(flow, scratch).where(F.col("strahler") >= min_order), "so-high")
    if order.isEmpty():
        warnings.warn(f"no stream of order {min_order} or more: whole basins are taken instead", stacklevel=2)
        return basins(flow, None, scratch)
    on = flow.join(large(order), ["r", "c"]).select("r", "c", "strahler", "to_r", "to_c")
    below = order.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("strahler").alias("_o"))
    ends = on.join(large(below), ["to_r", "to_c"], "left").where(F.col("_o").isNull() | (F.col("_o") > F.col("strahler")))
    return basins(flow, ends.select("r", "c", _key().alias("basin")), scratch)


def regions(cells: DataFrame, scratch: Scratch, value: str = "value") -> DataFrame:
    """``r, c, value, region``: 8-connected parts of equal value; a region is named by its least cell."""
    own = cells.select("r", "c", value)
    near = own.join(_neighbours(own, [value]), ["r", "c"]).where(F.col(value) == F.col(f"n_{value}"))
    step = lambda i: F.element_at(F.create_map(*(F.lit(x) for k in D8 for x in (k[0], k[i]))), F.col("d8"))
    edges = near.select(_key().alias("u"), F.concat_ws("_", F.col("r") + step(1), F.col("c") + step(2)).alias("v"))
    found = components(edges, scratch, "regions")
    return own.withColumn("id", _key()).join(large(found), "id", "left").select("r", "c", value, F.coalesce("component", "id").alias("region"))


def cover(polys: DataFrame, spec: GridSpec, id: str = "id", ring: str = "ring") -> DataFrame:
    """``id, r, c``: cells whose centre lies inside the ring."""
    b = polys.select(id, ring, ring_bbox(F.col(ring)).alias("b"))
    rows = F.sequence(F.floor((F.col("b.ymin") - spec.y0) / spec.dy).cast("int"), F.floor((F.col("b.ymax") - spec.y0) / spec.dy).cast("int"))
    cols = F.sequence(F.floor((F.col("b.xmin") - spec.x0) / spec.dx).cast("int"), F.floor((F.col("b.xmax") - spec.x0) / spec.dx).cast("int"))
    at = b.select(id, ring, F.explode(rows).alias("r"), cols.alias("_c")).select(id, ring, "r", F.explode("_c").alias("c"))
    x, y = (F.col("c") + 0.5) * spec.dx + spec.x0, (F.col("r") + 0.5) * spec.dy + spec.y0
    return at.where(point_in_ring(x, y, F.col(ring))).select(id, "r", "c")


def buffer_cover(lines: DataFrame, spec: GridSpec, width: str, id: str = "id", line: str = "line") -> DataFrame:
    """``id, r, c``: cells whose centre lies in the flat-capped buffer of a line."""
    b = lines.select(id, line, width, ring_bbox(F.col(line)).alias("b"))
    w = F.col(width)
    rows = F.sequence(F.floor((F.col("b.ymin") - w - spec.y0) / spec.dy).cast("int"), F.floor((F.col("b.ymax") + w - spec.y0) / spec.dy).cast("int"))
    cols = F.sequence(F.floor((F.col("b.xmin") - w - spec.x0) / spec.dx).cast("int"), F.floor((F.col("b.xmax") + w - spec.x0) / spec.dx).cast("int"))
    at = b.select(id, line, width, F.explode(rows).alias("r"), cols.alias("_c")).select(id, line, width, "r", F.explode("_c").alias("c"))
    x, y = (F.col("c") + 0.5) * spec.dx + spec.x0, (F.col("r") + 0.5) * spec.dy + spec.y0
    return at.where(within_buffer(x, y, F.col(line), w)).select(id, "r", "c")


def node_cells(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    r, c = F.floor((F.col("y") - spec.y0) / spec.dy).cast("int"), F.floor((F.col("x") - spec.x0) / spec.dx).cast("int")
    return nodes.withColumns({"r": r, "c": c}).where(r.between(0, spec.rows - 1) & c.between(0, spec.cols - 1))


def delineate(flow: DataFrame, nodes: DataFrame, spec: GridSpec, scratch: Scratch) -> DataFrame:
    """``r, c, id``: the catchment of every node inside the grid; of nodes in one cell the least id."""
    out = node_cells(nodes, spec).select("r", "c", F.col("id").alias("basin"))
    return basins(flow, out, scratch).where("basin is not null").select("r", "c", F.col("basin").alias("id"))


def remove_overlaps(covers: DataFrame, id: str = "id") -> DataFrame:
    """A cell of several polygons stays with the smallest (ties: least id)."""
    area = covers.groupBy(id).agg(F.count(F.lit(1)).alias("_a"))
    w = Window.partitionBy("r", "c").orderBy("_a", id)
    return covers.join(large(area), id).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(id, "r", "c")


def attach_parts(parts: DataFrame, scratch: Scratch, id: str = "id") -> DataFrame:
    """Each id keeps its largest region; cells of the others go to the touching or nearest kept id.

    ``parts`` is (id, r, c). Nearest is by cell distance, searched in growing rings of buckets until no
    cell is left over: wherever a region was parted there is a kept one.
    """
    reg = scratch.table(regions(parts.withColumnRenamed(id, "value"), scratch), "parts")
    size = reg.groupBy("value", "region").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("value").orderBy(F.desc("n"), "region")
    ranked = size.withColumn("k", F.row_number().over(w)).select("region", "k")
    marked = scratch.table(reg.join(large(ranked), "region"), "marked")
    kept, loose = marked.where("k = 1").select(F.col("value").alias(id), "r", "c"), marked.where("k > 1").select("region", "r", "c")
    found, size_ = kept.select(id, "r", "c"), 2
    while not loose.isEmpty():
        steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        bucket = lambda df: df.withColumns({"br": F.floor(F.col("r") / size_), "bc": F.floor(F.col("c") / size_)})  # noqa: E731, B023
        a = bucket(loose).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumns({"br": F.col("br") + F.col("dr"), "bc": F.col("bc") + F.col("dc")})
        b = bucket(kept).select("br", "bc", F.col("r").alias("kr"), F.col("c").alias("kc"), id)
        dr, dc = ((F.col(m) - F.col(n)).cast("long") for m, n in (("r", "kr"), ("c", "kc")))
        dist = dr * dr + dc * dc  # whole numbers, so ties are ties
        near = a.join(large(b), ["br", "bc"]).where(dist <= size_ * size_).groupBy("region").agg(F.min(F.struct(dist.alias("d"), id)).alias("m")).select("region", F.col(f"m.{id}").alias(id))
        near = scratch.table(near, f"attach-{size_}")
        found = found.union(loose.join(large(near), "region").select(id, "r", "c"))
        loose = scratch.table(loose.join(large(near), "region", "left_anti"), f"loose-{size_}")
        size_ *= 2
    return found


def zonal_slope(covers: DataFrame, slope: DataFrame, id: str = "id") -> DataFrame:
    return covers.join(large(slope), ["r", "c"]).groupBy(id).agg(F.greatest(F.avg("slope"), F.lit(0.0)).alias("slope"))


def derive_subcatchments(cells: DataFrame, nodes: DataFrame, spec: GridSpec, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, area, slope, width)`` of every node's catchment, and its cells."""
    filled = scratch.table(fill_pits(cells, scratch), "filled")
    catch = delineate(d8(filled), nodes, spec, scratch)
    covers = scratch.table(attach_parts(catch, scratch), "subs")
    area = covers.groupBy("id").agg((F.count(F.lit(1)) * (spec.dx * spec.dy)).alias("area"))
    slope = zonal_slope(covers, cell_slope(filled, spec.dx, spec.dy))
    return area.join(large(slope), "id", "left").select("id", "area", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.sqrt(F.col("area") / 3.141592653589793).alias("width")), covers


def derive_rc(subs: DataFrame, impervious: DataFrame, cell_area: float) -> DataFrame:
    """``id, area, impervious_area, rc``: ``subs`` (id, r, c) and ``impervious`` (r, c) cells of buildings
    and streets together; cells covered twice count once."""
    hard = impervious.select("r", "c").distinct().withColumn("_i", F.lit(1))
    both = subs.join(large(hard), ["r", "c"], "left").groupBy("id").agg((F.count(F.lit(1)) * cell_area).alias("area"), (F.count("_i") * cell_area).alias("impervious_area"))
    return both.withColumn("rc", F.col("impervious_area") / F.col("area") * 100)


def contributing_area(net: Network, subs: DataFrame) -> Network:
    """Nodes get their catchment's impervious area (0 without one), edges that of their tail."""
    own = subs.select("id", F.col("impervious_area").alias("contributing_area"))
    nodes = net.nodes.drop("contributing_area").join(own, "id", "left").withColumn("contributing_area", F.coalesce("contributing_area", F.lit(0.0)))
    edges = net.edges.drop("contributing_area").join(nodes.select(F.col("id").alias("u"), "contributing_area"), "u")
    return net.with_(nodes=nodes, edges=edges)


def set_elevation(nodes: DataFrame, cells: DataFrame, spec: GridSpec, scratch: Scratch | None = None) -> DataFrame:
    """``surface_elevation`` by bilinear interpolation; grid points span the bounds from edge to edge.

    A node that misses one of its four points takes the nearest grid point that is there (ties: least row,
    then column), searched in growing rings of buckets among those nodes alone. No cells give nulls.
    """
    sx = (spec.cols - 1) / (spec.dx * spec.cols) if spec.cols > 1 else 0.0
    sy = (spec.rows - 1) / (spec.dy * spec.rows) if spec.rows > 1 else 0.0
    fx, fy = (F.col("x") - spec.x0) * sx, (F.col("y") - spec.y0) * sy
    n = nodes.withColumns({"_fx": fx, "_fy": fy})
    n = n.withColumns({"_c": F.least(F.floor("_fx"), F.lit(max(0, spec.cols - 2))).cast("int"), "_r": F.least(F.floor("_fy"), F.lit(max(0, spec.rows - 2))).cast("int")})
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    at = n.select("id", "_fx", "_fy", "_r", "_c", F.explode(corner).alias("k")).withColumns({"r": F.col("_r") + F.col("k.i"), "c": F.col("_c") + F.col("k.j")})
    tx, ty = F.col("_fx") - F.col("_c"), F.col("_fy") - F.col("_r")
    weight = F.when(F.col("k.j") == 1, tx).otherwise(1 - tx) * F.when(F.col("k.i") == 1, ty).otherwise(1 - ty)
    met = at.join(cells, ["r", "c"]).withColumn("_w", weight)
    z = met.groupBy("id").agg(F.sum(F.col("_w") * F.col("z")).alias("s"), F.count(F.lit(1)).alias("n")).where("n = 4").select("id", F.col("s").alias("surface_elevation"))
    scratch = scratch or Scratch(nodes.sparkSession, "elevation")
    found = scratch.table(z, "whole")
    open_ = scratch.table(n.select("id", "_fx", "_fy").join(found, "id", "left_anti"), "open")
    size_ = 2
    while not open_.isEmpty() and not cells.isEmpty():
        steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        at = open_.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
        at = at.withColumns({"br": F.floor(F.col("_fy") / size_) + F.col("dr"), "bc": F.floor(F.col("_fx") / size_) + F.col("dc")})
        near = at.join(cells.select(F.floor(F.col("r") / size_).alias("br"), F.floor(F.col("c") / size_).alias("bc"), "r", "c", "z"), ["br", "bc"])
        # in map units, as rows and columns may differ in size
        d = F.hypot((F.col("r") - F.col("_fy")) / (sy or 1.0), (F.col("c") - F.col("_fx")) / (sx or 1.0))
        within = size_ * min(1 / (sx or 1.0), 1 / (sy or 1.0))
        best = near.where(d <= within).groupBy("id").agg(F.min(F.struct(d.alias("d"), "r", "c", "z")).alias("m"))
        found = scratch.table(found.union(best.select("id", "m.z")), f"found-{size_}")
        open_ = scratch.table(open_.join(found, "id", "left_anti"), f"open-{size_}")
        size_ *= 2
    return nodes.drop("surface_elevation").join(found, "id", "left")


def reproject_cells(cells: DataFrame, source: GridSpec, target: GridSpec, zone: int, south: bool = False) -> DataFrame:
    """Cells of a geographic grid on a UTM grid: each target centre takes the source cell it falls in."""
    grid = cells.sparkSession.range(target.rows * target.cols).select((F.col("id") / target.cols).cast("int").alias("r"), (F.col("id") % target.cols).cast("int").alias("c"))
    x, y = (F.col("c") + 0.5) * target.dx + target.x0, (F.col("r") + 0.5) * target.dy + target.y0
    back = grid.withColumn("p", from_utm(x, y, F.lit(zone), F.lit(south)))
    at = back.select("r", "c", F.floor((F.col("p.lat") - source.y0) / source.dy).cast("int").alias("_r"), F.floor((F.col("p.lon") - source.x0) / source.dx).cast("int").alias("_c"))
    return at.join(cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "z"), ["_r", "_c"]).select("r", "c", "z")
