"""Joins over a network, cleaning of nodes and edges, and edge weights."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.functions.geometry import arms_deg, buffer_flat, interp1, segment_parts, segments, sum_over_delimiter
from urbanflow.model import Network, TopologyDerivation
from urbanflow.operators.components import components
from urbanflow.operators.paths import communities
from urbanflow.operators.spatial import pairs_within
from urbanflow.scratch import Scratch, dealt, large

EPS = sys.float_info.epsilon


# --- joins ----------------------------------------------------------------------------------------------


def with_endpoints(net: Network, cols: Sequence[str]) -> DataFrame:
    """Edges with the node columns of both ends, as ``<col>_u`` and ``<col>_v``."""
    out = net.edges
    for end in ("u", "v"):
        out = out.join(net.nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in cols)), end)
    return out


def edge_pairs(net: Network) -> DataFrame:
    """``u, v, key, w``: each edge with the head of every edge that leaves its own head, but not straight back."""
    then = net.edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return net.edges.join(then, "v").where("w <> u").select("u", "v", "key", "w")


def keep_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    return results.join(ids.select("id").distinct(), "id", "left_semi")


def sinks(net: Network) -> DataFrame:
    """Nodes that no edge leaves."""
    return net.nodes.join(net.edges.select(F.col("u").alias("id")), "id", "left_anti")


def subgraph(net: Network, ids: DataFrame) -> Network:
    """Nodes of ``ids`` and the edges among them."""
    own = ids.select("id").distinct()
    edges = net.edges.join(own.withColumnRenamed("id", "u"), "u", "left_semi").join(own.withColumnRenamed("id", "v"), "v", "left_semi")
    return net.with_(nodes=net.nodes.join(own, "id", "left_semi"), edges=edges.select(*net.edges.columns))


# --- cleaning -------------------------------------------------------------------------------------------


def _first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def assign_id(net: Network) -> Network:
    """``id = u-v``; of edges with one id the first stays."""
    return net.with_(edges=_first(net.edges.withColumn("id", F.concat_ws("-", "u", "v")), ["id"], ["key"]))


def remove_parallel_edges(net: Network, drop_longer_reverse: bool = False) -> Network:
    """The shortest edge of each (u, v); an edge and its reverse are no parallels unless asked for."""
    if "length" not in net.edges.columns:
        raise ValueError("remove_parallel_edges needs edge column length")
    edges = _first(net.edges, ["u", "v"], ["length", "key"])
    if drop_longer_reverse:
        pair = edges.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
        edges = _first(pair, ["_a", "_b"], ["length", "u"]).drop("_a", "_b")
    return net.with_(edges=edges)


def remove_non_pipe_allowable_links(net: Network, omit: Sequence[str]) -> Network:
    """Drop edges whose single ``highway`` is omitted, or with an omitted name as an attribute that is set."""
    edges, cols = net.edges, net.edges.columns
    is_list = dict(edges.dtypes)["highway"].startswith("array")
    kind = F.when(F.size("highway") == 1, F.col("highway")[0]) if is_list else F.col("highway")
    gone = F.coalesce(kind.isin(list(omit)), F.lit(False))
    for name in omit:
        if name in cols:
            gone = gone | F.coalesce(~F.lower(F.col(name).cast("string")).isin("", "false", "0"), F.lit(False))
    return net.with_(edges=edges.where(~gone))


def lane_count(lanes: Column, network_type: Column) -> Column:
    return F.when(network_type != "drive", 0.0).otherwise(F.coalesce(sum_over_delimiter(lanes), F.lit(1.0)))


def street_cover(net: Network, lane_width: float) -> DataFrame:
    """``u, v, key, lanes, rings``: flat-capped buffers of lanes x width to either side of each street."""
    ends = with_endpoints(net, ["x", "y"])
    if "geometry" not in ends.columns:
        p = lambda e: F.struct(F.col(f"x_{e}").alias("x"), F.col(f"y_{e}").alias("y"))
        ends = ends.withColumn("geometry", F.array(p("u"), p("v")))
    n = lane_count(F.col("lanes"), F.col("network_type"))
    return ends.withColumn("lanes", n).where("lanes > 0").select("u", "v", "key", "lanes", buffer_flat(F.col("geometry"), F.col("lanes") * lane_width).alias("rings"))


def double_directed(net: Network) -> Network:
    """Every street both ways: missing reverses are added, with reversed geometry and id ``<id>.reversed``."""
    edges = net.edges.where(F.col("id") == F.concat_ws("-", "u", "v"))
    back = edges.where("edge_type = 'street'").join(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    swap = {"u": F.col("v"), "v": F.col("u"), "id": F.concat("id", F.lit(".reversed"))}
    if "geometry" in edges.columns:
        swap["geometry"] = F.reverse("geometry")
    return net.with_(edges=edges.unionByName(back.withColumns(swap)))


def to_undirected(net: Network) -> Network:
    """One edge for each unordered pair and key; the later one's data wins."""
    edges = net.edges.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
    one = _first(edges, ["_a", "_b", "key"], [F.desc("u"), F.desc("v")])
    return net.with_(edges=one.withColumns({"u": F.col("_a"), "v": F.col("_b")}).drop("_a", "_b"), directed=False)


#: Decimals at which vertices of pieces are one.
_PLACES = 6


def split_long_edges(net: Network, longest: float) -> Network:
    """One edge for each piece of at most ``longest``; nodes are the distinct vertices, at six decimals.

    A node's id hashes its coordinates, so no global order is needed. Pieces can only coincide where segments
    lie on one line, so those of all other segments are cut without a shuffle.
    """
    scratch = Scratch(net.edges.sparkSession, "split").merged()
    near = lambda p: F.struct(*((F.round(p[c], _PLACES) + 0.0).alias(c) for c in "xy"))
    node = lambda p: F.hex(F.xxhash64(p["x"], p["y"]))
    whole = scratch.table(net.edges.withColumn("_e", F.explode(segments(F.col("geometry")))).withColumn("_sid", F.xxhash64("_e")), "segments")
    shared = scratch.table(_on_shared_lines(whole, longest), "shared")

    def cut(segs: DataFrame) -> DataFrame:
        a, b, i, n = F.col("_e.a"), F.col("_e.b"), F.col("_i"), F.col("_n")
        at = lambda i: near({c: F.when(i == n, b[c]).otherwise(a[c] + (b[c] - a[c]) * i / n) for c in "xy"})
        parts = segs.withColumn("_n", segment_parts(F.col("_e"), longest))  # plain expressions, as lambdas over arrays are interpreted
        pieces = dealt(parts).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_s", F.struct(at(i).alias("a"), at(i + 1).alias("b")))
        return pieces.withColumns({
            "u": node(F.col("_s.a")), "v": node(F.col("_s.b")), "geometry": F.array("_s.a", "_s.b"),
            "length": F.hypot(F.col("_s.b.x") - F.col("_s.a.x"), F.col("_s.b.y") - F.col("_s.a.y")),
        }).drop("_s", "_e", "_sid", "_n", "_i")

    once = _first(cut(whole.join(shared, "_sid", "left_semi").select(*whole.columns)), ["u", "v"], [F.desc("key")])
    edges = cut(whole.join(shared, "_sid", "left_anti").select(*whole.columns)).unionByName(once).withColumn("key", F.lit(0))
    ends = edges.select(F.explode("geometry").alias("p")).select(node(F.col("p")).alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    return net.with_(nodes=ends, edges=edges)


def _on_shared_lines(segs: DataFrame, longest: float) -> DataFrame:
    """``_sid`` of the segments (_e, _sid) that may have a piece in common with another, and more of them.

    Pieces of cut segments are longer than half of ``longest``, so where two are equal at ``_PLACES`` decimals, their
    segments differ little in direction and in distance from the origin. Both are counted in cells twice as wide as
    they may differ, and again half a cell on, so that two such segments share a cell. Shorter segments are all kept.
    """
    a, b = F.col("_e.a"), F.col("_e.b")
    most = segs.agg(F.max(F.greatest(*(F.abs(p[c]) for p in (a, b) for c in "xy")))).first()[0]  # one row
    if most is None or not math.isfinite(most):
        return segs.select("_sid").distinct()
    turn = (10.0 * 10**-_PLACES + 2e-14 * most) / longest  # by how much directions may differ
    around, wide = 2 * math.floor(math.pi / (4 * turn)), 4 * (most * turn + 10.0 * 10**-_PLACES)
    if around < 2:
        return segs.select("_sid").distinct()
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = F.hypot(dx, dy)
    long_ = segs.select("_sid", size.alias("_l"), F.atan2(dy, dx).alias("_t"), ((a["x"] * dy - a["y"] * dx) / F.nullif(size, F.lit(0.0))).alias("_d"))
    way = lambda half: F.pmod(F.floor(F.col("_t") * (around / (2 * math.pi)) + half), F.lit(around))
    off = lambda half: F.floor(F.col("_d") / wide + half)
    cells = F.array(*(F.xxhash64(F.lit(2 * i + j), way(i / 2), off(j / 2)) for i in (0, 1) for j in (0, 1)))
    short = F.coalesce(F.col("_l") <= longest * 0.51, F.lit(True))
    met = long_.where(~short).select("_sid", F.explode(cells).alias("_c"))
    many = met.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_c")
    return met.join(large(many), "_c", "left_semi").select("_sid").union(long_.where(short).select("_sid")).distinct()


def merge_points(points: DataFrame, r: float, scratch: Scratch) -> DataFrame:
    """``id, head, x, y`` of the points that merge: clusters by distance go to their mean and least id."""
    near = pairs_within(points, r).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    cluster = components(near, scratch, "merge")
    placed = points.select("id", "x", "y").join(cluster, "id")
    w = Window.partitionBy("component")
    return placed.select("id", F.col("component").alias("head"), F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))


def merge_street_nodes(net: Network, r: float, scratch: Scratch) -> Network:
    """Merge close street nodes; edge ends are relabelled and self loops go."""
    street = net.edges.where("edge_type = 'street'").select(F.explode(F.array("u", "v")).alias("id")).distinct()
    merged = scratch.table(merge_points(net.nodes.join(street, "id", "left_semi"), r, scratch), "merged")
    heads = merged.where("id = head").select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    gone = merged.where("id <> head").select("id")
    nodes = net.nodes.join(gone, "id", "left_anti").join(heads, "id", "left")
    nodes = nodes.withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).drop("_x", "_y")
    edges = net.edges
    for end in ("u", "v"):
        edges = edges.join(merged.select(F.col("id").alias(end), F.col("head").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return net.with_(nodes=nodes.select(*net.nodes.columns), edges=edges.where("u <> v").select(*net.edges.columns))


def fix_geometries(net: Network) -> Network:
    """Lines end at their nodes: reversed ones are turned, all other misfits become straight."""
    e = with_endpoints(net, ["x", "y"])
    p = lambda n: F.struct(F.col(f"x_{n}").alias("x"), F.col(f"y_{n}").alias("y"))
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    turned = (first == p("v")) & (last == p("u"))
    fits = (first == p("u")) & (last == p("v"))
    fixed = F.when(fits, F.col("geometry")).when(turned, F.reverse("geometry")).otherwise(F.array(p("u"), p("v")))
    return net.with_(edges=e.withColumn("geometry", fixed).select(*net.edges.columns))


def filter_streets(net: Network) -> Network:
    """Streets alone: heads of outfall edges and both ends of other non-street edges go, with their edges."""
    other = net.edges.where("edge_type <> 'street'")
    gone = other.select(F.explode(F.when(F.col("edge_type") == "outfall", F.array("v")).otherwise(F.array("u", "v"))).alias("id")).distinct()
    edges = net.edges.where("edge_type = 'street'")
    for end in ("u", "v"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return net.with_(nodes=net.nodes.join(gone, "id", "left_anti"), edges=edges.select(*net.edges.columns))


def points_by_type(net: Network) -> DataFrame:
    """``edge_type, id``: the end nodes of each kind of edge."""
    return net.edges.select("edge_type", F.explode(F.array("u", "v")).alias("id")).distinct()


def street_communities(net: Network, scratch: Scratch, weight: str = "length") -> DataFrame:
    """``id, community`` of every node by modularity of the street edges; a node without one is alone."""
    streets = net.edges
    if "edge_type" in streets.columns:
        streets = streets.where(F.coalesce("edge_type", F.lit("street")) == "street")
    label = communities(streets, scratch, weight)
    return net.nodes.select("id").join(label, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def clip_to_catchments(
    net: Network,
    basins: DataFrame,
    method: str = "subbasin",
    membership: float = 0.5,
    communities: DataFrame | None = None,
    scratch: Scratch | None = None,
) -> Network:
    """Cut edges between catchments. ``basins`` is (id, basin), ``communities`` (id, community).

    ``subbasin`` drops edges whose ends don't lie in one basin; no basin is never the same basin.
    ``community``: where at most ``membership`` of a community lies in a basin, the edges (key 0, either
    way round) between any node of the community and the basin's nodes outside it are cut. Communities are
    those of the streets unless others are given. The product of node sets is never made: edges join the
    labels of both ends, and the community of one end with the basin of the other joins the weak pairs.
    """
    if method not in ("subbasin", "community"):
        raise ValueError("method must be subbasin or community")
    own = basins
    if method == "community":
        if communities is None:
            scratch = scratch or Scratch(net.nodes.sparkSession, "clip")
            communities = scratch.table(street_communities(net, scratch), "street-communities")
        own = basins.join(communities, "id", "full")
    edges = net.edges
    for end in ("u", "v"):
        cols = [F.col(c).alias(f"_{c}_{end}") for c in own.columns if c != "id"]
        edges = edges.join(own.select(F.col("id").alias(end), *cols), end, "left")
    if method == "subbasin":
        return net.with_(edges=edges.where(F.coalesce(F.col("_basin_u") == F.col("_basin_v"), F.lit(False))).select(*net.edges.columns))
    counted = own.groupBy("community", F.coalesce("basin", F.lit(-1)).alias("basin")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("community").agg(F.sum("n").alias("_size"))
    weak = counted.join(sizes, "community").where(F.col("n") / F.col("_size") <= membership)
    edges = edges.withColumns({f"_b_{end}": F.coalesce(f"_basin_{end}", F.lit(-1)) for end in "uv"})
    for end, other in ("uv", "vu"):
        pair = weak.select(F.col("community").alias(f"_community_{end}"), F.col("basin").alias(f"_b_{other}"), F.lit(True).alias(f"_weak_{end}"))
        edges = edges.join(pair, [f"_community_{end}", f"_b_{other}"], "left")
    cut = (F.col("_community_u") != F.col("_community_v")) & (F.col("_weak_u").isNotNull() | F.col("_weak_v").isNotNull()) & (F.col("key") == 0)
    return net.with_(edges=edges.where(~F.coalesce(cut, F.lit(False))).select(*net.edges.columns))


# --- weights --------------------------------------------------------------------------------------------


def set_surface_slope(net: Network) -> Network:
    e = with_endpoints(net, ["surface_elevation"])
    slope = (F.col("surface_elevation_u") - F.col("surface_elevation_v")) / F.col("length")
    return net.with_(edges=e.withColumn("surface_slope", slope).select(*net.edges.columns, "surface_slope"))


def set_chahinian_slope(net: Network) -> Network:
    w = interp1(F.col("surface_slope") * 100, [-1, 0.3, 0.7, 10], [1, 0, 0, 1], 1, 1)
    return net.with_(edges=net.edges.withColumn("chahinian_slope", w))


def set_chahinian_angle(net: Network) -> Network:
    """Least angle weight over the edges that follow; an edge without one gets 0.

    Places are joined to the edges, and lengths taken there. Edges meet at their common node, where an edge's pairs are reduced to its
    least weight at once, so edges are shuffled, never pairs.
    """
    placed = net.edges.select("u", "v", "key")
    for end in ("u", "v"):
        placed = placed.join(large(net.nodes.select(F.col("id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))), end)
    # seen from the common node: where an edge comes from, and where the next one goes
    def arm(a: str, o: str, n: str) -> list[Column]:
        x, y = (F.col(f"{c}_{a}") - F.col(f"{c}_{o}") for c in "xy")
        return [x.alias(f"{n}x"), y.alias(f"{n}y"), F.hypot(x, y).alias(f"{n}l")]

    then = placed.select(F.col("u").alias("v"), F.col("v").alias("w"), *arm("v", "u", "b"))
    pairs = placed.select("u", "v", "key", *arm("u", "v", "a")).join(large(then), "v").where("w <> u")
    pairs = pairs.select("u", "v", "key", arms_deg(*(F.col(c) for c in ("ax", "ay", "bx", "by")), F.col("al") * F.col("bl")).alias("angle"))
    weight = interp1(F.col("angle"), [0, 90, 135, 180, 225, 270, 360], [1, 0.2, 0.7, 0, 0.7, 0.2, 1])
    least = pairs.groupBy("u", "v", "key").agg(F.min(weight).alias("chahinian_angle"))
    return net.with_(edges=net.edges.join(large(least), ["u", "v", "key"], "left").withColumn("chahinian_angle", F.coalesce("chahinian_angle", F.lit(0.0))))


def calculate_weights(net: Network, params: TopologyDerivation) -> Network:
    """Sum of scaled powers of the attributes, each normalised by its range; constants are left out."""
    bounds = net.edges.agg(*(f(c).alias(f"_{n}_{c}") for c in params.weights for n, f in (("lo", F.min), ("hi", F.max))))
    total = F.lit(0.0)
    for c in params.weights:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        part = F.greatest((F.col(c) - lo) / (hi - lo), F.lit(EPS)) ** params.exponent.get(c, 1.0) * params.scaling.get(c, 1.0)
        total = total + F.when(lo == hi, 0.0).otherwise(part)
    weighted = net.edges.crossJoin(F.broadcast(bounds)).withColumn("weight", total)  # one row
    return net.with_(edges=weighted.select(*net.edges.columns, "weight"))
