"""Outfalls and the drainage topology that leads to them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.model import Network, OutfallDerivation
from urbanflow.operators.components import components
from urbanflow.operators.network import filter_streets, sinks
from urbanflow.operators.paths import ends_of, greedy_in_tree, min_spanning_forest, reach, shortest_paths
from urbanflow.operators.spatial import nearest_within
from urbanflow.scratch import Scratch

WASTE = "waste"


def pair_rivers(net: Network, buffer: float, outfall_length: float, scratch: Scratch) -> Network:
    """Outfall edges from street nodes to their nearest river node within ``buffer``.

    A weakly connected component with streets but no pair drains from its lowest node (ties: least id)
    to a dummy river node beside it.
    """
    scratch = scratch.merged()
    kinds = net.edges.select("edge_type", F.explode(F.array("u", "v")).alias("id")).distinct()
    street = net.nodes.join(kinds.where("edge_type = 'street'"), "id", "left_semi")
    river = net.nodes.join(kinds.where("edge_type = 'river'"), "id", "left_semi")
    pairs = scratch.table(nearest_within(street, river, buffer).select(F.col("id").alias("u"), F.col("near").alias("v")), "pairs")
    member = scratch.table(components(net.edges, scratch, "pair"), "members")
    dry = member.join(street.select("id"), "id", "left_semi").select("component").distinct()
    wet = pairs.select(F.col("u").alias("id")).join(member, "id").select("component").distinct()
    lost = member.join(dry.join(wet, "component", "left_anti"), "component")
    low = lost.join(net.nodes, "id").groupBy("component").agg(F.min(F.struct("surface_elevation", "id", "x", "y")).alias("m"))
    dummy = scratch.table(low.select(F.col("m.id").alias("u"), F.concat("m.id", F.lit("-dummy_river")).alias("v"), (F.col("m.x") + 1).alias("x"), (F.col("m.y") + 1).alias("y")), "dummies")
    nodes = net.nodes.unionByName(dummy.select(F.col("v").alias("id"), "x", "y"), allowMissingColumns=True)
    both = pairs.union(dummy.select("u", "v"))
    new = both.select(
        "u", "v", F.lit(0).alias("key"), F.lit(outfall_length).alias("length"), F.lit(outfall_length).alias("weight"),
        F.lit("outfall").alias("edge_type"), F.concat_ws("-", "u", "v", F.lit("outfall")).alias("id"),
    )
    return net.with_(nodes=nodes, edges=net.edges.unionByName(new, allowMissingColumns=True))


def river_weights(net: Network) -> Network:
    """River edges cost nothing."""
    free = {c: F.when(F.col("edge_type") == "river", 0.0).otherwise(F.col(c)) for c in ("length", "weight")}
    return net.with_(edges=net.edges.withColumns(free))


def root_nodes(net: Network) -> Network:
    """Every sink gets a free edge to the node ``waste``."""
    out = sinks(net).select(
        F.col("id").alias("u"), F.lit(WASTE).alias("v"), F.lit(0).alias("key"), F.lit(0.0).alias("length"), F.lit(0.0).alias("weight"),
        F.lit("waste-outfall").alias("edge_type"), F.concat_ws("-", "id", F.lit("waste-outfall")).alias("id"),
    )
    waste = net.nodes.sparkSession.range(1).select(F.lit(WASTE).alias("id"))
    return net.with_(
        nodes=net.nodes.unionByName(waste, allowMissingColumns=True), edges=net.edges.unionByName(out, allowMissingColumns=True)
    )


def identify_outfalls(net: Network, params: OutfallDerivation, scratch: Scratch) -> Network:
    """``withtopo`` keeps all candidate outfalls and the waste node; ``separate`` keeps those outfall
    edges that lie on the undirected minimum spanning tree by length."""
    scratch = scratch.merged()
    if params.method not in ("withtopo", "separate"):
        raise ValueError("method must be withtopo or separate")
    paired = river_weights(pair_rivers(net, params.river_buffer_distance, params.outfall_length, scratch))
    paired = paired.with_(nodes=scratch.table(paired.nodes, "out-nodes"), edges=scratch.table(paired.edges, "out-edges"))
    rooted = root_nodes(paired)
    if params.method == "withtopo":
        return rooted
    tree = min_spanning_forest(rooted.edges, scratch)
    outfalls = paired.edges.where("edge_type = 'outfall'").join(tree, ["u", "v", "key"], "left_semi").select(*paired.edges.columns)
    return paired.with_(edges=paired.edges.where("edge_type <> 'outfall'").union(outfalls))


def derive_topology(net: Network, scratch: Scratch, method: str = "separate") -> Network:
    """Edges on the chosen paths to the outfalls, with node ``outfall`` and ``shortest_path``.

    ``separate``: nodes that reach an outfall edge, streets only, shortest paths by weight; parallel
    edges of a path all stay. ``withtopo``: the greedy in-tree of ``waste``.
    """
    scratch = scratch.merged()
    if method == "withtopo":
        tree = greedy_in_tree(net.edges, WASTE, scratch)
        missing = net.nodes.join(tree, "id", "left_anti")
        if not missing.isEmpty():
            raise ValueError("not every node reaches waste")
        kept = net.edges.join(tree.select(F.col("id").alias("u"), F.col("parent").alias("v")), ["u", "v"], "left_semi").select(*net.edges.columns)
        heads = scratch.table(kept.where("edge_type = 'outfall'").select(F.col("u").alias("id")), "topo-heads")
        return _labelled(filter_streets(net.with_(edges=kept)), heads, scratch)
    heads = scratch.table(net.edges.where("edge_type = 'outfall'").select(F.col("u").alias("id")).distinct(), "topo-heads")
    up = reach(net.edges, heads, scratch, "topo-up")
    edges = net.edges
    ends = net.edges.where("edge_type = 'outfall'").select(F.col("v").alias("id")).union(up).distinct()
    for end in ("u", "v"):
        edges = edges.join(ends.select(F.col("id").alias(end)), end, "left_semi")
    streets = filter_streets(net.with_(nodes=net.nodes.join(up, "id", "left_semi"), edges=edges.select(*net.edges.columns)))
    return _labelled(streets, heads, scratch, "weight")


def _labelled(net: Network, heads: DataFrame, scratch: Scratch, weight: str = "weight") -> Network:
    paths = shortest_paths(net.edges, heads, scratch, weight)
    if paths.isEmpty():
        raise ValueError("no node has a path to an outfall")
    kept = net.edges.join(paths.select(F.col("id").alias("u"), F.col("parent").alias("v")), ["u", "v"], "left_semi").select(*net.edges.columns)
    nodes = net.nodes.join(paths.select("id", "outfall", F.col("dist").alias("shortest_path")), "id")
    return net.with_(nodes=nodes, edges=kept)


def total_weight(net: Network) -> DataFrame:
    return net.edges.agg(F.sum("weight").alias("total_weight"))


def negative_weights(net: Network) -> DataFrame:
    """One row: whether any weight is below 0, the only way to a negative cycle."""
    return net.edges.agg(F.coalesce(F.min("weight") < 0, F.lit(False)).alias("negative"))


def negative_cycle(net: Network, scratch: Scratch) -> bool:
    """Whether some cycle's weights sum to less than 0.

    All nodes start at 0 and take the least of what their successors offer, and remember whose it was. If
    those ways run in a circle, its weights sum to less than 0; that is looked at after 2, 4, 8, ... rounds.
    Without a negative cycle the best paths have fewer edges than there are nodes, so offers end by then.
    """
    scratch = scratch.merged()
    e = scratch.table(net.edges.groupBy("u", "v").agg(F.min("weight").alias("w")), "neg-edges")
    if e.where("w < 0").isEmpty():
        return False
    start = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    now = scratch.table(start.select("id", F.lit(0.0).alias("d"), F.lit(None).cast("string").alias("to")), "neg-0")
    nodes = now.count()
    for k in itertools.count(1):
        offers = e.join(now.select(F.col("id").alias("v"), "d"), "v").groupBy(F.col("u").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), "v")).alias("o"))
        sank = F.coalesce(F.col("o.d") < F.col("d") - 1e-12, F.lit(False))
        nxt = now.join(offers, "id", "left").select("id", F.when(sank, F.col("o.d")).otherwise(F.col("d")).alias("d"), F.when(sank, F.col("o.v")).otherwise(F.col("to")).alias("to"), sank.alias("sank"))
        nxt = scratch.table(nxt, f"neg-{k}")
        if nxt.where("sank").isEmpty():
            return False
        if k >= nodes:
            return True
        if k & (k - 1) == 0:
            try:
                ends_of(nxt.select("id", "to"), scratch, f"neg-ways-{k}")
            except ValueError:
                return True
        scratch.drop(f"neg-{k - 1}")
        now = nxt.drop("sank")
