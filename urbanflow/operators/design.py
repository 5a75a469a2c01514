"""Hydraulic design of pipes, level by level from the heads downstream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.model import HydraulicDesign, Network
from urbanflow.operators.paths import accumulate_forest, levels
from urbanflow.scratch import Scratch, dealt

MANNING = 0.012
SURCHARGE_STEP = 0.05


def design_grid(spark: SparkSession, params: HydraulicDesign) -> DataFrame:
    """``diam, depth``: every diameter at every depth; a small fixed table."""
    n = params.depth_nbins
    depths = [params.min_depth + (params.max_depth - params.min_depth) * i / max(1, n - 1) for i in range(n)]
    return spark.createDataFrame([(float(d), float(z)) for d in params.diameters for z in depths], "diam double, depth double")


def design_flow(edges: DataFrame, nodes: DataFrame, precipitation: float, scratch: Scratch) -> DataFrame:
    """``id, q``: flow that leaves each node of a forest, from the area of itself and all upstream."""
    area = nodes.select("id", F.coalesce("contributing_area", F.lit(0.0)).alias("value"))
    total = accumulate_forest(edges.select(F.col("u").alias("id"), F.col("v").alias("parent")), area, scratch)
    return total.select("id", (F.col("total") * precipitation / 3600).alias("q"))


def pipe_cost(volume: Column, diam: Column) -> Column:
    return (F.pow(diam, F.lit(0.5737)) * 9579.31 + F.pow(volume, F.lit(1.31)) * 1163.77) * (1.32 / 2000)


def _lift(diff: Column) -> Column:
    """Surcharge in whole steps until a pipe without fall falls."""
    return F.when(diff > 0, 0.0).otherwise((F.floor(-diff / SURCHARGE_STEP) + 1) * SURCHARGE_STEP)


def _velocity(diff: Column, lift: Column, length: Column, diam: Column) -> Column:
    return F.sqrt((diff + lift) / length) * F.pow(diam / 4, F.lit(2 / 3)) / MANNING


def _cost(length: Column, floor: Column, diam: Column, depth: Column) -> Column:
    volume = length * (diam + 0.3) * ((depth + floor) / 2 + 0.1)
    return F.when(volume >= 0, pipe_cost(volume, diam))


def _filling(q: Column, velocity: Column, diam: Column) -> Column:
    return q / (velocity * (diam**2 * (math.pi / 4)))


def _too_fast(velocity: Column, params: HydraulicDesign) -> Column:
    return F.greatest(F.lit(params.min_v) - velocity, F.lit(0.0)) + F.greatest(velocity - params.max_v, F.lit(0.0))


def evaluate_design(df: DataFrame, params: HydraulicDesign) -> DataFrame:
    """Adds slope, velocity, fr, cost_usd and the violations to (ds_elevation, floor, length, q, diam, depth).

    Without fall the pipe is surcharged in whole steps until it falls; the slope reported is the one
    without surcharge.
    """
    diff, length, diam = F.col("floor") - (F.col("ds_elevation") - F.col("depth")), F.col("length"), F.col("diam")
    lift = _lift(diff)
    return (
        df.withColumns({"slope": diff / length, "surcharge_feasibility": lift, "velocity": _velocity(diff, lift, length, diam)})
        .withColumn("fr", _filling(F.col("q"), F.col("velocity"), diam))
        .withColumns({
            "cost_usd": _cost(length, F.col("floor"), diam, F.col("depth")),
            "v_feasibility": _too_fast(F.col("velocity"), params),
            "fr_feasibility": F.greatest(F.col("fr") - params.max_fr, F.lit(0.0)),
        })
    )


ORDER = ("surcharge_feasibility", "v_feasibility", "fr_feasibility", "depth", "cost_usd", "diam")


def select_design(df: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by``: the first design by violations, depth and cost; designs without a cost don't count."""
    best = df.where("cost_usd is not null").groupBy(*by).agg(F.min(F.struct(*ORDER, "slope", "velocity", "fr")).alias("m"))
    return best.select(*by, "m.*")


def choose_design(df: DataFrame, params: HydraulicDesign, by: list[str]) -> DataFrame:
    """As ``evaluate_design`` and ``select_design`` over all designs, for one row of (ds_elevation, floor, length, q)
    for each ``by``: the designs stay an array inside the row, so nothing is exploded, sorted or shuffled."""
    n, numbers = params.depth_nbins, lambda xs: F.split(F.lit(",".join(repr(float(x)) for x in xs)), ",").cast("array<double>")
    depths = numbers(params.min_depth + (params.max_depth - params.min_depth) * i / max(1, n - 1) for i in range(n))
    floor, length, q = F.col("floor"), F.col("length"), F.col("q")
    grid = F.flatten(F.transform(numbers(params.diameters), lambda d: F.transform(depths, lambda z: F.struct(d.alias("diam"), z.alias("depth")))))
    fall = F.transform(grid, lambda g: F.struct(g["diam"].alias("diam"), g["depth"].alias("depth"), (floor - (F.col("ds_elevation") - g["depth"])).alias("diff")))
    lifted = F.transform(fall, lambda g: F.struct(g["diam"].alias("diam"), g["depth"].alias("depth"), g["diff"].alias("diff"), _lift(g["diff"]).alias("lift")))
    moving = F.transform(lifted, lambda g: F.struct(
        g["diam"].alias("diam"), g["depth"].alias("depth"), g["diff"].alias("diff"), g["lift"].alias("lift"),
        _velocity(g["diff"], g["lift"], length, g["diam"]).alias("velocity"), _cost(length, floor, g["diam"], g["depth"]).alias("cost"),
    ))
    filled = F.transform(F.filter(moving, lambda g: g["cost"].isNotNull()), lambda g: F.struct(
        g["lift"].alias("surcharge_feasibility"), _too_fast(g["velocity"], params).alias("v_feasibility"),
        F.greatest(_filling(q, g["velocity"], g["diam"]) - params.max_fr, F.lit(0.0)).alias("fr_feasibility"),
        g["depth"].alias("depth"), g["cost"].alias("cost_usd"), g["diam"].alias("diam"),
        (g["diff"] / length).alias("slope"), g["velocity"].alias("velocity"), _filling(q, g["velocity"], g["diam"]).alias("fr"),
    ))
    # a filter on the chosen design would be moved before the rows are dealt, and all designs computed twice
    some = df.where(F.exists(grid, lambda g: _cost(length, floor, g["diam"], g["depth"]).isNotNull()))
    return some.select(*by, F.array_min(filled).alias("m")).select(*by, "m.*")


def pipe_by_pipe(net: Network, params: HydraulicDesign, scratch: Scratch) -> Network:
    """Edges of a forest with their designed ``diameter`` and cost; nodes with ``chamber_floor_elevation``.

    Heads start at the least depth. All edges that leave a level are designed at once: each meets the
    designs inside its row, and a node's floor is the least of what its incoming pipes need.
    """
    flow = scratch.table(design_flow(net.edges, net.nodes, params.precipitation, scratch), "flow")
    at = scratch.table(levels(net.edges, scratch), "level")
    z = net.nodes.select("id", F.col("surface_elevation").alias("z"))
    e = net.edges.select("u", "v", "key", "length").join(at.select(F.col("id").alias("u"), "level"), "u")
    e = e.join(z.select(F.col("id").alias("v"), F.col("z").alias("ds_elevation")), "v").join(flow.select(F.col("id").alias("u"), "q"), "u")
    e = scratch.table(e, "design-edges")
    has_in = net.edges.select(F.col("v").alias("id")).distinct()
    floors = scratch.table(z.join(has_in, "id", "left_anti").select("id", (F.col("z") - params.min_depth).alias("floor")), "floor-head")
    last = at.agg(F.max("level")).first()[0] or 0  # one row
    pipes = None
    for k in range(last + 1):
        own = dealt(e.where(F.col("level") == k).join(floors.select(F.col("id").alias("u"), "floor"), "u"))
        done = scratch.table(choose_design(own, params, ["u", "v", "key", "ds_elevation"]), f"pipes-{k}")
        pipes = done if pipes is None else pipes.union(done)
        # all pipes into a node of the next level lie in levels up to this one
        floors = floors.union(pipes.groupBy(F.col("v").alias("id")).agg(F.min(F.col("ds_elevation") - F.col("depth")).alias("floor")).join(at.where(F.col("level") == k + 1).select("id"), "id", "left_semi"))
        floors = scratch.table(floors, f"floor-{k}")
    kept = {"diameter": F.col("diam"), "cost_usd": F.col("cost_usd"), "depth": F.col("depth"), "slope": F.col("slope"), "velocity": F.col("velocity"), "fr": F.col("fr")}
    chosen = pipes.select("u", "v", "key", *(kept[c].alias(c) for c in params.edge_design_parameters))
    edges = net.edges.drop(*params.edge_design_parameters).join(chosen, ["u", "v", "key"])
    nodes = net.nodes.drop("chamber_floor_elevation").join(floors.select("id", F.col("floor").alias("chamber_floor_elevation")), "id", "left")
    return net.with_(nodes=nodes, edges=edges)
