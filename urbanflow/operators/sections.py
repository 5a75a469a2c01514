"""Section tables of a hydraulic model, and ordered lists of network steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.functions.geometry import ring_vertices
from urbanflow.model import Network
from urbanflow.operators.network import filter_streets, sinks

class Const(str):
    """A cell that is the same in every row of a section."""


ZERO, STAR = Const("0"), Const("*")

# The fields of each section in the order that the model format asks for.
SECTIONS: dict[str, tuple[str, ...]] = {
    "RAINGAGES": ("name", Const("INTENSITY"), "interval", Const("1.0"), Const("FILE"), "file", "station", Const("MM")),
    "SUBCATCHMENTS": ("subcatchment", "rain_gage", "id", "area", "rc", "width", "slope", ZERO, Const("empty")),
    "SUBAREAS": ("subcatchment", ZERO, ZERO, ZERO, ZERO, ZERO, Const("OUTLET"), ZERO),
    "INFILTRATION": ("subcatchment", ZERO, ZERO, ZERO, ZERO, ZERO),
    "JUNCTIONS": ("id", "chamber_floor_elevation", "max_depth", ZERO, "surcharge_depth", "flooded_area"),
    "STORAGE": ("id", "chamber_floor_elevation", "max_depth", ZERO, Const("FUNCTIONAL"), ZERO, ZERO, "manhole_area", ZERO, ZERO, ZERO, ZERO),
    "OUTFALLS": ("id", "chamber_floor_elevation", Const("FREE"), Const(" "), Const("NO"), STAR),
    "CONDUITS": ("id", "u", "v", "length", "roughness", Const("0.0001"), Const("0.0001"), ZERO, "capacity"),
    "XSECTIONS": ("id", Const("CIRCULAR"), "diameter", ZERO, ZERO, ZERO, Const("1"), STAR),
    "COORDINATES": ("id", "x", "y"),
    "VERTICES": ("id", "x", "y"),
    "POLYGONS": ("subcatchment", "x", "y"),
    "SYMBOLS": ("name", "x", "y"),
    "MAP": (Const("DIMENSIONS"), "x1", "y1", "x2", "y2"),
}


def outfall_twins(net: Network) -> tuple[DataFrame, DataFrame]:
    """Twins of the sinks (5 lower, 50 aside) and the pipes that lead to them, as wide as the widest."""
    out = sinks(net).withColumns({"id": F.concat("id", F.lit("_outfall")), "chamber_floor_elevation": F.col("chamber_floor_elevation") - 5, "x": F.col("x") - 50, "y": F.col("y") - 50})
    widest = net.edges.agg(F.max("diameter").alias("diameter"))
    u = F.regexp_replace("id", "_outfall$", "")
    links = out.select(u.alias("u"), F.col("id").alias("v"), F.concat_ws("-", u, "id").alias("id"), F.lit(5000**0.5).alias("length"), F.lit(0.01).alias("roughness"), F.lit(1e10).alias("capacity"))
    return out, links.crossJoin(F.broadcast(widest))  # one row


def extents(nodes: DataFrame) -> DataFrame:
    """One row: the map's bounds; the rain gauge stands at (x1, y1)."""
    return nodes.agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def to_section(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in section order as ``c0, c1, ...``; missing numbers become 0, a ``Const`` is the same in every row."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if isinstance(c, Const):
            return F.lit(str(c))
        return F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) if kinds[c] in ("double", "int", "bigint", "float") else F.col(c)

    return df.select(*(cell(c).alias(f"c{i}") for i, c in enumerate(columns)))


def section_tables(net: Network, subs: DataFrame, ring: str = "ring", rain: tuple[str, str, str] = ("0:05", "storm.dat", "1")) -> dict[str, DataFrame]:
    """Section name to table, from nodes, edges and subcatchments (id, area, rc, width, slope, ring).

    ``rain`` has the gauge's interval, file and station. Edges with a ``geometry`` give the vertices
    between their ends.
    """
    nodes = net.nodes.withColumns({"max_depth": F.col("surface_elevation") - F.col("chamber_floor_elevation"), "surcharge_depth": F.lit(0.0), "flooded_area": F.lit(100.0), "manhole_area": F.lit(0.5)})
    out, links = outfall_twins(net.with_(nodes=nodes))
    own = net.edges.withColumns({"roughness": F.lit(0.01), "capacity": F.lit(1e10)})
    cols = ["id", "u", "v", "length", "roughness", "capacity", "diameter"]
    pipes = own.select(*cols).unionByName(links.select(*cols))
    # hectares in the section
    s = subs.join(net.nodes.select("id"), "id", "left_semi").withColumns({"subcatchment": F.concat("id", F.lit("-sub")), "area": F.col("area") / 10000, "slope": F.col("slope") * 100, "rain_gage": F.lit("1")})
    points = nodes.select("id", "x", "y").union(out.select("id", "x", "y"))
    e = extents(nodes)
    gauge = e.select(F.lit("1").alias("name"), *(F.lit(x).alias(n) for n, x in zip(("interval", "file", "station"), rain)))
    bends = net.edges.where("size(geometry) > 2").select("id", F.explode(F.expr("slice(geometry, 2, size(geometry) - 2)")).alias("p")) if "geometry" in net.edges.columns else None
    bends = points.where("false") if bends is None else bends.select("id", "p.x", "p.y")
    sources = {
        "RAINGAGES": gauge, "JUNCTIONS": nodes, "VERTICES": bends,
        "CONDUITS": pipes, "XSECTIONS": pipes, "STORAGE": nodes, "OUTFALLS": out, "COORDINATES": points, "MAP": e,
        "SUBCATCHMENTS": s, "SUBAREAS": s, "INFILTRATION": s, "POLYGONS": ring_vertices(s, ring, "subcatchment"),
        "SYMBOLS": e.select(F.lit("1").alias("name"), F.col("x1").alias("x"), F.col("y1").alias("y")),
    }
    return {k: to_section(df, SECTIONS[k]) for k, df in sources.items()}


def section_lines(table: DataFrame, width: int = 16) -> DataFrame:
    """One text line for each row, cells padded to ``width``."""
    return table.select(F.rtrim(F.concat(*(F.rpad(F.col(c).cast("string"), width, " ") for c in table.columns))).alias("value"))


def write_sections(tables: dict[str, DataFrame], path: str, width: int = 16) -> None:
    for name, table in tables.items():
        section_lines(table, width).write.text(f"{path}/{name}")


# --- pipelines ------------------------------------------------------------------------------------------


def requires(nodes: Sequence[str] = (), edges: Sequence[str] = (), adds_nodes: Sequence[str] = (), adds_edges: Sequence[str] = ()):
    """Declare which columns a network step needs and adds, for the check before a pipeline runs."""

    def mark(step: Callable) -> Callable:
        step.contract = (tuple(nodes), tuple(edges), tuple(adds_nodes), tuple(adds_edges))
        return step

    return mark


def check_pipeline(net: Network, steps: Sequence[Callable]) -> None:
    """Raise for the first column that a step needs and nothing before it gives."""
    have = {"node": set(net.nodes.columns), "edge": set(net.edges.columns)}
    for step in steps:
        nodes, edges, more_nodes, more_edges = getattr(step, "contract", ((), (), (), ()))
        for kind, names in (("node", nodes), ("edge", edges)):
            for name in names:
                if name not in have[kind]:
                    raise ValueError(f"{step.__name__} needs {kind} column {name}")
        have["node"] |= set(more_nodes)
        have["edge"] |= set(more_edges)


def run_pipeline(net: Network, steps: Sequence[Callable[..., Network]], stop_when_empty: bool = True, **params) -> Network:
    """Apply the steps in order after checking them; each takes the network and keyword parameters.

    A job after each step looks for a street edge and ends early without one; without
    ``stop_when_empty`` all steps stay one plan.
    """
    check_pipeline(net, steps)
    for step in steps:
        net = step(net, **params)
        if stop_when_empty and filter_streets(net).edges.isEmpty():
            break
    return net
