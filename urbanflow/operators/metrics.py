"""Coefficients, scales and metrics that compare a synthetic network with a real one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanflow.functions.geometry import create_grid
from urbanflow.model import Network
from urbanflow.operators import series
from urbanflow.operators.network import sinks, subgraph
from urbanflow.operators.paths import reach
from urbanflow.operators.spatial import nodes_to_subs
from urbanflow.scratch import Scratch

INF = float("inf")
Coefficient = Callable[[Column, Column], Column]


def relerror(y: Column, yhat: Column) -> Column:
    return F.when(F.avg(y) == 0, INF).otherwise((F.avg(yhat) - F.avg(y)) / F.avg(y))


def nse(y: Column, yhat: Column) -> Column:
    return F.when(F.stddev_pop(y) == 0, INF).otherwise(F.lit(1.0) - F.sum((y - yhat) * (y - yhat)) / (F.var_pop(y) * F.count(y)))


def kge(y: Column, yhat: Column) -> Column:
    r = F.when(F.stddev_pop(yhat) == 0, 0.0).otherwise(F.corr(y, yhat))
    parts = (r - 1) ** 2 + (F.stddev_pop(yhat) / F.stddev_pop(y) - 1) ** 2 + (F.avg(yhat) / F.avg(y) - 1) ** 2
    return F.when((F.stddev_pop(y) == 0) | (F.avg(y) == 0), INF).otherwise(F.lit(1.0) - F.sqrt(parts))


COEFFICIENTS: dict[str, Coefficient] = {"relerror": relerror, "nse": nse, "kge": kge}


def coef_of(df: DataFrame, coef: Coefficient) -> DataFrame:
    """One row ``value`` over ``value_real`` and ``value_syn``."""
    return df.agg(coef(F.col("value_real"), F.col("value_syn")).alias("value"))


def median_coef_by_group(df: DataFrame, key: str, coef: Coefficient) -> DataFrame:
    """One row: the median over groups of the finite coefficients."""
    each = df.groupBy(key).agg(coef(F.col("value_real"), F.col("value_syn")).alias("c"))
    finite = each.where(F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") != INF))
    return finite.agg(F.median("c").alias("value"))


def best_outfall(net: Network, subs: DataFrame, bucket: float) -> DataFrame:
    """One row ``outfall``: the commonest among nodes inside the polygons; no overlap gives no row."""
    inside = nodes_to_subs(net.nodes, subs, bucket).where("outfall is not null")
    return inside.groupBy("outfall").count().orderBy(F.desc("count"), "outfall").limit(1).select("outfall")


def best_outfall_network(net: Network, subs: DataFrame, bucket: float) -> Network:
    best = best_outfall(net, subs, bucket)
    return subgraph(net, net.nodes.join(F.broadcast(best), "outfall", "left_semi").select("id"))  # one row


def dominant_outfall(net: Network, results: DataFrame, scratch: Scratch) -> tuple[Network, DataFrame]:
    """The sink whose incoming edge has the largest median flow, with all its ancestors."""
    into = net.edges.join(sinks(net).select(F.col("id").alias("v")), "v", "left_semi")
    flow = results.where("variable = 'flow'").select(F.col("id").cast("string").alias("id"), "value")
    best = into.join(flow, "id").groupBy("v").agg(F.median("value").alias("m")).orderBy(F.desc("m"), "v").limit(1).select(F.col("v").alias("id"))
    up = reach(net.edges, best, scratch, "dominant")
    return subgraph(net, up), best


def ks_2samp(a: DataFrame, b: DataFrame, col: str = "value") -> DataFrame:
    """One row ``value``: the largest gap of the two distribution functions (values compared at 12 places).

    Distinct values are dealt over as many ranges as the session shuffles to; counts are summed inside each and lifted by the sums before it.
    """
    v = F.round(F.col(col).cast("double"), 12).alias("v")
    both = a.select(v, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(v, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranged = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    inside = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({"ca": F.sum("a").over(inside), "cb": F.sum("b").over(inside)})
    totals = ranged.groupBy("p").agg(F.max("ca").alias("ta"), F.max("cb").alias("tb"))  # one row a range
    order, every = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(
        "p", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"b{c}") for c in ("ta", "tb")), *(F.sum(c).over(every).alias(f"n{c}") for c in ("ta", "tb"))
    )
    gap = F.abs((F.col("ca") + F.col("bta")) / F.col("nta") - (F.col("cb") + F.col("btb")) / F.col("ntb"))
    return ranged.join(F.broadcast(before), "p").agg(F.coalesce(F.max(gap), F.lit(INF)).alias("value"))


def bias_flood_depth(syn: DataFrame, real: DataFrame, syn_subs: DataFrame, real_subs: DataFrame, variable: str = "flooding") -> DataFrame:
    def depth(results: DataFrame, subs: DataFrame, name: str) -> DataFrame:
        total = series.trapezoid_by(series.extract_var(results, variable)).agg(F.sum("integral").alias("i"))
        return total.crossJoin(subs.agg(F.sum("impervious_area").alias("a"))).select((F.col("i") / F.col("a")).alias(name))  # one row each

    both = depth(syn, syn_subs, "s").crossJoin(depth(real, real_subs, "r"))
    return both.select(((F.col("s") - F.col("r")) / F.col("r")).alias("value"))


# --- scales and the factory -----------------------------------------------------------------------------

#: What each scale needs of the two sides: results, nodes or networks, polygons.
RESTRICTIONS = {
    "length": ("outfall", "relerror"),
    "npipes": ("outfall", "relerror"),
    "nmanholes": ("outfall", "relerror"),
    "diameter": ("outfall", "relerror"),
}


def scale_subcatchment(coef: Coefficient, variable: str, syn, real, syn_nodes, real_nodes, subs, bucket: float) -> DataFrame:
    aligned = series.align_by_shape(variable, syn, real, syn_nodes, real_nodes, subs, bucket)
    return median_coef_by_group(aligned, "sub_id", coef)


def scale_grid(coef: Coefficient, variable: str, syn, real, nodes, scale: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    return median_coef_by_group(series.align_by_cell(variable, syn, real, nodes, scale, x0, y0), "sub_id", coef)


def scale_outfall(coef: Coefficient, variable: str, syn_net: Network, real_net: Network, syn=None, real=None) -> DataFrame:
    """Coefficient between two outfall networks: counts, sums and means of the networks, or their series.

    ``flow`` takes the edges whose lower end no edge leaves, be it among the nodes or not, ``flooding`` all
    nodes; real dates before the first synthetic one have no value to compare and are left out. An empty
    network gives infinity.
    """
    if variable in ("nmanholes", "npipes", "length", "diameter"):
        measure = {
            "nmanholes": lambda n: n.nodes.agg(F.count(F.lit(1)).cast("double").alias("v")),
            "npipes": lambda n: n.edges.agg(F.count(F.lit(1)).cast("double").alias("v")),
            "length": lambda n: n.edges.agg(F.sum("length").alias("v")),
            "diameter": lambda n: n.edges.agg(F.avg("diameter").alias("v")),
        }[variable]
        one = measure(real_net).withColumnRenamed("v", "value_real").crossJoin(measure(syn_net).withColumnRenamed("v", "value_syn"))  # one row each
        value = coef_of(one.where("value_real is not null and value_syn is not null"), coef)
    elif variable in ("flow", "flooding"):

        def ids(n: Network) -> DataFrame:
            if variable == "flooding":
                return n.nodes.select("id")
            return n.edges.where("v is not null").join(n.edges.select(F.col("u").alias("v")), "v", "left_anti").select("id")

        aligned = series.align_by_id(syn, real, variable, ids(syn_net), ids(real_net))
        value = coef_of(aligned.where("value_syn is not null"), coef)
    else:
        raise ValueError(f"unknown variable {variable}")
    return value.select(F.coalesce("value", F.lit(INF)).alias("value"))


#: Scales by name; a further one is a function of (coefficient, variable, its inputs) that gives one row ``value``.
SCALES: dict[str, Callable[..., DataFrame]] = {"outfall": scale_outfall, "grid": scale_grid, "subcatchment": scale_subcatchment}


def metric_factory(name: str, coefficients: dict[str, Coefficient] | None = None, scales: dict[str, Callable[..., DataFrame]] | None = None) -> Callable[..., DataFrame]:
    """The metric ``<scale>_<coefficient>_<variable>`` as a function of its inputs.

    ``coefficients`` and ``scales`` add a user's own to those that are built in.
    """
    coefficients, scales = COEFFICIENTS | (coefficients or {}), SCALES | (scales or {})
    parts = name.split("_")
    if len(parts) != 3:
        raise ValueError(f"a metric is named scale_coefficient_variable, not {name}")
    scale, coef, variable = parts
    if scale not in scales or coef not in coefficients:
        raise ValueError(f"unknown scale or coefficient in {name}")
    if scale in SCALES and variable in RESTRICTIONS and (scale, coef) != RESTRICTIONS[variable]:
        raise ValueError(f"{variable} is measured as {'_'.join(RESTRICTIONS[variable])} alone")
    return lambda *inputs, **named: scales[scale](coefficients[coef], named.pop("variable", variable), *inputs, **named)


METRICS = [
    *(f"outfall_{c}_{v}" for c in ("nse", "kge", "relerror") for v in ("flow", "flooding")),
    *(f"outfall_relerror_{v}" for v in ("length", "npipes", "nmanholes", "diameter")),
    *(f"{s}_{c}_flooding" for s in ("grid", "subcatchment") for c in ("nse", "kge", "relerror")),
]


def run_metrics(plans: dict[str, Callable[[], DataFrame]], names: list[str]) -> DataFrame:
    """``metric, value`` for each name; a name without a plan is an error before anything runs."""
    unknown = [n for n in names if n not in plans]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    rows = [plans[n]().select(F.lit(n).alias("metric"), F.col("value").cast("double").alias("value")) for n in names]
    return reduce(DataFrame.unionByName, rows)


def compare_all(pairs: dict[str, tuple[Network, Network]], metrics: dict[str, Callable[[Network, Network], DataFrame]]) -> DataFrame:
    """``pair_id, metric, value`` of every metric for every pair of networks.

    A metric is a function of (synthetic, real) that gives one row ``value``; the rows are one plan.
    """
    rows = [
        run(syn, real).select(F.lit(pair).alias("pair_id"), F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        for pair, (syn, real) in pairs.items()
        for name, run in metrics.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def grid_over(spark: SparkSession, nodes: DataFrame, scale: float) -> DataFrame:
    b = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()  # one row: the extent
    return create_grid(spark, (b[0], b[1], b[2], b[3]), scale)
