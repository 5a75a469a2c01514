"""Result tables ``(id, variable, date, value)``: warm-up, integrals, gap filling and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.operators.network import keep_ids
from urbanflow.operators.spatial import nodes_to_subs
from urbanflow.scratch import Scratch


def apply_warmup(results: DataFrame, warmup: float) -> DataFrame:
    """Rows from min + ``warmup`` * (max - min) of the table's dates on."""
    micros = F.unix_micros(F.col("date").cast("timestamp"))
    span = results.agg(F.min(micros).alias("_a"), F.max(micros).alias("_b"))
    joined = results.crossJoin(F.broadcast(span))  # one row
    return joined.where(micros >= F.col("_a") + (F.col("_b") - F.col("_a")) * warmup).select(*results.columns)


def extract_var(results: DataFrame, variable: str) -> DataFrame:
    """One variable, with ``duration`` in seconds since its first date."""
    own = results.where(F.col("variable") == variable)
    micros = F.unix_micros(F.col("date").cast("timestamp"))
    start = own.agg(F.min(micros).alias("_a"))
    return own.crossJoin(F.broadcast(start)).withColumn("duration", (micros - F.col("_a")) / 1e6).drop("_a")  # one row


def trapezoid_by(df: DataFrame, id: str = "id") -> DataFrame:
    """``id, integral`` of value over duration, in order of duration."""
    w = Window.partitionBy(id).orderBy("duration", "value")
    step = (F.col("value") + F.lag("value").over(w)) / 2 * (F.col("duration") - F.lag("duration").over(w))
    return df.withColumn("_s", step).groupBy(id).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("integral"))


def interpolate_by(df: DataFrame, keys: Sequence[str], order: str, col: str, method: str = "row") -> DataFrame:
    """Fill gaps of ``col`` inside each ordered group: linear within, the last value after, none before.

    ``method='row'`` weighs by row position, ``'time'`` by the order column in seconds.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.row_number().over(w).cast("double") if method == "row" else F.unix_micros(F.col(order).cast("timestamp")) / 1e6
    d = df.withColumn("_at", at).withColumn("_known", F.when(F.col(col).isNotNull(), F.struct(F.col("_at").alias("t"), F.col(col).alias("v"))))
    d = d.withColumns({"_p": F.last("_known", ignorenulls=True).over(back), "_n": F.first("_known", ignorenulls=True).over(on)})
    share = (F.col("_at") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_n").isNull(), F.col("_p.v")).when(F.col("_p").isNotNull(), line)
    return d.withColumn(col, filled).select(*df.columns)


def _in_ranges(df: DataFrame, order: str, ranges: int | None) -> DataFrame:
    """Adds ``_r``, ranges of ``order`` of about equal size, as many as the session shuffles to by default.

    The cuts, one number a range, are literals, so that every reading of the rows finds the same ranges.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(micros, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    if not cuts:
        return df.withColumn("_r", F.lit(0))
    below = F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < micros)
    return df.withColumn("_r", F.when(F.col(order).isNull(), 0).otherwise(F.size(below)))


def interpolate_all(df: DataFrame, order: str, col: str, method: str = "row", ranges: int | None = None) -> DataFrame:
    """As ``interpolate_by`` over all rows as one group, range by range of ``order``.

    Each range is filled for itself; its number of rows and its first and last known value go to one row,
    and those rows tell a range how many rows lie before it and what is known before and after it.
    """
    w = Window.partitionBy("_r").orderBy(order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = _in_ranges(df, order, ranges).withColumn("_k", F.row_number().over(w))
    place = F.col("_k").cast("double") if method == "row" else F.unix_micros(F.col(order).cast("timestamp")) / 1e6
    d = d.withColumn("_known", F.when(F.col(col).isNotNull(), F.struct(place.alias("t"), F.col(col).alias("v"))))
    totals = d.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_known", F.when(F.col("_known").isNotNull(), F.col("_k"))).alias("_first"), F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("_k"))).alias("_last"))
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    later = Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    lifted = totals.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) if method == "row" else F.lit(0))
    on_line = lambda known: F.when(F.col(known).isNotNull(), F.struct((F.col(f"{known}.t") + F.col("_off")).alias("t"), F.col(f"{known}.v").alias("v")))
    lifted = lifted.withColumns({"_first": on_line("_first"), "_last": on_line("_last")})
    around = lifted.select("_r", "_off", F.last("_last", ignorenulls=True).over(earlier).alias("_before"), F.first("_first", ignorenulls=True).over(later).alias("_after"))
    d = d.withColumns({"_p": F.last("_known", ignorenulls=True).over(back), "_x": F.first("_known", ignorenulls=True).over(on)}).join(F.broadcast(around), "_r")
    at = place + F.col("_off")
    d = d.withColumns({"_p": F.coalesce(on_line("_p"), "_before"), "_x": F.coalesce(on_line("_x"), "_after")})
    line = F.col("_p.v") + (F.col("_x.v") - F.col("_p.v")) * (at - F.col("_p.t")) / (F.col("_x.t") - F.col("_p.t"))
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_x").isNull(), F.col("_p.v")).when(F.col("_p").isNotNull(), line)
    return d.withColumn(col, filled).select(*df.columns)


def _aligned(syn: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    both = syn.join(real, [*keys, "date"], "full")
    return interpolate_by(both, keys, "date", "value_syn").where("value_real is not null")


def align_by_id(syn: DataFrame, real: DataFrame, variable: str, syn_ids: DataFrame | None = None, real_ids: DataFrame | None = None) -> DataFrame:
    """``date, value_syn, value_real``: sums over the chosen ids, synthetic gaps filled, real dates kept."""

    def total(results: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
        own = results.where(F.col("variable") == variable).withColumn("id", F.col("id").cast("string"))
        own = own if ids is None else keep_ids(own, ids.select(F.col("id").cast("string").alias("id")))
        return own.groupBy("date").agg(F.sum("value").alias(name))

    a, b = total(syn, syn_ids, "value_syn"), total(real, real_ids, "value_real")
    return interpolate_all(a.join(b, "date", "full"), "date", "value_syn").where("value_real is not null")


def align_by_shape(
    variable: str, syn: DataFrame, real: DataFrame, syn_nodes: DataFrame, real_nodes: DataFrame, shapes: DataFrame, bucket: float, key: str = "sub_id"
) -> DataFrame:
    """``key, date, value_syn, value_real``: sums over the nodes inside each polygon, aligned by date.

    The nodes of both sides are placed in one join, and their places written once.
    """
    sides = [n.select(F.lit(i).alias("_side"), F.col("id").cast("string").alias("id"), "x", "y") for i, n in enumerate((syn_nodes, real_nodes))]
    placed = nodes_to_subs(sides[0].union(sides[1]), shapes, bucket, key).select("_side", "id", key)
    placed = Scratch(syn.sparkSession, "shapes").table(placed, "placed")
    a, b = (_by_group(r, placed.where(F.col("_side") == i).drop("_side"), variable, key, n) for i, (r, n) in enumerate(((syn, "value_syn"), (real, "value_real"))))
    return _aligned(a, b, [key])


def _by_group(results: DataFrame, placed: DataFrame, variable: str, key: str, name: str) -> DataFrame:
    own = results.where(F.col("variable") == variable).withColumn("id", F.col("id").cast("string"))
    return own.join(placed, "id").groupBy(key, "date").agg(F.sum("value").alias(name))


def align_by_cell(variable: str, syn: DataFrame, real: DataFrame, nodes: DataFrame, scale: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """As ``align_by_shape`` over a regular grid: the cell is arithmetic, borders belong to no cell."""
    i, j = (F.col("x") - x0) / scale, (F.col("y") - y0) / scale
    placed = nodes.where((i != F.floor(i)) & (j != F.floor(j))).select("id", F.concat_ws("_", F.floor(i), F.floor(j)).alias("sub_id"))
    a, b = (_by_group(r, placed, variable, "sub_id", n) for r, n in ((syn, "value_syn"), (real, "value_real")))
    return _aligned(a, b, ["sub_id"])


def thin_results(results: DataFrame, n: int, duration: float | None = None, variables: Sequence[str] | None = None) -> DataFrame:
    """Stored variables, at most ``duration`` seconds, every ``n``-th date (1st, n+1-th, ...); 1 keeps all.

    Dates are numbered once from the table of distinct dates, range by range, not over all rows.
    """
    own = results if variables is None else results.where(F.col("variable").isin(list(variables)))
    micros = F.unix_micros(F.col("date").cast("timestamp"))
    if duration is not None:
        start = own.agg(F.min(micros).alias("_a"))
        own = own.crossJoin(F.broadcast(start)).where(micros - F.col("_a") <= duration * 1e6).select(*results.columns)  # one row
    if n <= 1:
        return own
    ranged = _in_ranges(own.select("date").distinct(), "date", None)
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_off"))  # one row a range
    dates = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy("date"))).join(F.broadcast(before), "_r").where((F.col("_k") + F.col("_off")) % n == 1)
    return own.join(dates.select("date"), "date", "left_semi").select(*results.columns)
