"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.scratch import Scratch, large


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 40) -> DataFrame:
    """``(id, component)`` for every end of ``edges (u, v)``; component is the smallest id reachable.

    Direction and repetition of edges don't matter. Each round joins every node's neighbours to the least
    one (large star: the greater neighbours; small star: the lesser), which halves path lengths, and is
    written to the scratch folder; the only value that reaches the driver is a checksum of the edges.
    Nodes gather a minimum, never a list, so a hub is no burden.
    """
    both = edges.select("u", "v").where("u <> v")
    now = scratch.table(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in range(1, rounds + 1):
        # large star: greater neighbours take the least of the node and its neighbours
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        greater = sym.join(large(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its lesser neighbours take the least of those
        low = greater.groupBy("u").agg(F.min("v").alias("m"))
        small = greater.join(large(low), "u")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        scratch_now = scratch.table(nxt.where("u <> v").distinct(), f"{name}-{k}")
        sign = scratch_now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        scratch.drop(f"{name}-{k - 1}")
        now = scratch_now
        if (sign["n"], sign["x"]) == seen:
            break
        seen = (sign["n"], sign["x"])
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
