"""Iterative graph jobs: each round is a join and an aggregate over the frontier, written to scratch."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.operators.components import components
from urbanflow.scratch import Scratch, large

#: Rounds after which a result that grows by unions is written as one table, so that its plan stays short.
_GATHER = 20


def reach(edges: DataFrame, targets: DataFrame, scratch: Scratch, name: str = "reach") -> DataFrame:
    """``id`` of the targets and of all nodes with a path to one."""
    return _spread(edges, targets, scratch, name)


def descendants(edges: DataFrame, sources: DataFrame, scratch: Scratch, name: str = "down") -> DataFrame:
    return _spread(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), sources, scratch, name)


def _spread(edges: DataFrame, start: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    scratch = scratch.merged()
    arcs = shortcuts(edges.select("u", "v", F.lit(0.0).alias("w")).distinct(), scratch, f"{name}-arcs")
    step = arcs.select(F.col("v").alias("id"), F.col("u").alias("next")).distinct()
    seen = front = scratch.table(start.select("id").distinct(), f"{name}-0")
    for k in itertools.count(1):
        front = scratch.table(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"), f"{name}-{k}")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if k % _GATHER == 0:
            seen = scratch.table(seen, f"{name}-seen-{k}")


def shortcuts(edges: DataFrame, scratch: Scratch, name: str, widest: bool = False) -> DataFrame:
    """``u, v, w, hops, first``: the edges (u, v, w) and walks of 2, 4, 8, ... of them along chains.

    A chain node has two neighbours, direction aside. Walks double where they meet at one and go straight
    on, so there are at most as many of each length as edges, and a chain is crossed in a logarithmic
    number of rounds. ``w`` is the sum of the weights, with ``widest`` the largest; ``first`` the node
    after ``u``. The edges themselves come with one hop each.
    """
    scratch = scratch.merged()
    one = scratch.table(edges.select("u", "v", "w", F.lit(1).alias("hops"), F.col("v").alias("first"), F.col("u").alias("before")), f"{name}-0")
    ends = one.where("u <> v").select("u", "v")
    beside = ends.union(ends.select("v", "u")).distinct().groupBy("u").count().where("count = 2")
    chain = scratch.table(beside.select(F.col("u").alias("v")), f"{name}-chain")
    out = last = one
    for k in itertools.count(1):
        on = last.where("u <> v").join(chain, "v").select("u", "v", "w", "hops", "first", "before")
        more = last.where("u <> v").select(F.col("u").alias("v"), F.col("v").alias("end"), F.col("w").alias("_w"), F.col("hops").alias("_h"), F.col("first").alias("_f"), F.col("before").alias("_b"))
        w = F.greatest("w", "_w") if widest else F.col("w") + F.col("_w")
        met = on.join(more, "v").where("_f <> before and u <> end")
        last = scratch.table(met.select("u", F.col("end").alias("v"), w.alias("w"), (F.col("hops") + F.col("_h")).alias("hops"), "first", F.col("_b").alias("before")), f"{name}-{k}")
        if last.isEmpty():
            return out.drop("before")
        out = out.union(last)


def shortest_paths(edges: DataFrame, sources: DataFrame, scratch: Scratch, weight: str = "weight") -> DataFrame:
    """``id, dist, parent, outfall``: shortest paths along the edges to the nearest source.

    Ties go to fewer hops and then to the least parent; sums that differ by rounding alone are ties.
    Chains are crossed by shortcuts. A negative cycle would improve for ever: more rounds than nodes are
    an error.
    """
    scratch = scratch.merged()
    into = scratch.table(edges.groupBy("u", "v").agg(F.min(weight).cast("double").alias("w")), "sp-edges")
    arcs = scratch.table(shortcuts(into, scratch, "sp-arcs"), "sp-arcs-all")
    now = scratch.table(sources.select("id", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")).distinct(), "sp-0")
    most, front = None, now
    for k in itertools.count(1):
        offers = front.select(F.col("id").alias("v"), "dist", F.col("hops").alias("h")).join(arcs, "v")
        d = F.col("dist") + F.col("w")
        best = offers.groupBy(F.col("u").alias("id")).agg(F.min(F.struct(F.round(d, 9).alias("r"), (F.col("h") + F.col("hops")).alias("h"), F.col("first").alias("p"), d.alias("d"))).alias("m"))
        both = now.join(best, "id", "full")
        slack = (F.abs("dist") + 1) * 1e-12
        tie = (F.abs(F.col("m.d") - F.col("dist")) <= slack) & (F.struct("m.h", "m.p") < F.struct("hops", F.coalesce("parent", F.lit(""))))
        better = F.col("m").isNotNull() & (F.col("dist").isNull() | (F.col("m.d") < F.col("dist") - slack) | F.coalesce(tie, F.lit(False)))
        cols = [F.when(better, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("m.d", "dist"), ("m.h", "hops"), ("m.p", "parent"))]
        now = scratch.table(both.select("id", *cols, better.alias("changed")), f"sp-{k}")
        front = now.where("changed").drop("changed")
        now = now.drop("changed")
        if front.isEmpty():
            break
        if k > 100:  # counted only where it may matter
            most = most or into.select("u").union(into.select("v")).distinct().count() + 1
            if k > most:
                raise RuntimeError("distances still improve after as many rounds as nodes: a negative cycle")
    ends = ends_of(now.select("id", F.col("parent").alias("to")), scratch, "sp-ends")
    return now.join(ends, "id").select("id", "dist", "parent", F.col("end").alias("outfall"))


def ends_of(ways: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, end``: where the way (id, to) from each id ends; pointers double. A circle is an error."""
    scratch = scratch.merged()
    now, longest = scratch.table(ways.select("id", "to", F.coalesce("to", "id").alias("end")), f"{name}-0"), None
    for k in itertools.count(1):
        if now.where("to is not null").isEmpty():
            return now.select("id", "end")
        longest = longest or math.ceil(math.log2(max(2, now.count()))) + 1
        if k > longest:
            raise ValueError("the ways run in a circle")
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_t"), F.col("end").alias("_e"))
        now = scratch.table(now.join(large(far), "to", "left").select("id", F.col("_t").alias("to"), F.coalesce("_e", "end").alias("end")), f"{name}-{k}")


def greedy_in_tree(edges: DataFrame, root: str, scratch: Scratch, weight: str = "weight") -> DataFrame:
    """``id, parent, bottleneck, hops``: the in-tree whose paths have the least possible largest weight.

    Ties go to fewer hops and then to the least parent. Chains are crossed by shortcuts.
    """
    scratch = scratch.merged()
    into = scratch.table(edges.groupBy("u", "v").agg(F.min(weight).alias("w")), "tree-edges")
    arcs = scratch.table(shortcuts(into, scratch, "tree-arcs", widest=True), "tree-arcs-all")
    spark = edges.sparkSession
    now = front = scratch.table(spark.range(1).select(F.lit(root).alias("id"), F.lit(float("-inf")).alias("b"), F.lit(0).alias("hops"), F.lit("").alias("parent")), "tree-0")
    for k in itertools.count(1):
        offers = front.select(F.col("id").alias("v"), "b", F.col("hops").alias("h")).join(arcs, "v")
        best = offers.groupBy(F.col("u").alias("id")).agg(F.min(F.struct(F.greatest("b", "w").alias("b"), (F.col("h") + F.col("hops")).alias("hops"), F.col("first").alias("parent"))).alias("o"))
        both = now.join(best, "id", "full")
        better = F.col("o").isNotNull() & (F.col("b").isNull() | (F.col("o") < F.struct("b", "hops", "parent")))
        cols = [F.when(better, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) for c in ("b", "hops", "parent")]
        now = scratch.table(both.select("id", *cols, better.alias("changed")), f"tree-{k}")
        front = now.where("changed").drop("changed")
        now = now.drop("changed")
        if front.isEmpty():
            return now.select("id", F.nullif("parent", F.lit("")).alias("parent"), F.col("b").alias("bottleneck"), "hops")


def levels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, level``: the longest distance from a node without predecessors; a cycle is an error.

    In a forest, where no node has two ways on, pointers double and a node hands on how far what lies
    above it reaches. Elsewhere nodes leave in waves: a wave holds the nodes whose predecessors have left.
    """
    scratch = scratch.merged()
    left = scratch.table(edges.select("u", "v").where("u <> v").distinct(), "lv-0")
    every = left.select(F.col("u").alias("id")).union(left.select("v")).distinct()
    if left.groupBy("u").count().where("count > 1").isEmpty():
        return _heights(every.join(large(left.select(F.col("u").alias("id"), F.col("v").alias("to"))), "id", "left"), scratch)
    out, done = None, None
    for k in itertools.count():
        heads = left.select(F.col("v").alias("id")).distinct()
        open_ = every if done is None else every.join(done, "id", "left_anti")
        wave = scratch.table(open_.join(heads, "id", "left_anti").select("id", F.lit(k).alias("level")), f"lv-wave-{k}")
        out = wave if out is None else out.union(wave)
        out = scratch.table(out, f"lv-out-{k}") if k and k % _GATHER == 0 else out
        done = out.select("id")
        nxt = scratch.table(left.join(wave.select(F.col("id").alias("u")), "u", "left_anti"), f"lv-{k + 1}")
        if wave.isEmpty():
            if not nxt.isEmpty():
                raise ValueError("the graph has a cycle")
            return out
        left = nxt


def _heights(ways: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, level`` in a forest (id, to): in round k a node passes its level, and 2^k more, to who is 2^k on."""
    now = scratch.table(ways.select("id", "to", F.lit(0).alias("level")), "lv-forest-0")
    longest = math.ceil(math.log2(max(2, now.count()))) + 1
    for k in itertools.count():
        if now.where("to is not null").isEmpty():
            return now.select("id", "level")
        if k > longest:
            raise ValueError("the graph has a cycle")
        given = now.where("to is not null").groupBy(F.col("to").alias("id")).agg((F.max("level") + 2**k).alias("_l"))
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_t"))
        nxt = now.join(large(given), "id", "left").join(large(far), "to", "left")
        now = scratch.table(nxt.select("id", F.col("_t").alias("to"), F.greatest("level", F.coalesce("_l", "level")).cast("int").alias("level")), f"lv-forest-{k + 1}")


def accumulate_forest(parents: DataFrame, values: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``id, total``: sum of ``value`` over each node and all nodes upstream of it.

    ``parents`` is (id, parent), at most one row for each id. Pointers double: in round k a node passes
    its sum to the ancestor 2^k away, so rounds grow with the logarithm of the depth.
    """
    scratch = scratch.merged()
    now = scratch.table(values.select("id", F.col("value").cast("double").alias("total")).join(large(parents), "id", "left").select("id", "total", F.col("parent").alias("jump")), "acc-0")
    for k in range(1, rounds + 1):
        given = now.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("total").alias("more"))
        hop = now.select(F.col("id").alias("jump"), F.col("jump").alias("far"))
        nxt = now.join(large(given), "id", "left").join(large(hop), "jump", "left")
        now = scratch.table(nxt.select("id", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), F.col("far").alias("jump")), f"acc-{k}")
        if now.where("jump is not null").isEmpty():
            return now.select("id", "total")
    raise RuntimeError("the forest has a cycle")


def _circles(ways: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id`` of the nodes on circles of (id, to): where pointers still lie after as many steps as there are ways."""
    now = scratch.table(ways.where("to is not null").select("id", "to"), f"{name}-0")
    for k in range(1, math.ceil(math.log2(max(2, now.count()))) + 2):
        if now.isEmpty():
            break
        now = scratch.table(now.join(now.select(F.col("id").alias("to"), F.col("to").alias("_t")), "to").select("id", F.col("_t").alias("to")), f"{name}-{k}")
    return now.select(F.col("to").alias("id")).distinct()


def _mutual_merged(e: DataFrame, values: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, values and ``id, g`` once nodes that have edges both ways are one, as often as that brings more."""
    label = values.select("id", F.col("id").alias("g"))
    for k in itertools.count():
        both = scratch.table(e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi"), f"acc-mutual-{k}")
        if both.isEmpty():
            return e, values, label
        one = components(both, scratch, f"acc-one-{k}")
        of = lambda c: one.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
        label = scratch.table(label.join(of("g"), "g", "left").select("id", F.coalesce("_g", "g").alias("g")), f"acc-label-{k}")
        values = scratch.table(values.join(of("id"), "id", "left").groupBy(F.coalesce("_id", "id").alias("id")).agg(F.sum("value").alias("value")), f"acc-values-{k}")
        moved = e.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
        e = scratch.table(moved.where("u <> v").distinct(), f"acc-merged-{k}")


def accumulate(edges: DataFrame, values: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """As ``accumulate_forest`` for any graph: each distinct ancestor counts once, a node also for itself.

    Nodes without a value count nothing; cycles do no harm. Nodes with edges both ways are merged first.
    What no branching node or circle leads to is a forest, whose sums go to the node it drains to. In the
    rest, a node with one predecessor adds itself to that one's total, and what lies between two joints
    (branching or meeting nodes) is one sum, so pairs of ancestor and node are made of joints alone.
    """
    scratch = scratch.merged()
    e = scratch.table(edges.where("u <> v").select("u", "v").distinct(), "acc-edges")
    given = values.groupBy("id").agg(F.sum(F.col("value").cast("double")).alias("value"))
    ids = e.select(F.col("u").alias("id")).union(e.select("v")).union(values.select("id")).distinct()
    whole = scratch.table(ids.join(given, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value")), "acc-values")
    e, own, label = _mutual_merged(e, whole, scratch)

    # forest: what neither a branching node nor a circle leads to
    outs = scratch.table(e.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("to")), "acc-outs")
    branching = outs.where("n > 1").select("id")
    circles = _circles(outs.where("n = 1").select("id", "to"), scratch, "acc-circles")
    core = scratch.table(descendants(e, branching.union(circles).distinct(), scratch, "acc-core"), "acc-core-all")
    trees = outs.join(core, "id", "left_anti").select("id", F.col("to").alias("parent"))
    held = scratch.table(accumulate_forest(trees, own, scratch, rounds), "acc-held")
    total = held.join(core, "id", "left_anti")
    if not core.isEmpty():
        total = total.union(_accumulate_joints(e.join(core.select(F.col("id").alias("u")), "u", "left_semi"), held.join(core, "id", "left_semi"), scratch, rounds))
    return label.join(total.withColumnRenamed("id", "g"), "g").select("id", "total")


def _accumulate_joints(e: DataFrame, weights: DataFrame, scratch: Scratch, rounds: int) -> DataFrame:
    """``id, total`` for (id, total) of nodes' own weights, by pairs of joints."""
    ups = e.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("u").alias("up"))
    downs = e.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("v").alias("on"))
    nodes = weights.withColumnRenamed("total", "w").join(ups, "id", "left").join(downs, "id", "left").fillna(0, ["n_in", "n_out"])
    nodes = scratch.table(nodes, "joint-nodes")
    rings = _circles(nodes.where("n_in = 1").select("id", F.col("up").alias("to")), scratch, "joint-circles").withColumn("_ring", F.lit(True))
    nodes = scratch.table(nodes.join(rings, "id", "left").withColumn("joint", (F.col("n_in") != 1) | F.col("_ring").isNotNull()).drop("_ring"), "joint-nodes-marked")
    head = ends_of(nodes.select("id", F.when(~F.col("joint"), F.col("up")).alias("to")), scratch, "joint-heads")
    last = ends_of(nodes.select("id", F.when(~F.col("joint") & (F.col("n_out") == 1), F.col("on")).alias("to")), scratch, "joint-ends")
    units = last.join(nodes.select("id", "w"), "id").groupBy(F.col("end").alias("a")).agg(F.sum("w").alias("w"))
    inner = last.where("id = end").select(F.col("id").alias("u"))
    step = e.join(inner, "u").join(last.select(F.col("id").alias("v"), "end"), "v").select(F.col("u").alias("a"), F.col("end").alias("id")).distinct()
    step = scratch.table(step, "joint-step-0")
    pairs, known = scratch.table(inner.select(F.col("u").alias("a"), F.col("u").alias("id")), "joint-pairs-0"), 0
    for k in range(1, rounds + 1):
        more = pairs.select("a", F.col("id").alias("mid")).join(step.select(F.col("a").alias("mid"), "id"), "mid").select("a", "id")
        pairs = scratch.table(pairs.union(more).distinct(), f"joint-pairs-{k}")
        n = pairs.count()
        if n == known:
            break
        known = n
        step = scratch.table(step.select("a", F.col("id").alias("mid")).join(step.select(F.col("a").alias("mid"), "id"), "mid").select("a", "id").distinct(), f"joint-step-{k}")
    else:
        raise RuntimeError(f"paths of more than 2^{rounds} joints")
    at_joints = pairs.join(units, "a").groupBy("id").agg(F.sum("w").alias("total"))
    # a node that leads back to its joint is among that joint's ancestors already
    known_there = pairs.select(F.col("a").alias("last"), F.col("id").alias("head"), F.lit(True).alias("_back"))
    way = nodes.join(head.select("id", F.col("end").alias("head")), "id").join(last.select("id", F.col("end").alias("last")), "id").join(known_there, ["last", "head"], "left")
    way = way.select("id", "head", F.when(~F.col("joint"), F.col("up")).alias("to"), F.when(F.col("joint") | F.col("_back").isNotNull(), 0.0).otherwise(F.col("w")).alias("more"))
    now = scratch.table(way, "joint-way-0")
    for k in itertools.count(1):
        if now.where("to is not null").isEmpty():
            break
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_t"), F.col("more").alias("_m"))
        now = scratch.table(now.join(far, "to", "left").select("id", "head", F.col("_t").alias("to"), (F.col("more") + F.coalesce("_m", F.lit(0.0))).alias("more")), f"joint-way-{k}")
    return now.join(at_joints.select(F.col("id").alias("head"), "total"), "head").select("id", (F.col("total") + F.col("more")).alias("total"))


def min_spanning_forest(edges: DataFrame, scratch: Scratch, weight: str = "length", rounds: int = 40) -> DataFrame:
    """``u, v, key`` of the undirected minimum spanning forest; ties go to the least (u, v, key).

    Each round every component takes its least edge to another one, and components merge along them. As edges are
    in one order, these ways meet in pairs that took the same edge, whose lesser one names the merged component:
    pointers to it double. Of the edges between two components only the least is carried on, so that edges grow
    fewer with the components.
    """
    scratch = scratch.merged()
    least = lambda df: df.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
    e = scratch.table(least(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.col(weight).alias("w"), "u", "v", "key").alias("e"))), "msf-0")
    tree = None
    for k in range(1, rounds + 1):
        ends = e.select(F.col("a").alias("id"), F.struct("e", F.col("b").alias("to")).alias("m")).union(e.select("b", F.struct("e", "a")))
        picked = scratch.table(ends.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.e", "m.to"), f"msf-picked-{k}")
        if picked.isEmpty():
            break
        tree = picked.select("e") if tree is None else tree.union(picked.select("e"))
        same = picked.select(F.col("to").alias("id"), F.col("id").alias("to"), F.lit(True).alias("_same"))
        ways = picked.join(same, ["id", "to"], "left").select("id", F.when(F.col("_same").isNull() | (F.col("id") > F.col("to")), F.col("to")).alias("to"))
        merged = ends_of(ways, scratch, f"msf-ways-{k}")
        end = lambda c: merged.select(F.col("id").alias(c), F.col("end").alias(f"_{c}"))
        e = scratch.table(least(e.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "e")), f"msf-{k}")
        scratch.drop(f"msf-{k - 1}")
    return (edges.limit(0) if tree is None else tree.select("e.*")).select("u", "v", "key").distinct()


def _moved(sym: DataFrame, scratch: Scratch, name: str, tol: float, share: float) -> tuple[DataFrame, float]:
    """``id, community`` after rounds of moves on one level of the graph, and its modularity.

    In a round half of the nodes, drawn by their hash, may move to the neighbouring community of largest
    gain, and in the next round the other half, so that neighbours don't swap for ever. Moves of a round
    are made together and may spoil each other: rounds end when two in a row gain less than ``tol`` and
    ``share`` of the modularity, and the best labels seen are given back. A round also tells how much weight
    lies inside the communities that it starts from, so their modularity costs no join of its own.
    """
    degree = sym.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    now = best = scratch.table(degree.select("id", F.col("id").alias("community"), "k"), f"{name}-0")
    row = sym.agg(F.sum("w").alias("w"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loops")).first()  # one row
    total, loops = row["w"] or 1.0, row["loops"] or 0.0
    across = sym.where("u <> v")
    value, idle = float("-inf"), 0
    for r in itertools.count(1):
        weight_of = now.groupBy("community").agg(F.sum("k").alias("tot"))
        near = across.join(now.select(F.col("id").alias("v"), "community"), "v").select(F.col("u").alias("id"), "community", "w")
        # a node's own community is always among its offers, be there a neighbour in it or not
        near = near.union(now.select("id", "community", F.lit(0.0))).groupBy("id", "community").agg(F.sum("w").alias("inside"))
        offer = near.join(weight_of, "community").join(now.select("id", F.col("community").alias("now"), "k"), "id")
        stays = F.col("community") == F.col("now")
        gain = F.round(F.col("inside") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
        top = offer.withColumn("g", gain).groupBy("id").agg(
            F.first("now").alias("now"), F.first("k").alias("k"), F.max(F.when(stays, F.col("g"))).alias("stay"), F.max(F.when(stays, F.col("inside"))).alias("held"),
            F.min(F.when(~stays, F.struct((-F.col("g")).alias("g"), "community"))).alias("best"),
        )
        turn = F.pmod(F.xxhash64("id", F.lit((r - 1) // 2)), F.lit(2)) == r % 2
        to = F.when(turn & (-F.col("best.g") > F.col("stay")), F.col("best.community")).otherwise(F.col("now"))
        after = scratch.table(top.select("id", to.alias("community"), "k", "held"), f"{name}-{r}")
        row = after.agg(F.sum("held").alias("held")).crossJoin(weight_of.agg(F.sum(F.col("tot") * F.col("tot")).alias("kk"))).first()  # one row each
        new = ((row["held"] or 0.0) + loops) / total - (row["kk"] or 0.0) / total**2
        idle = 0 if new > value + max(tol, share * abs(value) if math.isfinite(value) else 0.0) else idle + 1
        if new > value:
            best, value = now, new
        if idle == 2:
            return best.select("id", "community"), value
        now = after.drop("held")


def communities(edges: DataFrame, scratch: Scratch, weight: str = "length", tol: float = 1e-6, share: float = 0.01) -> DataFrame:
    """``id, community`` by modularity: moves on the graph, then on the graph of its communities, and so on.

    Each level moves nodes until that gains less than ``share`` of the modularity, as the next level moves
    whole groups for less; communities become the nodes of the next level, with the weight among their
    members as a loop. The levels end when one gains less than ``tol``. Ties go to the least community,
    which carries the name of one of its members.
    """
    scratch = scratch.merged()
    sym = edges.where("u <> v").select("u", "v", F.col(weight).alias("w"))
    sym = scratch.table(sym.union(sym.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")), "com-edges")
    label, last = None, float("-inf")
    for level in itertools.count():
        found, value = _moved(sym, scratch, f"com-{level}", tol, share)
        if label is not None and value <= last + tol:
            return label
        whole = found if label is None else label.join(found.select(F.col("id").alias("community"), F.col("community").alias("c")), "community").select("id", F.col("c").alias("community"))
        label, last = scratch.table(whole, f"com-label-{level}"), value
        ends = [found.select(F.col("id").alias(e), F.col("community").alias(f"c{e}")) for e in "uv"]
        sym = scratch.table(sym.join(ends[0], "u").join(ends[1], "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), f"com-edges-{level}")


def modularity(edges: DataFrame, label: DataFrame, weight: str = "length") -> DataFrame:
    """One row ``value``."""
    e = edges.where("u <> v").select("u", "v", F.col(weight).alias("w"))
    both = e.join(label.select(F.col("id").alias("u"), F.col("community").alias("a")), "u").join(label.select(F.col("id").alias("v"), F.col("community").alias("b")), "v")
    ends = both.select(F.col("a").alias("c"), "w").union(both.select("b", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    m = both.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).crossJoin(m).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("value"))  # one row each


def degree(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree``."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def indexed(nodes: DataFrame, order: str) -> DataFrame:
    """``id, idx``: position by ``order``, counted inside ranges (as many as the session shuffles to) and lifted
    by what lies before each."""
    ranged = nodes.select("id", F.col(order).alias("_o")).repartitionByRange("_o", "id").withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy("_o", "id")
    ranged = ranged.withColumn("_k", F.row_number().over(inside))
    sizes = ranged.groupBy("_p").agg(F.max("_k").alias("_n"))  # one row a range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(F.broadcast(before), "_p").select("id", (F.col("_k") + F.col("_b") - 1).cast("long").alias("idx"))


def numbered(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``id, i`` of the nodes of the simple undirected graph, and its edges ``a, b`` by number, so that lists stay small."""
    s = scratch.table(_simple(edges), "named")
    ids = scratch.table(s.select(F.col("a").alias("id")).union(s.select("b")).distinct(), "ids")
    kind = "int" if ids.count() < 2**31 else "long"
    index = scratch.table(indexed(ids.withColumn("o", F.lit(0)), "o").select("id", F.col("idx").cast(kind).alias("i")), "index")
    end = lambda c: index.select(F.col("id").alias(c), F.col("i").alias(f"_{c}"))
    return index, scratch.table(s.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "numbers")


def placed(s: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, da, db``: the edges (a, b) both ways with the degrees of their ends."""
    both = s.union(s.select("b", "a"))
    deg = scratch.table(both.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "degrees")
    return scratch.table(both.join(deg.select("a", F.col("d").alias("da")), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").select("a", "b", "da", "db"), "placed")


def triangles(at: DataFrame) -> DataFrame:
    """``i, degree, triangles, clustering`` from ``placed`` edges.

    Edges point from the node of lesser degree, so a list of heads is no longer than the root of twice the edges.
    Each edge takes the heads behind its own to its head, whose list they are met with: lists are shuffled, never wedges.
    """
    up = F.struct("da", "a") < F.struct("db", "b")
    heads = at.where(up).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("db", "b"))).alias("o")).select("a", F.col("o.b").alias("heads"))
    sent = heads.where("size(heads) > 1").select("a", "heads", F.posexplode("heads").alias("k", "b")).where("k + 1 < size(heads)").select("a", "b", F.expr("slice(heads, k + 2, size(heads))").alias("rest"))
    met = sent.join(large(heads.select(F.col("a").alias("b"), F.col("heads").alias("own"))), "b").select("a", "b", F.array_intersect("rest", "own").alias("z")).where("size(z) > 0")
    each = met.select(F.explode(F.concat("z", F.expr("array_repeat(a, size(z))"), F.expr("array_repeat(b, size(z))"))).alias("i"))
    deg = at.groupBy(F.col("a").alias("i")).agg(F.first("da").alias("degree"))
    t, d = F.coalesce("triangles", F.lit(0)), F.col("degree")
    return deg.join(large(each.groupBy("i").agg(F.count(F.lit(1)).alias("triangles"))), "i", "left").select("i", "degree", t.alias("triangles"), F.when(d > 1, t * 2.0 / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def clustering(edges: DataFrame) -> DataFrame:
    """``id, degree, triangles, clustering`` of the simple undirected graph."""
    scratch = Scratch(edges.sparkSession, "clustering").merged()
    index, s = numbered(edges, scratch)
    return index.join(triangles(placed(s, scratch)), "i").drop("i")


def ego(edges: DataFrame, heavy: int = 1_000) -> DataFrame:
    """``id, ego_edges, ego_neighbours, ego_out``: of the node with its neighbours: edges inside, distinct
    neighbours outside, edges to the outside.
    """
    scratch = Scratch(edges.sparkSession, "ego").merged()
    index, s = numbered(edges, scratch)
    at = placed(s, scratch)
    return index.join(egos(at, triangles(at), heavy), "i").drop("i")


#: Pairs of nodes that one task tells apart.
_PAIRS = 4_000_000


def egos(at: DataFrame, own: DataFrame, heavy: int = 1_000) -> DataFrame:
    """As ``ego`` by number, from ``placed`` edges and their ``triangles``.

    Edges follow from degrees and triangles. Neighbours outside are paired through nodes of up to ``heavy``
    neighbours, so pairs are at most ``heavy`` times edges. Such a node's neighbours are one list, which goes
    to each of them; pairs are made, and told apart, in the task that holds their first node. Through heavier
    nodes nothing is paired: all that lies beside a set of them is counted once for each distinct set, and a
    pair that such a node joins, too, is left out of the others (each node carries the list of its heavy
    neighbours).
    """
    spark, both = at.sparkSession, at.select("a", "b")
    light = at.where(F.col("db") <= heavy).select("a", F.col("b").alias("m"))
    some = not at.where(F.col("db") > heavy).isEmpty()
    hubs = at.where(F.col("db") > heavy).groupBy(F.col("a").alias("i")).agg(F.array_sort(F.collect_list("b")).alias("hubs"))
    hubs_of = lambda end: large(hubs.select(F.col("i").alias(end), F.col("hubs").alias(f"h{end}")))
    # light centres, towards nodes without a heavy neighbour: a centre's number comes negative, as it is a neighbour itself
    plain = light.join(hubs_of("a"), "a", "left_anti") if some else light
    lists = plain.groupBy("m").agg(F.collect_list("a").alias("near"))
    pairs = at.where(F.col("db") <= heavy).agg(F.sum("db")).first()[0] or 0  # one row
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // _PAIRS)
    sent = at.select("a", F.col("b").alias("m")).join(large(lists), "m", "left")
    codes = sent.select("a", F.when(F.col("near").isNull(), F.array(-1 - F.col("m"))).otherwise(F.concat(F.array(-1 - F.col("m")), "near")).alias("n")).repartition(parts, "a").select("a", F.explode("n").alias("x"))
    code = codes.select("a", F.when(F.col("x") < 0, -1 - F.col("x")).otherwise(F.col("x")).alias("b"), (F.col("x") < 0).alias("next"))
    by_light = code.where("a <> b").groupBy("a", "b").agg(F.max("next").alias("next")).where("not next").groupBy(F.col("a").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    steps = at.groupBy(F.col("a").alias("i")).agg(F.sum("db").alias("steps"))
    out = own.join(large(steps), "i").join(large(by_light), "i", "left")
    beyond = F.coalesce("n", F.lit(0))
    if some:
        # light centres, towards nodes with heavy neighbours: those that share one are counted below
        apart = light.join(large(light.join(hubs_of("a").select("a"), "a", "left_semi").select("m", F.col("a").alias("b"))), "m").where("a <> b").select("a", "b").distinct().join(large(both), ["a", "b"], "left_anti")
        shared = apart.join(hubs_of("a"), "a", "left").join(hubs_of("b"), "b").where(~F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False)))
        by_hubbed = shared.groupBy(F.col("a").alias("i")).agg(F.count(F.lit(1)).alias("h"))
        # heavy centres: what lies beside the set, less the node itself and its neighbours there
        beside = hubs.select("hubs").distinct().select("hubs", F.explode("hubs").alias("b")).join(large(both), "b").groupBy("hubs").agg(F.countDistinct("a").alias("beside"))
        near = both.join(hubs_of("a"), "a").join(hubs_of("b"), "b").where(F.arrays_overlap("ha", "hb")).groupBy(F.col("a").alias("i")).agg(F.count(F.lit(1)).alias("near"))
        by_heavy = hubs.join(large(beside), "hubs").join(large(near), "i", "left").select("i", (F.col("beside") - 1 - F.coalesce("near", F.lit(0))).alias("far"))
        out = out.join(large(by_hubbed), "i", "left").join(large(by_heavy), "i", "left")
        beyond = beyond + F.coalesce("h", F.lit(0)) + F.coalesce("far", F.lit(0))
    return out.select(
        "i",
        (F.col("degree") + F.col("triangles")).alias("ego_edges"),
        beyond.alias("ego_neighbours"),
        (F.col("steps") - F.col("degree") - 2 * F.col("triangles")).alias("ego_out"),
    )


def spmv(coo: DataFrame, vec: DataFrame) -> DataFrame:
    """``i, x``: sparse matrix (i, j, w) times vector (i, x)."""
    return coo.join(vec.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def _leaves_folded(e: DataFrame, nodes: DataFrame, least: float, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The nodes ``id, s, t`` and edges that are left once leaves are folded into their only neighbour.

    ``s`` and ``t`` count the sources that reach a node and the targets it reaches in what it has taken in,
    itself included. A round's leaves (id, p, s, t, up, down) come back in order, ``up`` and ``down`` for
    the edges (id, p) and (p, id). Rounds end where less than the share ``least`` of the nodes would go:
    what is left is walked, with the same result.
    """
    rounds: list[DataFrame] = []
    left = nodes.count()
    for k in itertools.count(1):
        pairs = e.select(F.col("u").alias("id"), F.col("v").alias("p"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", "u", F.lit(0), F.lit(1)))
        beside = pairs.groupBy("id", "p").agg(F.max("up").alias("up"), F.max("down").alias("down"))
        ends = scratch.table(beside.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("p"), F.first("up").alias("up"), F.first("down").alias("down")).where("n = 1").drop("n"), f"{name}-ends-{k}")
        # of two nodes that have only each other, the lesser stays
        kept = ends.select(F.col("id").alias("p"), F.col("p").alias("id"), F.lit(True).alias("_both"))
        gone = scratch.table(ends.join(kept, ["id", "p"], "left").where("_both is null or id > p").drop("_both").join(nodes, "id"), f"{name}-gone-{k}")
        n = gone.count()
        if n == 0 or n < least * left:
            return nodes, e, rounds
        given = gone.groupBy(F.col("p").alias("id")).agg(F.sum(F.col("s") * F.col("up")).alias("_s"), F.sum(F.col("t") * F.col("down")).alias("_t"))
        rest = nodes.join(gone.select("id"), "id", "left_anti").join(given, "id", "left")
        nodes = scratch.table(rest.select("id", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in "st")), f"{name}-nodes-{k}")
        ids = gone.select("id")
        e = scratch.table(e.join(ids.withColumnRenamed("id", "u"), "u", "left_anti").join(ids.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"), f"{name}-rest-{k}")
        rounds.append(gone)
        left -= n


def _walked(e: DataFrame, nodes: DataFrame, starts: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of sources: ``u, v, f`` (flow of an edge), ``id, t`` (targets a source reaches), ``id, s`` (sources that reach a node)."""
    front = scratch.table(starts.select(F.col("id").alias("src"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")), f"{name}-0")
    seen, steps = front, []
    for k in itertools.count(1):
        went = front.join(e.select(F.col("u").alias("id"), F.col("v").alias("to")), "id").select("src", F.col("to").alias("id"), "paths")
        new = went.join(seen.select("src", "id"), ["src", "id"], "left_anti").groupBy("src", "id").agg(F.sum("paths").alias("paths"))
        front = scratch.table(new.select("src", "id", F.lit(k).alias("d"), "paths"), f"{name}-{k}")
        if front.isEmpty():
            break
        steps.append(front)
        seen = seen.union(front)
        if k % _GATHER == 0:
            seen = scratch.table(seen, f"{name}-seen-{k}")
    seen = scratch.table(seen, f"{name}-seen")
    flows, delta = None, None
    for k in range(len(steps), 0, -1):
        heads = steps[k - 1].join(nodes.select("id", "t"), "id")
        gain = heads.withColumn("dep", F.col("t").cast("double")) if delta is None else heads.join(delta, ["src", "id"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)) + F.col("t"))
        tails = seen.where(F.col("d") == k - 1).select("src", F.col("id").alias("u"), F.col("paths").alias("p"))
        flow = gain.select("src", F.col("id").alias("v"), "paths", "dep").join(e, "v").join(tails, ["src", "u"])
        flow = scratch.table(flow.select("src", "u", "v", (F.col("p") / F.col("paths") * F.col("dep")).alias("f")), f"{name}-flow-{k}")
        flows = flow if flows is None else flows.union(flow)
        delta = flow.groupBy("src", F.col("u").alias("id")).agg(F.sum("f").alias("dep"))
    weight = nodes.select(F.col("id").alias("src"), "s")
    flows = e.limit(0).select(F.col("u").alias("src"), "u", "v", F.lit(0.0).alias("f")) if flows is None else flows
    by_edge = scratch.table(flows.join(weight, "src").groupBy("u", "v").agg(F.sum(F.col("f") * F.col("s")).alias("f")), f"{name}-edges")
    out = scratch.table(seen.join(nodes.select("id", "t"), "id").groupBy(F.col("src").alias("id")).agg(F.sum("t").alias("t")), f"{name}-targets")
    into = scratch.table(seen.join(weight, "src").groupBy("id").agg(F.sum("s").alias("s")), f"{name}-sources")
    return by_edge, out, into


def betweenness(edges: DataFrame, sources: DataFrame, scratch: Scratch, of: str = "edge", state: int = 200_000_000, least: float = 0.05) -> DataFrame:
    """Shortest-path betweenness by hops from ``sources``, of edges (``u, v, value``) or nodes (``id, value``).

    Leaves are folded away first, as long as a round takes at least the share ``least`` of the nodes: what
    passes them is a product of counts. The rest is walked level by level in batches of sources, each with
    at most about ``state`` rows (source, node, hops, paths); a batch leaves its sums, and its tables are
    dropped. Normalised by n (n - 1) for edges and (n - 1) (n - 2) for nodes, times n / number of sources
    where only some are used.
    """
    scratch = scratch.merged()
    e = scratch.table(edges.select("u", "v").where("u <> v").distinct(), f"bt-{of}-edges")
    every = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    start = sources.select("id").distinct().withColumn("s", F.lit(1).cast("long"))
    nodes = scratch.table(every.join(start, "id", "left").select("id", F.coalesce("s", F.lit(0)).cast("long").alias("s"), F.lit(1).cast("long").alias("t")), f"bt-{of}-nodes")
    n = nodes.count()
    core, rest, rounds = _leaves_folded(e, nodes, least, scratch, f"bt-{of}-fold")
    # a core node without a source still walks where a leaf asks how far it reaches
    starts = core if rounds else core.where("s > 0")
    batches = max(1, math.ceil(starts.count() * core.count() / state))
    parts = []
    for b in range(batches):
        own = Scratch(scratch.spark, f"bt-{of}-batch-{b}").merged()
        mine = starts if batches == 1 else starts.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        parts.append([scratch.table(x, f"bt-{of}-{what}-{b}") for what, x in zip(("flow", "out", "in"), _walked(rest, core, mine, own, "w"))])
        own.drop()
    whole = [parts[0][i] for i in range(3)]
    for part in parts[1:]:
        whole = [a.union(b) for a, b in zip(whole, part)]
    flows = whole[0].groupBy("u", "v").agg(F.sum("f").alias("f"))
    # beyond: targets a node reaches, and sources that reach it, outside of what was folded into it
    out, into = whole[1].withColumnRenamed("t", "_t"), whole[2].groupBy("id").agg(F.sum("s").alias("_s"))
    far = core.join(out, "id", "left").join(into, "id", "left")
    now = scratch.table(far.select("id", "s", "t", (F.coalesce("_t", "t") - F.col("t")).alias("out"), (F.coalesce("_s", "s") - F.col("s")).alias("into")), f"bt-{of}-beyond-0")
    for k, gone in enumerate(reversed(rounds), 1):
        near = gone.join(now.select(F.col("id").alias("p"), F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("out").alias("_out"), F.col("into").alias("_into")), "p")
        out = F.col("up") * (F.col("_out") + F.col("_t") - F.col("t") * F.col("down"))
        into = F.col("down") * (F.col("_into") + F.col("_s") - F.col("s") * F.col("up"))
        near = scratch.table(near.select("id", "p", "s", "t", "up", "down", out.alias("out"), into.alias("into")), f"bt-{of}-near-{k}")
        flows = flows.union(near.where("up = 1").select(F.col("id").alias("u"), F.col("p").alias("v"), (F.col("s") * F.col("out")).cast("double").alias("f")))
        flows = flows.union(near.where("down = 1").select(F.col("p").alias("u"), F.col("id").alias("v"), (F.col("t") * F.col("into")).cast("double").alias("f")))
        now = scratch.table(now.union(near.select(*now.columns)), f"bt-{of}-beyond-{k}")
    flows = scratch.table(flows, f"bt-{of}-flows")
    lift = n / max(1, sources.select("id").distinct().count())
    if of == "edge":
        return e.join(flows, ["u", "v"], "left").select("u", "v", (F.coalesce("f", F.lit(0.0)) * lift / max(1, n * (n - 1))).alias("value"))
    # what leaves a node, but for what starts there: all it reaches in what it took in and beyond, where it is a source itself
    sent = flows.groupBy(F.col("u").alias("id")).agg(F.sum("f").alias("f"))
    own = nodes.select("id", F.col("s").alias("_own")).join(now, "id").select("id", (F.col("_own") * (F.col("out") + F.col("t") - 1)).alias("own"))
    through = F.coalesce("f", F.lit(0.0)) - F.col("own")
    return own.join(sent, "id", "left").select("id", (through * lift / max(1, (n - 1) * (n - 2))).alias("value"))
