"""Hard negatives by threshold joins: an inverted index of the dimensions that can matter, partial scores, and
thresholds that fall until every window is full."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, parts_for, shuffle_parts

#: Dimensions that are accumulated at once.
_RUN = 8
#: Parts of a window that the rounds search, from its top.
SHARES = (0.25, 0.5, 1.0)
_SOUND = "{v} is not null and {label} is not null and {id} is not null and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Each component times ``scale``, rounded down."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = np.abs(x).max(initial=0)
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    return x.astype(kind)


class Index:
    """Inverted index of a shard's rows: dimensions ascend by their weight, and a row's light head is left out."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort((x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = x[:, self.order]
        self.norms = _prefix_norms(self.x)

    def pairs(self, q: np.ndarray, least: np.ndarray, together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of every pair whose score is ``least[query]`` or more; scores are exact integers.

        A few queries of similar thresholds go together. Dimensions of a row before place p stay out of
        the index if norm of its head times norm of each query's head lies below the threshold: whoever
        meets the row there alone can't reach it. The indexed dimensions are added up from the heaviest
        one down; rows that no query can reach with what remains are dropped on the way. What is left
        gets its head added.
        """
        q = q[:, self.order]
        norms = _prefix_norms(q)
        exact = self.norms[:, -1].max(initial=0) * norms[:, -1].max(initial=0)
        kind = np.float32 if exact < 2**24 else np.float64 if exact < 2**53 else object  # sums stay exact integers
        if kind is object:  # Python's own integers
            q, x, d = q.astype(np.int64), self.x.astype(np.int64).astype(object), q.shape[1]
        else:
            x, d = self.x.astype(kind), q.shape[1]
        starts = list(range(0, d, _RUN)) or [0]
        rank = np.argsort(least / np.maximum(norms[:, -1], 1e-300), kind="stable")
        for own in (rank[i : i + together] for i in range(0, len(rank), together)):
            low = least[own].astype(np.float64)
            head = np.zeros(len(x), np.int64)  # first indexed dimension, a multiple of the run
            for p in [*starts[1:], d]:
                with np.errstate(divide="ignore", invalid="ignore"):
                    limit = np.where(norms[own, p] > 0, low / norms[own, p], np.where(low > 0, np.inf, -np.inf)).min()
                covered = self.norms[:, p] * (1 + 1e-9) < limit
                head[covered] = p
                if not covered.any():
                    break
            alive = np.flatnonzero(head < d) if d else np.flatnonzero(np.full(len(x), low.min(initial=np.inf) <= 0))
            alive = alive[np.argsort(head[alive], kind="stable")]
            part = np.zeros((len(own), len(alive)), kind)
            for p in reversed(starts if d else []):
                n = int(np.searchsorted(head[alive], p, "right"))  # rows whose list holds these dimensions
                if not n:
                    continue
                part[:, :n] += q[own, p : p + _RUN].astype(kind) @ x[alive[:n], p : p + _RUN].T
                if kind is not object and p and p % (2 * _RUN) == 0:
                    rest = norms[own, p][:, None] * self.norms[alive[:n], p][None, :]
                    keep = np.ones(len(alive), bool)
                    keep[:n] = (part[:, :n] + rest * (1 + 1e-9) >= low[:, None]).any(0)
                    if keep.mean() < 0.8:
                        alive, part = alive[keep], part[:, keep]
            cut = head[alive]
            bound = part.astype(np.float64) + norms[own][:, cut] * self.norms[alive, cut][None, :] * (1 + 1e-9)
            a, b = np.nonzero(bound + 1e-6 >= low[:, None])
            score, where = part[a, b], alive[b]
            for p in np.unique(cut[b]):
                if p:
                    at = np.flatnonzero(cut[b] == p)
                    for s in range(0, len(at), 100_000):
                        k = at[s : s + 100_000]
                        score[k] += (q[own[a[k]], :p].astype(kind) * x[where[k], :p]).sum(1)
            score = score.astype(np.int64)
            good = score >= low[a]
            yield own[a[good]], where[good], score[good]


def _prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row's first 0, 1, ... components."""
    out = np.zeros((x.shape[0], x.shape[1] + 1))
    np.cumsum(x.astype(np.float64) ** 2, axis=1, out=out[:, 1:])
    return np.sqrt(out)


def _firsts(who: np.ndarray, score: np.ndarray, ident: np.ndarray, asked: dict, k: int) -> np.ndarray:
    """Which pairs are among the first ``k`` of some window of their query."""
    order = np.lexsort((ident, -score, who))
    who, falling = who[order], -score[order]
    keep = np.zeros(len(order), bool)
    starts = np.searchsorted(who, np.arange(len(asked["key"]) + 1))
    for i in np.unique(who):
        a, b = starts[i], starts[i + 1]
        for w in range(asked["begin"][i], asked["begin"][i + 1]):
            first = a + np.searchsorted(falling[a:b], -asked["high"][w])
            last = a + np.searchsorted(falling[a:b], -asked["low"][w], "right")
            keep[first : min(first + k, last)] = True
    return order[keep]


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    scratch: Scratch,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    shard_rows: int = 65_536,
    block_rows: int = 1_024,
    shares: tuple[float, ...] = SHARES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors hold integers; a row's score is its inner product with the anchor, and scores must fit a long.
    An anchor's positives are its first ``positives`` other rows of the same label, by falling score and
    then by id. For each, the first ``negatives`` rows of other labels are returned whose score is between
    ``low`` and ``high`` percent of the positive's, by the same order.

    1. Rows with equal label and vector are one point with their least ids, as many as can matter. Points
       are dealt over shards by hash; a task makes a shard's index.
    2. Anchors in blocks meet one shard each; the last score of their first positives there is a threshold
       that no later positive can miss. Then they meet the other shards with it.
    3. The windows' negatives are looked for from the top: a first threshold join covers a quarter of each
       window, and thresholds fall for those anchors alone that have a window which isn't full yet.

    A block is sent to every shard, ``shard_rows`` large, so what moves is anchors times points by
    ``shard_rows``: that product is asked for. A shard returns what may be in a result and no more:
    ``negatives`` + 1 points a window.

    Rows with null id, label or vector, or with a null or non-finite component, take no part. Repeated rows
    count once; other rows of the anchor's own id never count for it, and different rows of one id each
    count, in no set order where they tie. Vectors of other lengths than the anchor's are not compared with it; zero vectors are. No
    rows give no rows. Other columns are not looked at, whatever their names.
    """
    spark, k = rows.sparkSession, max(positives, negatives) + 1
    scratch = scratch.merged()  # shards and scores pack into few bytes on disk, and would be built on the driver

    def clean(df: DataFrame) -> DataFrame:
        sound = df.where(_SOUND.format(v=f"`{vector}`", label=f"`{label}`", id=f"`{vec_id}`"))
        return sound.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))

    few = clean(rows).withColumn("r", F.dense_rank().over(Window.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("r") <= k)
    points = scratch.table(few.groupBy("label", "v", "dim").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "points")
    parts = shuffle_parts(spark)
    sizes = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))  # one row a length of vectors
    shards = F.greatest(F.ceil(F.col("n") / shard_rows), F.least(F.ceil(F.col("n") / 1_024), F.lit(parts))).cast("int")
    sizes = F.broadcast(scratch.table(sizes.select("dim", shards.alias("shards")), "sizes"))

    def plant(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ids", key=lambda s: s.map(lambda i: i[0]))
        x = np.stack(own["v"].to_numpy()).reshape(len(own), -1)
        ids = [np.asarray(i, np.int64) for i in own["ids"]]
        data = _pack(x=_small(x), label=own["label"].to_numpy(np.int64), point=own["point"].to_numpy(np.int64), ids=np.concatenate(ids), ends=np.cumsum([0, *map(len, ids)]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "index": [data]})

    dealt = points.join(sizes, "dim").withColumn("point", F.xxhash64("label", "v")).withColumn("shard", F.pmod("point", "shards").cast("int"))
    indexes = scratch.table(dealt.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, index binary"), "indexes")
    asked = clean(anchors).distinct().withColumn("key", F.xxhash64("vec_id", "label", "v"))
    asked = scratch.table(asked.join(sizes, "dim").withColumn("home", F.pmod(F.xxhash64("key") % 1_009, "shards").cast("int")), "anchors")

    def block(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(own["v"].to_numpy()).reshape(len(own), -1)
        data = _pack(
            q=_small(q), key=own["key"].to_numpy(np.int64), id=own["vec_id"].to_numpy(np.int64), label=own["label"].to_numpy(np.int64),
            begin=np.cumsum([0, *map(len, own["lows"])]), low=np.concatenate([np.asarray(w, np.float64) for w in own["lows"]]), high=np.concatenate([np.asarray(w, np.float64) for w in own["highs"]]),
        )
        return pd.DataFrame({"dim": [key[0]], "to": [key[1]], "shards": [int(own["shards"].iloc[0])], "block": [data]})

    def meet(same: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    s, b = (_unpack(batch.column(c)[i].as_py()) for c in (0, 1))
                    least = np.minimum.reduceat(b["low"], b["begin"][:-1])
                    groups = [(np.flatnonzero(b["label"] == c), np.flatnonzero(s["label"] == c)) for c in np.intersect1d(b["label"], s["label"])] if same else [(np.arange(len(least)), np.arange(len(s["label"])))]
                    for mine_, theirs in groups:
                        for a, r, score in Index(s["x"][theirs]).pairs(b["q"][mine_], least[mine_]):
                            a, r = mine_[a], theirs[r]
                            first, n = s["ends"][r], s["ends"][r + 1] - s["ends"][r]
                            lead = s["ids"][first] == b["id"][a]  # the anchor's own id, which doesn't count
                            good = ~(lead & (n == 1)) & (same | (b["label"][a] != s["label"][r]))
                            a, r, score, first, n, lead = a[good], r[good], score[good], first[good], n[good], lead[good]
                            keep = _firsts(a, score, s["ids"][first + lead], b, k)
                            a, r, score, first, n = a[keep], r[keep], score[keep], first[keep], n[keep]
                            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                            a, r, score, ids = np.repeat(a, n), np.repeat(r, n), np.repeat(score, n), s["ids"][at]
                            good = ids != b["id"][a]
                            out = (b["key"][a[good]], ids[good], score[good], s["point"][r[good]])
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["key", "vec_id", "score", "point"])

        return run

    def join(open_: DataFrame, same: bool, where: str, name: str) -> DataFrame:
        """key, vec_id, score, point of rows that may be among the first in a window (``lows``, ``highs``) of an anchor."""
        blocks = parts_for(open_.count(), block_rows)
        spread = open_.withColumn("to", (F.col("home") if where == "home" else F.lit(0)) * F.lit(blocks) + F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        packed = spread.groupBy("dim", "to").applyInPandas(block, "dim int, to int, shards int, block binary")
        packed = packed.withColumn("home", F.floor(F.col("to") / blocks).cast("int"))
        if where == "home":
            sent = packed.withColumn("shard", F.col("home"))
        else:
            sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        met = indexes.join(sent.select("dim", "shard", "block"), ["dim", "shard"]).select("index", "block")
        return scratch.table(met.mapInArrow(meet(same), "key long, vec_id long, score long, point long").distinct(), name)

    def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    anywhere = {"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))}
    near = join(asked.withColumns(anywhere), True, "home", "near")
    bar = ranked(near, ["key"], positives).groupBy("key").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).cast("double").alias("bar"))
    from_bar = asked.join(bar, "key", "left").withColumns(anywhere | {"lows": F.array(F.coalesce("bar", F.lit(float("-inf"))))})
    best = ranked(join(from_bar.drop("bar"), True, "all", "far"), ["key"], positives)
    best = scratch.table(best.select("key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = best.where("positive_score >= 0").select("key", F.col("positive_score").alias("top"), F.expr(f"(positive_score * {low} + {high - 1}) div {high}").alias("floor")).distinct()
    windows, found = scratch.table(windows.withColumn("above", F.col("top") + 1), "windows-0"), None
    for i, share in enumerate(shares):
        fall = F.greatest(F.col("floor"), F.col("top") - F.floor((F.col("top") - F.col("floor")) * share)) if share < 1 else F.col("floor")
        step = windows.withColumn("low", fall.cast("long"))
        lists = step.where("low < above").groupBy("key").agg(F.collect_list(F.struct("low", (F.col("above") - 1).alias("high"))).alias("w"))  # ``positives`` at most
        lists = lists.select("key", F.col("w.low").cast("array<double>").alias("lows"), F.col("w.high").cast("array<double>").alias("highs"))
        got = join(asked.join(lists, "key"), False, "all", f"negatives-{i}")
        found = got if found is None else scratch.table(found.union(got).distinct(), f"found-{i}")
        if share >= 1:
            break
        full = step.join(found, "key").where("score between low and top").groupBy("key", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= negatives)
        windows = scratch.table(step.where("low > floor").join(full, ["key", "top"], "left_anti").select("key", "top", "floor", F.col("low").alias("above")), f"windows-{i + 1}")
        if windows.isEmpty():
            break
    inside = best.where("positive_score >= 0").join(found, "key").where(f"{low} * positive_score <= {high} * score and score <= positive_score")
    first = ranked(inside, ["key", "nth"], negatives)
    return first.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
