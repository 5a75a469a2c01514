"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch

#: Hex digits of the group key that name a bucket at first, and by which a bucket that matters is refined.
FIRST_DIGITS, MORE_DIGITS = 3, 2


class _Buckets:
    """Buckets of neighbouring groups in key order: prefix, bytes, groups. Those of one group can't be refined."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = []
        for _, size, _ in self.rows:
            self.ends.append((self.ends[-1] if self.ends else 0) + size)
        self.total = self.ends[-1] if self.ends else 0

    def greedy(self, capacity: int, shards: int, whole: bool) -> list[int]:
        """Ends of the shards that greedy filling gives, ``shards`` at most; it stops where nothing fits.

        With ``whole`` a cut falls between buckets only, which needs as many shards or more than cutting
        between groups; else it may fall at any byte of a bucket of several groups, which needs as many
        or fewer.
        """
        at, i, out = 0, 0, []
        while at < self.total and len(out) < shards:
            goal = at + capacity
            while i < len(self.rows) and self.ends[i] <= goal:
                i += 1
            start = self.ends[i - 1] if i else 0
            end = goal if i < len(self.rows) and not whole and self.rows[i][2] > 1 else start
            if end <= at:
                break
            at = min(end, self.total)
            out.append(at)
        return out

    def least(self, low: int, shards: int, whole: bool) -> int:
        """The smallest capacity from ``low`` on for which ``shards`` shards hold everything."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            fits = self.greedy(mid, shards, whole)[-1:] == [self.total]
            low, high = (low, mid) if fits else (mid + 1, high)
        return low

    def undecided(self, low: int, high: int, shards: int) -> set[str]:
        """Prefixes of buckets of several groups in which a cut may fall, if the capacity is in [low, high]."""
        early, late = self.greedy(low, shards, True), self.greedy(high, shards, False)
        out = set()
        for k in range(shards):
            a = early[k] if k < len(early) else (early[-1] if early else 0)
            b = late[k] if k < len(late) else self.total
            start = 0
            for (name, _, n), end in zip(self.rows, self.ends):
                if n > 1 and start <= b and end >= a and not (a == b == start or a == b == end):
                    out.add(name)
                start = end
        return out

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """Prefixes that start shards 1, 2, ... when whole buckets fill them greedily."""
        ends = set(self.greedy(capacity, shards, True)[:-1])
        return [self.rows[i + 1][0] for i, e in enumerate(self.ends[:-1]) if e in ends]


def minimax_cuts(groups: DataFrame, shards: int, digits: int = FIRST_DIGITS, more: int = MORE_DIGITS) -> list[str]:
    """Keys at which to cut so that the largest of ``shards`` contiguous shards is as small as can be.

    ``groups`` has ``gkey`` (hex text, the order) and ``bytes``, one row for each atomic group. The
    capacity is searched by halving, each candidate checked greedily: once with cuts between buckets
    alone, once with cuts anywhere in a bucket. As long as both differ, in capacity or in the cuts, the
    buckets in which a cut may fall are parted by ``more`` digits of the key. Each shard but the last
    then holds as many groups as the capacity allows. One job
    a round reads bucket sums alone: 16^``digits`` rows at first, then 16^``more`` for each bucket in
    doubt, whose number depends on ``shards`` and not on the groups.
    """

    def sums(of: DataFrame, n: int) -> list[tuple[str, int, int]]:
        rows = of.groupBy(F.substring("gkey", 1, n).alias("b")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"))
        return [(r["b"], r["s"], r["n"]) for r in rows.collect()]

    known = _Buckets(sums(groups, digits))
    if not known.total:
        return []
    largest = groups.agg(F.max("bytes").alias("m")).first()["m"]
    while True:
        low = known.least(max(-(-known.total // shards), largest), shards, whole=False)
        high = known.least(low, shards, whole=True)
        open_ = known.undecided(low, high, shards)
        if low == high and not open_:
            return known.cuts(high, shards)
        by_length: dict[int, list[str]] = {}
        for name in open_:
            by_length.setdefault(len(name), []).append(name)
        finer = []
        for n, names in sorted(by_length.items()):
            finer += sums(groups.where(F.substring("gkey", 1, n).isin(names)), n + more)
        known = _Buckets([r for r in known.rows if r[0] not in open_] + finer)


def shard_column(gkey: Column, cuts: list[str]) -> Column:
    """The shard of a group key: how many cut keys lie at or below it."""
    out = F.lit(0)
    for key in cuts:
        out = out + (gkey >= F.lit(key)).cast("int")
    return out.cast("int")


def group_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def assign_shards(
    docs: DataFrame,
    scratch: Scratch,
    shards: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    salt_digits: int = 3,
) -> DataFrame:
    """Every row with its ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in a shard).

    Law ``bytes``: rows with equal texts form one atomic group, groups lie in the order of their
    SHA-256, and the order is cut where the largest shard's bytes are least. A group is never split, so
    one that is larger than the mean sets the largest shard.

    Slots: rows are numbered within (shard, salt), the salt hashing id and text, and ``shards`` x
    16^``salt_digits`` offsets lift that to the shard. No task gets a whole shard or a whole group of copies.

    Null and empty texts are one group of size 1 a row. A very long text is measured and hashed where it is
    read, and never moves. Repeated rows each get their own slot. Null ids
    sort first. An empty table gives an empty result. Other columns are not read.

    Returns doc_id, size, text_crc32, gkey, shard, slot.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = scratch.table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            group_key(F.col(text)).alias("gkey"),
        ),
        "rows",
    )
    groups = scratch.table(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.withColumn("shard", shard_column(F.col("gkey"), minimax_cuts(groups, shards))).withColumn(
        "salt", F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("gkey")).cast("binary")), 1, salt_digits)
    )
    counted = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    # at most shards x 16 ** salt_digits rows, so this window and broadcast have a fixed bound
    offsets = counted.select(
        "shard",
        "salt",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("first"),
    )
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "gkey")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", "gkey", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
    )
