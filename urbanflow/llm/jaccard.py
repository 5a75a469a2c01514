"""N-gram Jaccard join: blocked sparse products of the document by shingle incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, give_back, parts_for, text_bytes, words_of
from urbanflow.llm.packed import (
    DEALT,
    DEALT_DDL,
    deal,
    gather,
    grams,
    mix,
    pack,
    sequence_id,
    settle,
    shared_pairs,
    sizes_of_runs,
    word_hashes,
)
from urbanflow.operators.components import components

#: Share of hash values whose shingles are counted over all documents before sets are compared.
COUNTED = 0.3
#: Shingles and sets in one block of a product, about.
BLOCK_SHINGLES, BLOCK_SETS = 800_000, 1_600
#: Bits of the filter of rows for each row it lets through, and bits in one of its rows.
FILTER_BITS, FILTER_ROW = 16, 1 << 20


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one shingle."""
    w = word_hashes(words_of(text, lower=True))
    return np.unique(grams(w, n) if len(w) >= n else grams(w, len(w))) if len(w) else np.zeros(0, np.uint64)


def _sets(n: int, parts: int, counted: np.uint64):
    """Rows of two kinds: documents (part below 0), and dealt shingles of distinct sets to ask about.

    A document's ``local`` is how many of its counted shingles other sets of the batch hold; those aren't
    asked about for each document, but once for the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*DEALT.names, "doc_id", "row_key", "set_id", "n", "counted", "local"]
        for batch in batches:
            sets, values, rows = {}, [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, n)
                low = s[: int(np.searchsorted(s, counted))]
                sid = sequence_id(s) if len(s) else None
                rows.append((sid, len(s), len(low)))
                if sid is not None and sid not in sets:
                    sets[sid] = len(sets)
                    values.append(low)
            of = np.repeat(np.arange(len(values)), [len(v) for v in values])
            owners = np.fromiter(sets, np.int64, len(sets))
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            told, _, asking, asked_of, asked = settle(owners, of, flat)
            local = np.bincount(told, minlength=len(sets))
            m = batch.num_rows
            none, key = pa.nulls(m, pa.binary()), np.asarray(batch.column(1))
            sids, sizes, lows = zip(*rows) if rows else ((), (), ())
            own = [pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32())]
            own.append(pa.array([0 if s is None else int(local[sets[s]]) for s in sids], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array((-1 - key % parts).astype(np.int32)), none, none, none, batch.column(0), batch.column(1), *own], names)
            dealt = deal(asking, asked_of, asked, parts)
            k = dealt.num_rows
            yield pa.RecordBatch.from_arrays([*dealt.columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *(pa.nulls(k, c.type) for c in own)], names)
        give_back()

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of the part: how many of its shingles another set has too. Documents pass through."""
    held = []

    def some() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.asarray(batch.column(0)) < 0
            if docs.any():
                held.append(batch.filter(pa.array(docs)))
            yield batch.filter(pa.array(~docs))

    names = ["doc_id", "row_key", "set_id", "n", "counted", "local", "shared"]
    owners, _ = shared_pairs(some())
    for batch in held:
        yield pa.RecordBatch.from_arrays([*batch.columns[4:10], pa.nulls(batch.num_rows, pa.int64())], names)
    held.clear()
    sid, shared = np.unique(owners, return_counts=True)
    m = len(sid)
    none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(sid), *none, pa.array(shared.astype(np.int64))], names)
    give_back()


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each key."""
    k = keys.astype(np.uint64)
    return tuple((mix(k + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in (1, 2))


def row_filter(rows: DataFrame, count: int) -> np.ndarray:
    """Bits that tell which of many rows may be among these ``row_key``: two bytes a row reach the driver.

    Every row of ``rows`` passes, and about one in 70 of the others.
    """
    bits = parts_for(count * FILTER_BITS, FILTER_ROW, 1) * FILTER_ROW

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(np.asarray(batch.column(0)), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_ROW), pa.array((at % FILTER_ROW).astype(np.int32))], ["chunk", "at"])

    def fill(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(FILTER_ROW, np.uint8)
        flags[own["at"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    placed = rows.select("row_key").mapInArrow(place, "chunk long, at int")
    for r in placed.groupBy("chunk").applyInPandas(fill, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * FILTER_ROW // 8 :][: FILTER_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_pass(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in _places(keys, len(flags) * 8):
        ok &= (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def _deal_sets(parts: int):
    """All shingles of sets, dealt by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield deal(np.asarray(batch.column(0)), of, np.concatenate(sets) if sets else np.zeros(0, np.uint64), parts)
        give_back()

    return run


def _tell_shared(parts: int):
    """Tells each set which of its shingles others hold: numbers whose first byte grows with how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, values = gather(batches)
        runs = sizes_of_runs(values)
        keep = runs > 1
        rank = np.minimum(np.round(4 * np.log2(runs[keep])), 255).astype(np.uint64)
        ids, of = np.unique(owners[keep], return_inverse=True)
        numbers = (rank << np.uint64(56)) | (values[keep] >> np.uint64(8))
        yield pack((ids % parts).astype(np.int32)[of], ids, of, numbers)
        give_back()

    return run


def _prefixes(slack: int):
    """A set's prefix: as many of its rarest shingles as it may have alone, and one more. Those it has alone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, numbers, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], {}
        for batch in batches:
            for o, of, v, sid, n in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if v is None:
                    size[sid] = n
                    continue
                v = np.frombuffer(v, np.uint64)
                owners.append(np.frombuffer(o, np.int64)[np.frombuffer(of, np.uint16 if len(of) == 2 * len(v) else np.uint32)])
                numbers.append(v)
        owners, numbers = np.concatenate(owners), np.concatenate(numbers)
        order = np.lexsort((numbers, owners))
        owners, numbers = owners[order], numbers[order]
        ids, first, held = np.unique(owners, return_index=True, return_counts=True)
        n = np.fromiter((size[i] for i in ids.tolist()), np.int64, len(ids))
        take = n * slack // 100 + 1 - (n - held)
        keep = np.arange(len(owners)) - np.repeat(first, held) < np.repeat(take, held)
        h, sid, n = numbers[keep].view(np.int64), owners[keep], np.repeat(n, held)[keep].astype(np.int32)
        for a in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (h, sid, n)], ["h", "set_id", "n"])
        give_back()

    return run


def _overlap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of incidence rows: the size of each pair's intersection."""
    for batch in batches:
        a, b, sa, sb = (batch.column(i) for i in range(4))
        both = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(sa.to_pylist(), sb.to_pylist())
        ]
        sizes = [pa.array([len(x) // 8 for x in s.to_pylist()], pa.int64()) for s in (sa, sb)]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(both, pa.int64()), *sizes], ["a", "b", "both", "na", "nb"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Incidence matrix times its transpose: all sizes of intersections.

    Shingles of many sets go through dense columns, those of few add to their pairs' cells.
    """
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    many = np.flatnonzero(counts > 48)
    for a in range(0, len(many), 1024):
        part = np.zeros((m, len(many[a : a + 1024])), np.float32)
        for k, c in enumerate(many[a : a + 1024]):
            part[of[starts[c] : starts[c] + counts[c]], k] = 1
        out += part @ part.T
    for k in range(2, 49):
        own = starts[counts == k]
        for a in range(0, len(own), max(1, 4_000_000 // (k * k))):
            rows = of[own[a : a + max(1, 4_000_000 // (k * k))][:, None] + np.arange(k)]
            cells = (rows[:, :, None] * m + rows[:, None, :]).ravel()
            out += np.bincount(cells, minlength=m * m).reshape(m, m) if m <= 256 else _scatter(cells, m)
    return out


def _scatter(cells: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(m * m, np.float32)
    at, n = np.unique(cells, return_counts=True)
    out[at] = n
    return out.reshape(m, m)


def _block_product(percent: int):
    """Links among the sets of two blocks of a group, as one edge for each set to its component's least."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("set_id")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        ids, size = rows["set_id"].to_numpy(np.int64), np.array([len(x) for x in sets], np.float64)
        both = _overlaps(sets)
        link = both * (100.0 + percent) >= (size[:, None] + size[None, :]) * percent
        # components known before hold without their links
        known = rows["component"].to_numpy(np.int64)
        label = np.unique(known, return_inverse=True)[1]
        while True:
            least = np.where(link, label[None, :], len(label)).min(1)
            by_old = np.full(label.max() + 1, len(label))
            np.minimum.at(by_old, label, least)
            new = np.minimum(label, by_old[label])
            if (new == label).all():
                break
            label = new
        first = np.full(label.max() + 1, -1)
        first[label[::-1]] = np.arange(len(label))[::-1]
        head = ids[first[label]]
        changed = head != ids
        del both, link, sets
        give_back()
        return pd.DataFrame({"u": ids[changed], "v": head[changed]})

    return run


def _blocks(sets: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(shingles / BLOCK_SHINGLES, sets / BLOCK_SETS)).cast("int")


def jaccard_groups(
    docs: DataFrame,
    scratch: Scratch,
    n: int = 4,
    percent: int = 85,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, group_key: groups of documents linked by Jaccard similarity.

    Words are lower-cased (A-Z); a document is the set of its distinct ``n``-word shingles. Two link when
    100 * intersection >= ``percent`` * union; a component is what links reach, named by its least id.

    1. Equal sets are one node, so copies never meet as pairs.
    2. Shingles whose hash is in the lowest ``COUNTED`` share are counted over all sets: inside a batch
       where it alone holds several of their sets, otherwise dealt by value. A set of size s can link only if at most s * (100 - percent) / 100 of its shingles are its
       own, so sets with more unshared ones are done. That drops documents that share a passage only.
    3. The others' full sets are written by the tasks that read their texts, and how many hold a shingle is
       counted. Two that link share one of their rarest s * (100 - percent) / 100 + 1 shingles (prefix), so a
       passage of many sets makes no column of them all. In each shingle's column every set is paired with
       the column's most central set; products give exact overlaps, and links make components.
    4. Groups of sets under one lead that still hold several components are multiplied in blocks of a
       bounded size, in which all but the largest component meets everything. The product of two blocks' incidence gives all overlaps, pairs below the bound that
       sizes set are discarded in place, and only an edge from each set to its component's first leaves
       the task. A group of near copies yields as many rows as sets, never its pairs.

    Exact up to collisions of 64-bit hashes. Null and empty texts have no shingles and component_id is
    their own id. Null ids form part of a group but never name it, unless it has no other id; ``group_key``
    tells groups apart in any case (null: no shingles). Repeated rows are copies. Long texts count whole.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    slack, scratch = 100 - percent, scratch.merged()  # columns and pairs pack into few bytes on disk, and would be built on the driver
    parts = parts_for(text_bytes(docs, text), 24 << 20)
    counted = np.uint64(int(COUNTED * (1 << 64)))
    mapped = own.mapInArrow(
        _sets(n, parts, counted), f"{DEALT_DDL}, doc_id long, row_key long, set_id long, n int, counted int, local long"
    )
    dealt = mapped.repartitionById(parts, F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).cast("int"))
    seen = scratch.table(
        dealt.mapInArrow(_count_shared, "doc_id long, row_key long, set_id long, n int, counted int, local long, shared long"), "seen"
    )
    rows = seen.where("row_key is not null").select("doc_id", "row_key", "set_id", "n")
    sets = seen.where("set_id is not null").groupBy("set_id").agg(
        F.max("n").alias("n"),
        F.max("counted").alias("counted"),
        # copies of a set may count a shingle both here and there: more than it has, never fewer
        (F.coalesce(F.sum("shared"), F.lit(0)) + F.max("local")).alias("shared"),
        F.min("doc_id").alias("first"),
        F.min("row_key").alias("row_key"),
    )
    maybe = sets.where(F.col("counted") - F.col("shared") <= F.floor(F.col("n") * slack / 100)).select("set_id", "row_key", "n")

    flags = row_filter(maybe, maybe.count())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            own_ = batch.filter(pa.array(may_pass(flags, np.asarray(batch.column(0)))))
            new = {}
            for t in own_.column(1).to_pylist():
                s = shingle_set(t, n)
                if len(s) and (sid := sequence_id(s)) not in done:
                    done.add(sid)
                    new[sid] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["set_id", "shingles"])
        give_back()

    # texts stay where they are read; a set that passes by chance links with nothing, and may be written by several tasks
    full_sets = scratch.table(own.select("row_key", "text").mapInArrow(full, "set_id long, shingles binary"), "sets")
    scratch.settle()

    size_rows = full_sets.select(F.pmod("set_id", F.lit(parts)).cast("int").alias("part"), *(F.lit(None).cast("binary").alias(c) for c in ("owners", "of", "values")), "set_id", (F.octet_length("shingles") / 8).cast("int").alias("n"))
    told = full_sets.mapInArrow(_deal_sets(parts), DEALT_DDL).repartitionById(parts, F.col("part")).mapInArrow(_tell_shared(parts), DEALT_DDL)
    told = told.withColumns({"set_id": F.lit(None).cast("long"), "n": F.lit(None).cast("int")}).union(size_rows)
    cells = scratch.table(told.repartitionById(parts, F.col("part")).mapInArrow(_prefixes(slack), "h long, set_id long, n int"), "prefixes")
    sizes = cells.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cells = scratch.table(cells.join(sizes, "h"), "cells")
    scratch.settle("prefixes")
    # the most central set of a column: its hashes lie in the fullest columns (the original of its copies)
    weight = cells.groupBy("set_id").agg((F.sum(F.log("m")) / (F.floor(F.max("n") * slack / 100) + 1)).alias("weight"))
    leads = (
        cells.join(weight, "set_id")
        .groupBy("h")
        .agg(F.max(F.struct("weight", "set_id", "n")).alias("lead"))
        .select("h", F.col("lead.set_id").alias("lead"), F.col("lead.n").alias("lead_n"))
    )

    def fits(x: str, y: str):
        return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        a = full_sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"))
        b = full_sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"))
        rows = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
        products = rows.mapInArrow(_overlap_rows, "a long, b long, both long, na long, nb long")
        return scratch.table(products.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v")), name)

    # every pair that shares a column meets in the group of the column's lead
    members = scratch.table(cells.join(leads, "h").where("set_id <> lead").select("lead", "lead_n", "set_id", "n").distinct(), "members")
    scratch.settle("cells")
    star = members.where(fits("n", "lead_n")).select(F.col("lead").alias("a"), F.col("set_id").alias("b"))
    links = linked(star, "links")
    scratch.settle()
    grouped = components(links, scratch, "cc-a").withColumnRenamed("id", "set_id")

    left = scratch.table(members.join(grouped, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "left")
    # the largest component of a group is bulk: its own pairs are joined already, so it meets the rest alone;
    # a group that fits in one block stays whole
    parts_of = left.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    mixed = (
        parts_of.groupBy("lead")
        .agg(F.max(F.struct("m", "component", "s")).alias("bulk"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("components"))
        .where("components > 1")
        .withColumn("whole", _blocks(F.col("m"), F.col("s")) == 1)
        .select(
            "lead",
            F.col("bulk.component").alias("bulk"),
            F.when(F.col("whole"), 1).otherwise(_blocks(F.col("m") - F.col("bulk.m"), F.col("s") - F.col("bulk.s"))).alias("rest_blocks"),
            F.when(F.col("whole"), 0).otherwise(_blocks(F.col("bulk.m"), F.col("bulk.s"))).alias("bulk_blocks"),
        )
    )
    h = F.xxhash64("set_id")
    placed = left.join(scratch.table(mixed, "mixed"), "lead").withColumn("in_rest", (F.col("component") != F.col("bulk")) | (F.col("bulk_blocks") == 0))
    own = F.when(F.col("in_rest"), F.pmod(h, "rest_blocks")).otherwise(F.col("rest_blocks") + F.pmod(h, "bulk_blocks")).cast("int")
    to = F.when(F.col("in_rest"), F.col("rest_blocks") + F.col("bulk_blocks") - 1).otherwise(F.col("rest_blocks") - 1)
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), to)))
    dealt = dealt.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_id", "component")
    # sets go to many blocks where groups are large: in rounds, none of which moves more than about all sets once
    moved = placed.agg(F.sum(F.col("n") * (to + 1)).alias("n")).first()["n"]
    rounds = parts_for(moved, max(full_sets.agg(F.sum(F.octet_length("shingles")) / 8).first()[0] or 0, 8 * BLOCK_SHINGLES))
    for k in range(rounds):
        now = dealt.where(F.pmod(F.xxhash64("lead", "i", "j"), F.lit(rounds)) == k)
        products = now.join(full_sets, "set_id").groupBy("lead", "i", "j").applyInPandas(_block_product(percent), "u long, v long")
        links = links.union(scratch.table(products, f"links-more-{k}"))
        scratch.settle()
    scratch.settle("left", "sets")
    final = components(links, scratch, "cc-b").withColumnRenamed("id", "set_id")
    scratch.settle()

    named = sets.select("set_id", "first").join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id", F.col("component").alias("group_key"))
    return rows.join(named, "set_id", "left").select(
        "doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group_key"
    )
