"""Substring dedup: suffix automata of reference shards and the documents' matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, give_back, parts_for, runs_of, text_bytes, words_of
from urbanflow.llm.packed import (
    DEALT,
    DEALT_DDL,
    deal,
    flat_words,
    gather,
    grams,
    pack,
    sequence_id,
    settle,
    shared_pairs,
    signed,
    texts_of,
    word_hashes,
)

#: Words of the grams whose least hash names a window's route.
GRAM = 6
#: Distinct passages of one route, beyond which their windows are grouped one by one.
HOT = 2_000
#: Such routes whose ids (8 bytes each) are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROUTES = 1_000_000
#: Words of reference passages in one automaton, about.
AUTOMATON_WORDS = 60_000
#: A null id counts as larger than any other.
NO_ID = (1 << 63) - 1


class Automaton:
    """Suffix automaton of the passages added so far; each state knows the first document it occurs in.

    Passages must be added in ascending order of document as far as they share windows.
    """

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, length: int, first: int, link: int, next_: dict) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the shorter strings of ``q`` that end in ``word`` after ``p``."""
        nxt, link = self.next, self.link
        twin = self._state(self.length[p] + 1, self.first[q], link[q], dict(nxt[q]))
        link[q] = twin
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = twin
            p = link[p]
        return twin

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(length[last] + 1, doc, 0, {}), last
            while p != -1 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p != -1:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = new

    def windows(self, words: list[int], size: int) -> list[int | None]:
        """Matching statistics cut at ``size``: for each window, the first document it occurs in."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        out: list[int | None] = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            if matched >= size:
                while length[link[state]] >= size:
                    state = link[state]
                    matched = length[state]
            if i >= size - 1:
                out.append(first[state] if matched >= size else None)
        return out


def window_routes(words: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` words, the least hash of its grams."""
    g = grams(words, GRAM)
    span = size - GRAM + 1
    if len(g) < span:
        return np.zeros(0, np.uint64)
    step, least = 1, g
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(g) - span + 1], least[span - step :])
    return least[: len(g) - span + 1]


def _windows_of(h: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Routes of all windows that lie inside one text, and each one's text, for texts laid end to end."""
    routes = window_routes(h, size)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(routes)]
    inside = np.arange(len(routes)) + size <= ends[of + 1]
    routes, of = routes[inside], of[inside]
    change = np.ones(len(routes), bool)  # neighbours mostly share their route
    change[1:] = (routes[1:] != routes[:-1]) | (of[1:] != of[:-1])
    return routes[change], of[change]


#: What a row of the first pass is: a document, pairs whose value is asked about, pairs known to be shared.
DOC, ASKED, TOLD = 0, 1, 2
_DOC_DDL = "doc_id long, row_key long, seq_id long, n_words long"


def _kind(dealt: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    m = dealt.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, kind, np.int32)), *dealt.columns, *(pa.nulls(m, pa.int64()) for _ in range(4))],
        ["kind", *DEALT.names, "doc_id", "row_key", "seq_id", "n_words"],
    )


def _by_owner(owners: np.ndarray, of: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pairs packed by their owner's part."""
    home = (owners.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    return pack(home[of], owners, of, values)


def _routes(size: int, parts: int):
    """Documents, and the routes of distinct word sequences: to ask about, or known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seqs, ids, counts, routes, owner = batch.column(2).to_pylist(), {}, [], [], [], []
            for part in runs_of(texts):
                h, ends = flat_words(texts[part])
                own = [sequence_id(h[a:b]) for a, b in zip(ends, ends[1:])]
                ids += own
                counts.append(np.diff(ends))
                # a sequence that has been here before brings nothing new
                place = np.array([-1 if s in seqs else seqs.setdefault(s, len(seqs)) for s in own])
                values, of = _windows_of(h, ends, size)
                new = place[of] >= 0
                routes.append(values[new])
                owner.append(place[of[new]])
            m = batch.num_rows
            none, key = pa.nulls(m, pa.binary()), np.asarray(batch.column(1))
            n_words = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, DOC, np.int32)), pa.array((key % parts).astype(np.int32)), none, none, none, batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(n_words)],
                ["kind", *DEALT.names, "doc_id", "row_key", "seq_id", "n_words"],
            )
            if routes:
                owners = np.fromiter(seqs, np.int64, len(seqs))
                of, values, asking, asked_of, asked = settle(owners, np.concatenate(owner), np.concatenate(routes))
                yield _kind(deal(asking, asked_of, asked, parts), ASKED)
                yield _kind(_by_owner(owners, of, values, parts), TOLD)
        give_back()

    return run


def _shared_routes(parts: int):
    """Answers what is asked about; documents and what is told already pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["kind", *DEALT.names, "doc_id", "row_key", "seq_id", "n_words"], []

        def asked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.asarray(batch.column(0)) == ASKED
                if not own.all():
                    held.append(batch.filter(pa.array(~own)))
                yield batch.filter(pa.array(own)).select(DEALT.names)

        owners, values = shared_pairs(asked())
        yield from held
        held.clear()
        distinct, of = np.unique(owners, return_inverse=True)
        yield _kind(_by_owner(distinct, of, values, parts), TOLD).select(names)
        give_back()

    return run


def _own_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence of the part: its shared routes."""
    values, owners = gather(batches, by_owner=True)
    cuts = np.flatnonzero(np.diff(owners)) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64) if len(owners) else np.zeros(0, np.int64)
    data = [values[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(owners)])]
    yield pa.RecordBatch.from_arrays([pa.array(owners[starts]), pa.array(data, pa.binary())], ["seq_id", "some"])


def _passages(size: int):
    """Passages of a text: runs of windows with one shared route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for own, texts in texts_of(batches, 2):
            out: list[tuple] = []
            for sid, first, text, some in zip(*(own.column(i).to_pylist() for i in (0, 1)), texts, own.column(3).to_pylist()):
                w = word_hashes(words_of(text))
                short = w.astype(np.uint32)
                routes = window_routes(w, size)
                starts = np.flatnonzero(np.append(True, routes[1:] != routes[:-1]))
                ends = np.append(starts[1:], len(routes))
                shared = np.isin(routes[starts], np.frombuffer(some, np.uint64))
                for a, b in zip(starts[shared].tolist(), ends[shared].tolist()):
                    data = short[a : b + size - 1].tobytes()
                    cid = signed(xxhash.xxh3_64_intdigest(data))
                    new = cid not in sent
                    if new:
                        sent.add(cid)
                    out.append((sid, first, a, cid, signed(int(routes[a])), data if new else None))
            if len(sent) > 100_000:
                sent.clear()
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["seq_id", "first", "start", "passage", "route", "words"]
            )

    return run


def _single_windows(size: int):
    """Each window of a passage by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for first, cid, data, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                w = grams(np.frombuffer(data, np.uint32).astype(np.uint64), size).view(np.int64)
                for c, x in zip(cols, ([cid] * len(w), [first] * len(w), [n] * len(w), range(len(w)), w.tolist())):
                    c += x
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["passage", "first", "n", "at", "window"])

    return run


def _match(size: int):
    """Passages come sorted by route and first document; one automaton serves routes until it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, route, held = Automaton(), None, 0
        for batch in batches:
            ids, firsts = [], []
            for r, doc, cid, data, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if r != route and held > AUTOMATON_WORDS:
                    auto, held = Automaton(), 0
                route = r
                words = np.frombuffer(data, np.uint32).tolist()
                found = auto.windows(words, size)
                if None in found:
                    auto.add(words, doc)
                    held += len(words)
                    found = [doc if f is None else f for f in found]
                if n > 1 or min(found) < doc:
                    ids.append(cid)
                    firsts.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], ["passage", "firsts"])

    return run


def _spans(size: int):
    """Maximal stretches of words under windows that an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [])
            for sid, doc, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                early = np.flatnonzero(np.array(data, np.int64) < doc)
                if len(early):
                    cuts = np.flatnonzero(np.diff(early) > size) + 1
                    for part in np.split(early, cuts):
                        rows[0].append(sid)
                        rows[1].append(start + int(part[0]))
                        rows[2].append(start + int(part[-1]) + size)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32())], ["seq_id", "start", "end"])

    return run


def repeated_spans(
    docs: DataFrame, scratch: Scratch, size: int = 13, doc_id: str = "doc_id", text: str = "text", hot: int = HOT
) -> DataFrame:
    """row_key, doc_id, n_words, all_repeated, spans: words that an earlier document already has.

    A window is ``size`` consecutive words (unchanged, between ASCII white space). A window counts as
    repeated when the same words start in a document with a smaller id; ``spans`` are the stretches of
    words, as [start, end) pairs that may overlap, under repeated windows. ``all_repeated`` marks rows
    whose whole word sequence is that of a smaller id (with a window at least): all their words go.

    1. Equal word sequences are one. Each window is routed by the least hash of its grams, so equal
       windows have equal routes. A batch that holds a route in several sequences knows it for shared and
       asks about it once; the routes of one sequence alone are dealt by value and asked about. Answers
       return to the sequence, packed by its own part.
    2. Sequences with shared routes give their passages (runs of windows of one route); distinct passages
       are the reference, sharded by route.
    3. In each shard passages go in order of their first document through suffix automata, each of a
       bounded number of words: matching statistics give every window's first document, and passages
       with new windows are added. Where a route has more than ``hot`` passages, as a line in very many
       documents has with all its surroundings, their windows are grouped one by one instead, so that no
       shard gathers them.
    4. Each occurrence of a passage compares those first documents with its own.

    Shipping every automaton to every document would grow with the square of the input; routing sends a
    passage to the one shard that can hold it, and results are the same. Exact up to hash collisions
    (windows meet by 64-bit routes, their words by 32-bit hashes each).

    Null and empty texts have no words. A null id counts as larger than any other. Repeated rows with one
    id keep their words, as neither id is smaller. A text of any length is one row.
    """
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.col(text).alias("text")
    )
    parts = parts_for(text_bytes(docs, text), 24 << 20)
    ddl = f"kind int, {DEALT_DDL}, {_DOC_DDL}"
    mapped = own.mapInArrow(_routes(size, parts), ddl)
    seen = scratch.table(mapped.repartitionById(parts, F.col("part")).mapInArrow(_shared_routes(parts), ddl), "routes", "kind")
    rows = seen.where(F.col("kind") == DOC).select("doc_id", "row_key", "seq_id", "n_words")
    told = seen.where(F.col("kind") == TOLD).select(*DEALT.names).repartitionById(parts, F.col("part"))
    routes = told.mapInArrow(_own_routes, "seq_id long, some binary")
    by_seq = rows.groupBy("seq_id").agg(F.min("doc_id").alias("first"), F.min("row_key").alias("row_key"))
    suspects = by_seq.join(routes, "seq_id")
    texts = own.select("row_key", "text").join(suspects, "row_key").select("seq_id", "first", "text", "some")
    passages = scratch.table(
        texts.mapInArrow(_passages(size), "seq_id long, first long, start int, passage long, route long, words binary"), "passages"
    )
    distinct = passages.groupBy("passage").agg(
        F.first("route").alias("route"), F.min("first").alias("first"), F.first("words", ignorenulls=True).alias("words"), F.count(F.lit(1)).alias("n")
    )
    distinct = scratch.table(distinct, "distinct")
    crowded = scratch.table(distinct.groupBy("route").count().where(F.col("count") > hot).select("route"), "hot")
    n_hot = crowded.count()
    few = F.broadcast(crowded) if n_hot <= BROADCAST_ROUTES else crowded
    others = distinct.join(few, "route", "left_anti") if n_hot else distinct
    shards = others.repartition(parts, "route").sortWithinPartitions("route", "first").select("route", "first", "passage", "words", "n")
    matched = shards.mapInArrow(_match(size), "passage long, firsts array<long>")
    if n_hot:
        single = distinct.join(few, "route", "left_semi").select("first", "passage", "words", "n")
        windows = scratch.table(single.mapInArrow(_single_windows(size), "passage long, first long, n long, at int, window long"), "windows")
        # written, so that the join below meets it by a shuffle of its own and a crowded window can be split
        least = scratch.table(windows.groupBy("window").agg(F.min("first").alias("least")), "least")
        met = windows.join(least, "window").groupBy("passage").agg(
            F.min("first").alias("first"), F.min("n").alias("n"), F.min("least").alias("least"), F.sort_array(F.collect_list(F.struct("at", "least"))).alias("w")
        )
        matched = matched.union(met.where("n > 1 or least < first").select("passage", F.col("w.least").alias("firsts")))
    matched = scratch.table(matched, "matched")
    hits = passages.join(matched, "passage").select("seq_id", "first", "start", "firsts")
    found = hits.mapInArrow(_spans(size), "seq_id long, start int, end int")
    spans = found.groupBy("seq_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    firsts = by_seq.select("seq_id", "first")
    return (
        rows.join(firsts, "seq_id")
        .join(spans, "seq_id", "left")
        .select(
            "row_key",
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_words",
            ((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= size)).alias("all_repeated"),
            "spans",
        )
    )


def cut_spans(
    docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", made: tuple[str, str, str] = ("n_words", "n_removed", "kept")
) -> DataFrame:
    """The columns of ``docs`` and those ``made``: number of words, how many are removed, and the words outside the spans.

    Kept words are joined by one space; a text that loses no word is given so too. Rows join by key:
    equal rows share one entry. Older columns of the three names give way.
    """
    once = spans.dropDuplicates(["row_key"]).select(F.col("row_key").alias("__key"), F.col("all_repeated").alias("__all"), F.col("spans").alias("__spans"))
    names = [c for c in docs.columns if c not in made]
    joined = docs.withColumn("__key", F.xxhash64(doc_id, text)).join(once, "__key", "left").select(*names, F.col(text).alias("__text"), "__all", "__spans")
    at = len(names)
    schema = joined.select(*names).schema
    for name, kind in zip(made, ("long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                own = batch.slice(start, 2_000)
                n, gone, kept = [], [], []
                for t, whole, cut in zip(*(own.column(at + i).to_pylist() for i in range(3))):
                    words = words_of(t)
                    left = words
                    if whole:
                        left = []
                    elif cut:
                        mask = np.ones(len(words), bool)
                        for c in cut:
                            mask[c["start"] : c["end"]] = False
                        left = [words[i] for i in np.flatnonzero(mask)]
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:at], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema.names
                )
        give_back()

    return joined.mapInArrow(run, schema)
