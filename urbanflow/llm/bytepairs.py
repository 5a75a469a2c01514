"""Byte-level BPE encoding and decoding by backtracking from longest matches.

A sequence of tokens is what the merges give for its bytes exactly if every two neighbours are: merging
their joined bytes leaves the same two. So the merges are never run. An automaton finds the longest token
at each place, a token goes in where it is compatible with the one before, else its longest prefix is
tried, else the one before is taken back; places that have failed are marked, so each is left once.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import give_back, runs_of

#: The pattern's white space (Unicode's property White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: A run of white space with the characters after it: no match of the pattern begins inside a run of other
#: characters and ends in white space, so each such chunk is matched alone.
_CHUNK = re.compile(f" [^{_SPACE}]+|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: No token holds this character, as bytes end at 255.
_APART = "\u0100"
_NEVER = 1 << 60
#: Steps in which all pieces walk together; a piece that needs more walks alone.
_TOGETHER = 200
#: Places of the table of known pairs, and how many pairs the slower one holds at most.
_SLOTS, _PAIRS = 1 << 20, 500_000


class Merges:
    """Tables of one vocabulary: how each token arises, what tokens its neighbours may be, and its prefixes.

    ``up[t]`` and ``down[t]`` are the tokens that hold t's last (first) byte while merges build t, from
    that byte to t itself. Two neighbours are compatible if no token arises across their seam while both
    are built; answers are kept.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte has no token of its own")
        self.joined: dict[int, int] = {}
        self.up: dict[int, list[int]] = {}
        self.down: dict[int, list[int]] = {}
        self.fits: dict[int, bool] = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                x, y = self.rank.get(t[:i]), self.rank.get(t[i:])
                if x is not None and y is not None:
                    self.joined[x << 32 | y] = r
        for r in sorted(self.token):
            self._derive(r)
        self.most = max(self.token) + 1
        self.length, self.shorter = np.zeros(self.most, np.int64), np.full(self.most, -1)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)])
        self.automaton = ahocorasick.Automaton()
        for r in self.up:  # a token that merges never reach takes no part
            t = self.token[r]
            self.length[r], self.shorter[r] = len(t), self._prefix(t)
            if len(t) > 1:
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.slot_key, self.slot_fits = np.full(_SLOTS, -1), np.zeros(_SLOTS, bool)
        self.bytes_begin, self.bytes = self._flat()

    def _derive(self, r: int) -> None:
        t = self.token[r]
        if len(t) == 1:
            self.up[r] = self.down[r] = [r]
            return
        for i in range(1, len(t)):
            x, y = self.rank.get(t[:i]), self.rank.get(t[i:])
            if x in self.up and y in self.up and max(x, y) < r and self._seam(x, y) == (x, y):
                self.up[r], self.down[r] = [*self.up[y], r], [*self.down[x], r]
                return
        if self._merge(t) == [r]:
            raise ValueError("a token arises from one of higher rank")

    def _merge(self, t: bytes) -> list[int]:
        """The plain merges, for the few tokens that no two others make."""
        ids = [self.rank[t[i : i + 1]] for i in range(len(t))]
        while True:
            rank, i = min(((self.joined.get(a << 32 | b, _NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(_NEVER, 0))
            if rank == _NEVER:
                return ids
            ids[i : i + 2] = [rank]

    def _seam(self, a: int, b: int) -> tuple[int, int] | None:
        """The neighbours that merge first across the seam of ``a`` and ``b``; none if they stay apart.

        Of equal merges the leftmost comes first: one inside ``a`` before one across, that before one
        inside ``b``.
        """
        up, down, joined = self.up[a], self.down[b], self.joined
        i, j, x, y = 1, 1, up[0], down[0]
        left = up[1] if len(up) > 1 else _NEVER
        right = down[1] if len(down) > 1 else _NEVER
        while True:
            across = joined.get(x << 32 | y, _NEVER)
            if across < left and across <= right and across != _NEVER:
                return x, y
            if left <= right:
                if left == _NEVER:
                    return None
                x, i = left, i + 1
                left = up[i] if i < len(up) else _NEVER
            else:
                y, j = right, j + 1
                right = down[j] if j < len(down) else _NEVER

    def fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= _PAIRS:  # a worker's memory is bounded
                self.fits.clear()
            known = self.fits[key] = self._seam(a, b) is None
        return known

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs; each answer has one place of a table, which the next of that place takes."""
        key = a << 32 | b
        slot = ((a * 0x9E3779B1 ^ b * 0x85EBCA6B) >> 9) % _SLOTS
        out, new = self.slot_fits[slot], np.flatnonzero(self.slot_key[slot] != key)
        if len(new):
            own, where = np.unique(key[new], return_inverse=True)
            found = np.fromiter((self.fit(k >> 32, k & 0xFFFFFFFF) for k in own.tolist()), bool, len(own))[where]
            out[new] = self.slot_fits[slot[new]] = found
            self.slot_key[slot[new]] = key[new]
            # two new pairs may share a place: only the one whose key stands there may answer
            self.slot_key[slot[new][self.slot_key[slot[new]] != key[new]]] = -1
        return out

    def _prefix(self, t: bytes) -> int:
        for i in range(len(t) - 1, 0, -1):
            r = self.rank.get(t[:i])
            if r in self.up:
                return r
        return -1

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(self.token.get(r, b"")) for r in range(self.most)], np.int64)
        flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(self.most)), np.uint8)
        return np.concatenate([[0], np.cumsum(sizes)]), flat

    def _longest(self, data: str) -> np.ndarray:
        """The longest token that starts at each place of ``data`` (-1 at what parts pieces)."""
        codes = np.frombuffer(data.encode("utf-16-le"), np.uint16)
        best = np.where(codes < 256, self.single[np.minimum(codes, 255)], -1).astype(np.int32)
        numbers = chain.from_iterable(self.automaton.iter(data))
        while len(hits := np.fromiter(islice(numbers, 2_000_000), np.int64)):
            ends, tokens = hits[::2], hits[1::2]
            best[ends + 1 - self.length[tokens]] = tokens  # hits come by end, so the longest is last
        return best

    def _alone(self, best: np.ndarray) -> np.ndarray:
        """Tokens of one piece from the longest token at each of its places."""
        n, at, out, longest = len(best), 0, [], best.tolist()
        sizes, shorter, open_ = self.length, self.shorter, bytearray(b"\1") * (n + 1)
        token = longest[0]
        while at < n:
            while token >= 0:
                end = at + int(sizes[token])
                if open_[end] and (not out or self.fit(out[-1], token)):
                    break
                token = int(shorter[token])
            if token < 0:  # nothing fits here: this place is closed, and the token before gets shorter
                open_[at] = 0
                before = out.pop()
                at -= int(sizes[before])
                token = int(shorter[before])
                continue
            out.append(token)
            at = end
            token = longest[at] if at < n else -1
        return np.array(out, np.int32)

    def _together(self, best: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_alone`` for many pieces, a step of all at a time: the token that starts at each place, and
        which pieces are done."""
        put, before = np.full(len(best), -1, np.int64), np.full(len(best), -1, np.int64)
        open_ = np.ones(len(best) + 1, bool)
        at, token, last = begin.copy(), best[begin].astype(np.int64), np.full(len(begin), -1, np.int64)
        walk = np.arange(len(begin))
        for _ in range(_TOGETHER):
            stuck = token[walk] < 0
            back = walk[stuck]  # nothing fits here: this place is closed, and the token before gets shorter
            open_[at[back]] = False
            at[back] = last[back]
            token[back] = self.shorter[put[at[back]]]
            last[back] = before[at[back]]
            go = walk[~stuck]
            place, new, old = at[go], token[go], last[go]
            stop = place + self.length[new]
            good = open_[stop]
            ask = np.flatnonzero(good & (old >= 0))
            good[ask] = self.fit_all(put[old[ask]], new[ask])
            token[go[~good]] = self.shorter[new[~good]]
            go, place, stop = go[good], place[good], stop[good]
            put[place], before[place] = new[good], old[good]
            last[go], at[go], token[go] = place, stop, best[stop]
            walk = walk[at[walk] < end[walk]]
            if not len(walk):
                break
        return put, at >= end

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty) in one array, and how many each has.

        A piece that is a token is that token; the others are merged. The automaton reads them all in
        one go, with a character between them that no token holds.
        """
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        count = np.ones(len(pieces), np.int64)
        if not len(rest):
            return whole.astype(np.int32), count
        size = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        begin = np.cumsum(size + 1) - size - 1
        end = begin + size
        best = self._longest(_APART.join([pieces[i].decode("latin-1") for i in rest]) + _APART)
        put, done = self._together(best, begin, end)
        alone = {int(k): self._alone(best[begin[k] : end[k]]) for k in np.flatnonzero(~done)}
        steps, at, walk = [], begin.copy(), np.flatnonzero(done)
        while len(walk):
            token = put[at[walk]]
            steps.append((rest[walk], token))
            at[walk] += self.length[token]
            walk = walk[at[walk] < end[walk]]
        single = np.flatnonzero(whole >= 0)
        steps += [(single, whole[single]), *((np.full(len(ids), rest[k]), ids) for k, ids in alone.items())]
        who, ids = np.concatenate([w for w, _ in steps]), np.concatenate([t for _, t in steps])
        return ids[np.argsort(who, kind="stable")].astype(np.int32), np.bincount(who, minlength=len(pieces))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after the other."""
        begin = self.bytes_begin[ids]
        return self.bytes[_spread(begin, self.bytes_begin[ids + 1] - begin)]


@functools.lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    """Tables of a rank file, built once in a worker process."""
    return Merges(path)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of ``size`` places, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class PieceTable:
    """Ids of each distinct chunk (white space with the characters after it), found once while the table lasts.

    Ids lie in one growing array. Beyond ``most`` chunks the table starts anew, so its memory is bounded.
    """

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        self.merges, self.find, self.most = merges(path), regex.compile(pattern).findall, most
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, chunks: list[str]) -> None:
        # those that start with white space and end without are matched in one text, as if they followed one another
        free = [c[0] in _WHITE and c[-1] not in _WHITE for c in chunks]
        chunks = [c for c, f in zip(chunks, free) if not f] + [c for c, f in zip(chunks, free) if f]
        first = len(chunks) - sum(free)
        pieces, counts = [], []
        for c in chunks[:first]:
            own = self.find(c)
            pieces += own
            counts.append(len(own))
        joined = self.find("".join(chunks[first:]))
        pieces += joined
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        stops = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, chunks[first:]), np.int64, len(chunks) - first))) + 1
        counts = np.concatenate([np.array(counts, np.int64), np.diff(stops, prepend=0)])
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        flat, size = self.merges.encode([p.encode() for p in place])
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        ids = flat[_spread(begin[at], size[at])]
        sizes = np.diff(np.concatenate([[0], np.cumsum(size[at])])[np.cumsum(counts)], prepend=0)
        self.rows.update(zip(chunks, range(len(self.rows), len(self.rows) + len(chunks))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's start (with the end)."""
        chunks, counts = [], [0]
        for t in texts:
            if t:
                chunks += _CHUNK.findall(t)
            counts.append(len(chunks))
        if len(self.rows) > self.most:
            self._clear()
        new = list(dict.fromkeys([c for c in chunks if c not in self.rows]))
        if new:
            self._add(new)
        at = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
        size = self.size[at]
        return self.flat[_spread(self.begin[at], size)], np.concatenate([[0], np.cumsum(size)])[counts]


def _schema(docs: DataFrame, keep: tuple[str, ...], made: dict[str, T.DataType]) -> tuple[tuple[str, ...], T.StructType]:
    keep = tuple(c for c in keep if c not in made)
    return keep, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(k, t) for k, t in made.items())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int): the byte-level BPE of the whole text.

    ``path`` names a file of ranks that all executors can open, ``pattern`` parts a text into pieces that
    are encoded separately; it must match every character, and no match may run from other characters
    into white space. Special tokens are ordinary text.

    Null and empty texts have no ids. Repeated rows stay, ties don't matter. A text of any length is one
    row of ids; about 1,000,000 characters are encoded at once, or one longer text. A single piece of any
    length is encoded in linear time. No rows give no rows. A kept column named ``ids`` gives way; other
    columns are not looked at. No rows move between tasks.
    """
    return _run(docs, path, pattern, text, tuple(keep), decoded=False)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` as ``encode`` gives them, and ``decoded`` (binary): the bytes of those ids.

    One pass, in which ids go from encoder to decoder inside the task. Cases are those of ``encode``; a
    kept column named ``decoded`` gives way, too.
    """
    return _run(docs, path, pattern, text, tuple(keep), decoded=True)


def _run(docs: DataFrame, path: str, pattern: str, text: str, keep: tuple[str, ...], decoded: bool) -> DataFrame:
    made: dict[str, T.DataType] = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.BinaryType()} if decoded else {})
    keep, schema = _schema(docs, keep, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for part in runs_of(texts):
                flat, starts = table.encode(texts[part])
                own = batch.slice(part.start, part.stop - part.start)
                out = [*own.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))]
                if decoded:
                    out.append(_decoded(table.merges, flat, starts))
                yield pa.RecordBatch.from_arrays(out, schema.names)
        del table
        give_back()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _decoded(tables: Merges, flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    size = tables.bytes_begin[flat + 1] - tables.bytes_begin[flat]
    ends = np.concatenate([[0], np.cumsum(size)])[starts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(tables.decode(flat))])


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to`` (binary): the bytes of each row's ids; null or no ids give no bytes.

    An older column of that name gives way. An id without a token is an error.
    """
    keep, schema = _schema(rows, tuple(rows.columns), {to: T.BinaryType()})
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = merges(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                own = batch.slice(start, 500)
                lists = [x or [] for x in own.column(at).to_pylist()]
                flat = np.array([i for x in lists for i in x], np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= tables.most or (tables.bytes_begin[flat + 1] == tables.bytes_begin[flat]).any()):
                    raise ValueError("an id has no token")
                starts = np.cumsum([0, *map(len, lists)])
                yield pa.RecordBatch.from_arrays([*own.columns, _decoded(tables, flat, starts)], schema.names)
        give_back()

    return rows.select(*keep).mapInArrow(run, schema)
