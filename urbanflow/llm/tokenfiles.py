"""Token-id files: raw id payloads in shards, and a minimal perfect hash index over document keys.

Format. ``shard-<n>.ids`` is a 16-byte header (``UFIDS1``, two zero bytes, id width in bytes as unsigned
32-bit, count of documents as unsigned 32-bit) and then ids alone, little-endian, one document after
another. ``index-<n>.mph`` holds one bucket of the index (see ``Mph.pack``).
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanflow.llm.common import IdTable, Scratch, give_back, parts_for, text_bytes, words_of

MAGIC = b"UFIDS1\0\0"
HEADER, HEADER_BYTES = "<8sII", 16


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Write under another name, then move: a task that runs twice leaves one whole file."""
    files, path = _fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        for p in parts:
            f.write(p)
    files.move(draft, path)


def read_file(uri: str) -> bytes:
    files, path = _fs(uri)
    with files.open_input_stream(path) as f:
        return f.read()


# --- minimal perfect hash ----------------------------------------------------------------------------


def key_hash(doc_id: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hash of a document key: its id (or that it has none) and which of the rows of that id it is."""
    x = _mix(doc_id.astype(np.int64).view(np.uint64), 3) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(x + nth.astype(np.uint64) + (null.astype(np.uint64) << np.uint64(40)), 1)


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, nth) with their bucket; ids go through pandas without nulls, which would make them floats."""
    own = rows.withColumns({"bucket": _bucket("doc_id", "nth", buckets), "no_id": F.col("doc_id").isNull()})
    return own.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))


def _hashes(rows: pd.DataFrame) -> np.ndarray:
    return key_hash(rows["doc_id"].to_numpy(np.int64), rows["nth"].to_numpy(), rows["no_id"].to_numpy(bool))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A finaliser in the manner of splitmix64."""
    x = x + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Mph:
    """Minimal perfect hash by levels: a key takes the first level where its cell is its own.

    Cells of level ``l`` are bits; a key's slot is the number of set bits before its own. Each slot holds
    a 32-bit fingerprint, so a key that isn't in the table is told apart (but for 1 in 4 billion), and
    the place of the document's ids: shard, first id, count.
    """

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.levels, self.prints, self.shard, self.first, self.n = levels, prints, shard, first, n
        self.rank = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        self.base = np.concatenate([[0], np.cumsum([r[-1] for r in self.rank])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, shard, first, n, gamma: float = 2.0) -> "Mph":
        left, levels = keys, []
        while len(left):
            cells = max(8, int(gamma * len(left)))
            at = (_mix(left, len(levels) + 2) % np.uint64(cells)).astype(np.int64)
            own = np.bincount(at, minlength=cells) == 1
            levels.append(own)
            left = left[~own[at]]
            if len(levels) > 200:
                raise ValueError("two document keys have the same 64-bit hash")
        out = cls(levels, np.zeros(len(keys), np.uint32), *(np.zeros(len(keys), t) for t in (np.int32, np.int64, np.int64)))
        slot = out.slots(keys)
        out.prints[slot] = cls.fingerprint(keys)
        out.shard[slot], out.first[slot], out.n[slot] = shard, first, n
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, 1) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.rank)):
            at = (_mix(keys[open_], level + 2) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[level] + rank[at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, first id and count of each key; shard -1 for a key that isn't there."""
        slot = self.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == self.fingerprint(keys[there])
        slot = np.where(there, slot, 0)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return np.where(there, self.shard[slot], -1), self.first[slot], self.n[slot]

    def pack(self) -> bytes:
        """Counts of levels and keys, cells of each level, packed bits, then the four slot arrays."""
        head = struct.pack("<II", len(self.levels), len(self.prints))
        head += struct.pack(f"<{len(self.levels)}I", *map(len, self.levels))
        bits = b"".join(np.packbits(x).tobytes() for x in self.levels)
        return head + bits + b"".join(x.tobytes() for x in (self.prints, self.shard, self.first, self.n))

    @classmethod
    def unpack(cls, data: bytes) -> "Mph":
        n_levels, n_keys = struct.unpack_from("<II", data)
        sizes = struct.unpack_from(f"<{n_levels}I", data, 8)
        at, levels = 8 + 4 * n_levels, []
        for size in sizes:
            n = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at))[:size].astype(bool))
            at += n
        arrays = []
        for kind in (np.uint32, np.int32, np.int64, np.int64):
            arrays.append(np.frombuffer(data, kind, n_keys, at))
            at += arrays[-1].nbytes
        return cls(levels, *arrays)


# --- encoding ----------------------------------------------------------------------------------------


class WordTable:
    """Ids of each distinct chunk between white space, encoded once by the tokenizers library.

    The tokenizer drops white space, never joins characters across it and ignores case, so a text's ids
    are those of its lower-cased chunks in order. Texts that might hold a special token are encoded whole.
    """

    def __init__(self, path: str, most: int = 450_000):
        # a task has one core: the library's own threads would only add their memory and idle spinning
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.table = IdTable(self._encode, most)
        # how byte-level models write a byte: as itself where it prints, else as the next of 256, 257, ...
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in prints]
        self.characters = {b: 256 + i for i, b in enumerate(others)}
        self.stops = {c: self.lib.encode(c, add_special_tokens=False).ids for c in ".,"}

    def _letters(self, text: str) -> list[int] | None:
        """Ids of a lower-cased run of letters: one pre-token, taken by the library's model with its bytes
        written as characters. None where the library's normaliser might change it."""
        if text.isascii():
            return [t.id for t in self.lib.model.tokenize(text)]
        if not is_normalized("NFC", text):
            return None
        return [t.id for t in self.lib.model.tokenize(text.encode().decode("latin-1").translate(self.characters))]

    def _encode(self, chunks: list[bytes | str | int]) -> list[list[int]]:
        """Ids of chunks (bytes), of whole texts (str) and of end ids (int: themselves).

        Letters alone, or with a full stop or comma after them, take the short way; all else goes through
        the library as a whole.
        """
        out: list = [None] * len(chunks)
        tokenize, rest, table = self.lib.model.tokenize, [], self.table
        for i, c in enumerate(chunks):
            if isinstance(c, bytes):
                if c.isalpha():  # ASCII letters, lower-cased before
                    out[i] = [t.id for t in tokenize(c.decode())]
                    continue
                if c[-1:] in (b".", b",") and (at := table.rows.get(c[:-1])) is not None and c[:-1].isalpha():
                    out[i] = [*table.flat[table.begin[at] : table.begin[at] + table.size[at]], *self.stops[chr(c[-1])]]
                    continue
                text = c.decode("utf-8", "surrogatepass")
                low = text.lower()
                stop = self.stops.get(low[-1:])
                base = low[:-1] if stop else low
                if base.isalpha() and "\u03a3" not in text and (ids := self._letters(base)) is not None:
                    out[i] = ids + stop if stop else ids
                else:
                    rest.append((i, text))
            elif isinstance(c, int):
                out[i] = [c]
            else:
                rest.append((i, c))
        found = self.lib.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        for (i, _), e in zip(rest, found):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, in one array, and where each starts."""
        chunks: list = []
        counts = [0]
        for t in texts:
            if t and "<|" in t:
                chunks.append(t)
            elif t:
                chunks += words_of(t, lower=True)
            chunks.append(end)
            counts.append(len(chunks))
        flat, ends = self.table.gather(chunks)
        return flat, ends[counts]


def _encode_rows(tokenizer: str, end: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(tokenizer)
        kind = np.dtype(f"<u{table.width}")
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                own = batch.slice(start, 500)
                flat, starts = table.encode(own.column(1).to_pylist(), end)
                data, n = flat.astype(kind).tobytes(), np.diff(starts)
                ids = own.column(0)
                least = np.iinfo(np.int64).min
                shard = np.searchsorted(bounds, ids.fill_null(least).to_numpy(zero_copy_only=False), "left")
                payload = [data[a * kind.itemsize : b * kind.itemsize] for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(shard.astype(np.int32)), pa.array(n), pa.array(payload, pa.binary())],
                    ["doc_id", "shard", "n_tokens", "payload"],
                )

    return run


def _write_shards(folder: str, width: int):
    """Rows come sorted by shard and id; each shard's payloads are one file, and each row tells its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first, last, nth = None, [], 0, (), 0

        def close() -> None:
            if now is not None:
                write_file(f"{folder}/shard-{now:08d}.ids", [struct.pack(HEADER, MAGIC, width, len(held)), *held])

        for batch in batches:
            ids, shards, ns, payloads = (c.to_pylist() for c in batch.columns)
            firsts, nths = [], []
            for doc, shard, n, payload in zip(ids, shards, ns, payloads):
                if shard != now:
                    close()
                    now, held, first, last = shard, [], 0, ()
                nth = nth + 1 if last == (doc,) else 0
                last = (doc,)
                held.append(payload)
                firsts.append(first)
                nths.append(nth)
                first += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(firsts, pa.int64()), pa.array(nths, pa.int32())],
                ["doc_id", "shard", "n_tokens", "first", "nth"],
            )
        close()

    return run


PLACE = "doc_id long, shard int, n_tokens long, first long, nth int"


def _bucket(doc_id, nth, buckets: int):
    return F.pmod(F.xxhash64(doc_id, nth), F.lit(buckets)).cast("int")


def write_tokens(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer: str,
    end: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_bytes: int = 4 << 20,
    bucket_keys: int = 10_000,
) -> dict:
    """Encode, write shards in ascending id order, and index them. Returns the manifest.

    Ids are encoded where the rows lie; only packed ids move, once, to the task that writes their shard.
    Shard borders are quantiles of the ids. Each bucket of the index is built in a task of its own from
    about ``bucket_keys`` keys. Nothing of either grows with the input but their number.

    Null and empty texts are the end id alone. Null ids sort first. Rows that repeat an id follow each
    other, in the order of their ids' hash, under keys (id, 0), (id, 1), ...; other columns are
    not read. An empty table writes no files.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folder = scratch.path("ids")
    shards = parts_for(text_bytes(docs), 4 * shard_bytes)
    cuts = docs.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    width = WordTable(tokenizer).width
    encoded = docs.mapInArrow(
        _encode_rows(tokenizer, end, bounds), "doc_id long, shard int, n_tokens long, payload binary"
    )
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "doc_id", F.xxhash64("payload")
    )
    places = scratch.table(placed.mapInArrow(_write_shards(folder, width), PLACE), "places")
    n = places.count()
    buckets = parts_for(n, bucket_keys)

    def index(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = Mph.build(_hashes(rows), rows["shard"].to_numpy(), rows["first"].to_numpy(), rows["n_tokens"].to_numpy())
        write_file(f"{folder}/index-{key[0]:08d}.mph", [table.pack()])
        return pd.DataFrame({"bucket": [key[0]], "n": [len(rows)]})

    built = (
        _keyed(places, buckets)
        .groupBy("bucket")
        .applyInPandas(index, "bucket int, n long")
    )
    indexed = built.agg(F.sum("n").alias("n")).first()["n"] or 0
    if indexed != n:
        raise RuntimeError(f"{n} documents were written and {indexed} indexed")
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard file: its start is the ids in all files before it
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    return {"folder": folder, "width": width, "buckets": buckets, "shards": len(bounds) + 1, "starts": starts}


def locate(keys: DataFrame, manifest: dict) -> DataFrame:
    """Shard, first id and count of each key (doc_id, nth) from the index; shard -1 for unknown keys."""
    folder = manifest["folder"]

    def look(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = Mph.unpack(read_file(f"{folder}/index-{key[0]:08d}.mph"))
        rows["shard"], rows["first"], rows["n_tokens"] = table.find(_hashes(rows))
        return rows[["doc_id", "no_id", "nth", "shard", "first", "n_tokens"]]

    found = (
        _keyed(keys.select("doc_id", "nth"), manifest["buckets"])
        .groupBy("bucket")
        .applyInPandas(look, "doc_id long, no_id boolean, nth int, shard int, first long, n_tokens long")
    )
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def read_tokens(keys: DataFrame, manifest: dict, digest: bool = False) -> DataFrame:
    """The ids of each key (doc_id, nth), read from the shard files by the places that the index gives.

    With ``digest`` the ids' CRC-32 (as little-endian unsigned 32-bit integers) takes their place. Also
    returns ``start``: the ids of all documents before it. Keys that aren't indexed are left out.
    """
    folder, width = manifest["folder"], manifest["width"]
    found = locate(keys, manifest).where("shard >= 0")
    ordered = found.repartitionById(manifest["shards"], F.col("shard")).sortWithinPartitions("shard", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, None
        for batch in batches:
            doc, nth, shard, first, n = batch.columns
            out = []
            for s, a, m in zip(shard.to_pylist(), first.to_pylist(), n.to_pylist()):
                if s != now:
                    data, now = read_file(f"{folder}/shard-{s:08d}.ids"), s
                    ids = np.frombuffer(data, f"<u{width}", -1, HEADER_BYTES)
                own = ids[a : a + m].astype("<u4")
                out.append(zlib.crc32(own.tobytes()) if digest else own.astype(np.int64))
            last = pa.array(out, pa.int64() if digest else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, nth, shard, first, n, last], [*batch.schema.names, "ids_crc32" if digest else "ids"])

    kind = "ids_crc32 long" if digest else "ids array<long>"
    read = ordered.mapInArrow(run, f"doc_id long, nth int, shard int, first long, n_tokens long, {kind}")
    return read.join(manifest["starts"], "shard").select(
        "doc_id", "nth", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", kind.split()[0]
    )


def document_keys(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One key for each row: its id and, where ids repeat, a number from 0."""
    counted = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("nth"))
