"""Word hashes in numpy, and packed numbers that are dealt over partitions by their value.

A row for each word or shingle would cost far more than the number itself. So a task packs the numbers
that go to one part into one binary value, Spark moves those, and the task that gets a part unpacks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import give_back, words_of

#: Odd multipliers of a polynomial over word hashes.
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. A table of known ones would cost more than the hash, besides its memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; empty if there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= np.uint64(_ODD)
        out += words[i : i + size]
    return mix(out)


def flat_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and where each text's start (with the end)."""
    words, ends = [], [0]
    for t in texts:
        words += words_of(t, lower)
        ends.append(len(words))
    return word_hashes(words), np.array(ends)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sequence_id(numbers: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(numbers.tobytes()))


def texts_of(batches: Iterator[pa.RecordBatch], column: int, most: int = 500) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            own = batch.slice(start, most)
            yield own, own.column(column).to_pylist()
    give_back()


#: What a dealt row holds: the part, and packed owners and values (value i belongs to owner of[i]).
DEALT = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("of", pa.binary()), ("values", pa.binary())])
DEALT_DDL = "part int, owners binary, of binary, values binary"


#: Owner that stands for several of a batch: whoever holds one of its values shares it.
SEVERAL = 0


def pack(part: np.ndarray, owners: np.ndarray, of: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Pack (owner, value) pairs by their part; ``of`` is each pair's place in ``owners``."""
    order = np.lexsort((of, part))
    part, of, values = part[order], of[order], values[order]
    new_part = np.append(True, part[1:] != part[:-1]) if len(part) else np.zeros(0, bool)
    new_owner = new_part.copy()
    new_owner[1:] |= of[1:] != of[:-1]
    starts, heads = np.flatnonzero(new_part), np.flatnonzero(new_owner)
    first = np.searchsorted(heads, np.append(starts, len(part)))  # of each part among the owners it has
    place = np.cumsum(new_owner) - 1 - np.repeat(first[:-1], np.diff(np.append(starts, len(part))))
    held = owners[of[heads]].astype(np.int64)
    rows: tuple = ([], [], [], [])
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(part)])):
        own = held[first[k] : first[k + 1]]
        rows[0].append(int(part[a]))
        rows[1].append(own.tobytes())
        rows[2].append(place[a:b].astype(np.uint16 if len(own) <= 65_536 else np.uint32).tobytes())
        rows[3].append(values[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, DEALT)], schema=DEALT)


def deal(owners: np.ndarray, of: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pack pairs by their value, mod ``parts``."""
    return pack((values % np.uint64(parts)).astype(np.int32), owners, of, values)


def settle(owners: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple:
    """Part a batch's pairs by whether the batch alone shows that their value is shared.

    Gives (of, value) of the pairs that are shared here, and owners, of and values of what is left to ask
    the value's part about: values of one owner, and each shared value once, held by ``SEVERAL``. A value
    that a third of all documents hold thus reaches its part once for each batch, not for each document.
    """
    order = np.lexsort((of, values))
    of, values = of[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    of, values = of[new], values[new]
    shared = sizes_of_runs(values) > 1
    once = np.unique(values[shared])
    asked_of = np.concatenate([of[~shared], np.full(len(once), len(owners), of.dtype)])
    return of[shared], values[shared], np.append(owners, SEVERAL), asked_of, np.concatenate([values[~shared], once])


def shared_pairs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of a part's pairs, (owner, value) of those whose value has another owner, too."""
    owners, values = gather(batches)
    keep = (sizes_of_runs(values) > 1) & (owners != SEVERAL)
    return owners[keep], values[keep]


def gather(batches: Iterator[pa.RecordBatch], by_owner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All (owner, value) pairs of a part, distinct, in order of value and owner.

    With ``by_owner``: (value, owner), in order of owner and value.
    """
    owners, values = [], []
    for batch in batches:
        for o, of, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            v = np.frombuffer(v, np.uint64)
            of = np.frombuffer(of, np.uint16 if len(of) == 2 * len(v) else np.uint32)
            owners.append(np.frombuffer(o, np.int64)[of])
            values.append(v)
    if not values:
        o, v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (v, o) if by_owner else (o, v)
    o, v = np.concatenate(owners), np.concatenate(values)
    x, y = (v, o) if by_owner else (o, v)
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[first], y[first]


def sizes_of_runs(values: np.ndarray) -> np.ndarray:
    """For sorted values: how often each one's value occurs."""
    if not len(values):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    counts = np.diff([*starts, len(values)])
    return np.repeat(counts, counts)


def row_key(*columns: str):
    """Tells rows apart, also where ids are null or repeat; equal rows share it."""
    return F.xxhash64(*columns)


def to_parts(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))
