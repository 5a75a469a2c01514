"""Helpers shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.scratch import Scratch  # noqa: F401

#: Words are runs of bytes other than ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches end at ``size`` bytes, unless the session has its own setting.

    By default a batch may hold 64 MB of long texts, several times over in JVM buffers and worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``; grows with the input."""
    return max(least, math.ceil((total or 0) / each))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words in order, A-Z lower-cased if asked; ``bytes`` know exactly ASCII letters and white space."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def runs_of(texts: list, most: int = 1_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text makes a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def keep_memory(size: int = 32 << 20) -> None:
    """Let arrays up to ``size`` take memory that others have freed, instead of fresh pages each time.

    Touching a fresh page costs more than most numpy work on it. ``give_back`` ends a task's hold.
    """
    import ctypes

    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc alone has it
    if tune is not None:
        tune(-3, size)  # M_MMAP_THRESHOLD
        tune(-1, 2 * size)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as the worker lives on for other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


class IdTable:
    """Ids of each distinct word, found once, and the ids of many words in order.

    ``find`` gives the ids of a list of words that the table doesn't hold. Ids lie in one growing array,
    so a word costs its key and three numbers. Beyond ``most`` words the table starts anew: a worker's
    memory is bounded however many distinct words there are.
    """

    def __init__(self, find: Callable[[list], Iterable], most: int):
        self.find, self.most = find, most
        self._clear()

    def _clear(self) -> None:
        self.rows: dict = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def gather(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in one array, and where each word's end (a 0 first)."""
        if len(self.rows) > self.most:
            self._clear()
        known = self.rows
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))  # one look-up for a word that is known
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missed = [words[i] for i in unknown.tolist()]
            new = list(dict.fromkeys(missed))
            found = list(self.find(new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            more = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            self.flat = np.concatenate([self.flat, more])
            at[unknown] = np.fromiter(map(known.__getitem__, missed), np.int64, len(missed))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(self.begin[at] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[own], ends
