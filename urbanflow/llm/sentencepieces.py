"""SentencePiece encoding and decoding with a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanflow.llm.common import IdTable, give_back, runs_of

MARK = "▁"
#: A marked word: its run of markers and what follows up to the next marker.
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def check_model(path: str) -> None:
    """Refuse a model for which marked words can't be segmented one by one."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != train.BPE or train.treat_whitespace_as_suffix:
        raise ValueError("the distinct-chunk table needs a BPE model with leading markers")
    if norm.remove_extra_whitespaces or not norm.add_dummy_prefix or norm.precompiled_charsmap:
        raise ValueError("the distinct-chunk table needs a model that leaves its input unchanged")
    if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
        raise ValueError("a piece crosses a whitespace marker")
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError("user-defined pieces are matched before words are parted")


class ChunkTable:
    """Ids of each distinct marked word, segmented once by the library while the table lasts."""

    def __init__(self, path: str, most: int = 200_000):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lone = [self.lib.piece_to_id(MARK)]
        self.table = IdTable(self._segment, most)

    def _segment(self, words: list[str]) -> list[list[int]]:
        # the library puts one marker before its input, so each word goes in without its first
        found = self.lib.encode([w[1:] for w in words], num_threads=1)
        return [ids if len(w) > 1 else self.lone for w, ids in zip(words, found)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts (with the end)."""
        words, counts = [], [0]
        for t in texts:
            if t:
                words += _CHUNK.findall(MARK + t.replace(" ", MARK))
            counts.append(len(words))
        flat, ends = self.table.gather(words)
        return flat, ends[counts]


def _table(docs: DataFrame, keep: tuple[str, ...], made: dict[str, T.DataType]) -> tuple[tuple[str, ...], T.StructType]:
    """Columns that are kept (not those named like one that is made), and the schema of the result."""
    keep = tuple(c for c in keep if c not in made)
    return keep, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(k, t) for k, t in made.items())])


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int): what the library's encode gives for the whole text.

    A text is cut before each run of whitespace markers. As no piece holds a marker after another
    character, no merge crosses a cut, so each distinct marked word is segmented once in a task and ids
    are joined back by position. No rows move between tasks.

    Null and empty texts have no ids. Repeated rows stay. A text of any length is one row of ids; about
    2,000,000 characters are encoded at once, or one longer text. A kept column named ``ids`` gives way.
    ``model`` is a path that all executors can open.
    """
    return _run(docs, model, text, keep, decoded=False)


def round_trip(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` as ``encode`` gives them, and ``decoded``: the library's decode of those.

    One pass, in which ids go from encoder to decoder inside the task. Cases are those of ``encode``; a
    kept column named ``decoded`` gives way, too.
    """
    return _run(docs, model, text, keep, decoded=True)


def _run(docs: DataFrame, model: str, text: str, keep: tuple[str, ...], decoded: bool) -> DataFrame:
    check_model(model)
    made = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if decoded else {})
    keep, schema = _table(docs, tuple(keep), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for part in runs_of(texts, 2_000_000):
                flat, starts = table.encode(texts[part])
                own = batch.slice(part.start, part.stop - part.start)
                out = [*own.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))]
                if decoded:
                    out.append(pa.array([table.lib.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(starts, starts[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(out, schema.names)
        del table
        give_back()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the library's decode of each row's ids; null or no ids give empty text.

    An older column of that name gives way.
    """
    keep, schema = _table(rows, tuple(rows.columns), {to: T.StringType()})
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                own = batch.slice(start, 500)
                texts = [lib.decode(x) if x else "" for x in own.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], schema.names)
        give_back()

    return rows.select(*keep).mapInArrow(run, schema)
