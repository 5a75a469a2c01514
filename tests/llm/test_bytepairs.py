"""Byte-level BPE against the library, piece by piece and over whole tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from urbanflow.llm import bytepairs
from urbanflow.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytepairs.merges(PATH).rank, special_tokens={})


ROWS = [
    (0, "Plain words, don't stop; 12,345 of them!"), (1, None), (2, ""), (3, " \n\n\t  x  "), (4, "  "), (5, "é ß 日本語 ру́сский 👩‍👩‍👧  \x85\xa0\x1c\x1f​ a"),
    (6, "ab" * 40_000), (7, "<|endoftext|> we'll've"), (8, "=" * 3_000 + "\n" * 50 + "-" * 77), (0, "Plain words, don't stop; 12,345 of them!"), (None, "no id"),
    (9, "word and wörd " * 5_000), (10, "aaaa" * 25 + " " + "a" * 401), (11, "trailing space "), (12, "\x00\x01nul"),
]


def test_texts_and_cases(spark, lib):
    frame = spark.createDataFrame([(i, t, b"x", 5) for i, t in ROWS], "doc_id long, text string, decoded binary, ids int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bytepairs.round_trip(frame, PATH, public.PATTERN, keep=("doc_id", "ids", "decoded")).collect())
    assert got == sorted((-1 if i is None else i, lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)
    coded = bytepairs.encode(frame, PATH, public.PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    again = bytepairs.decode(coded.withColumn("decoded", F.lit(1)), PATH)
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((t or "").encode() for _, t in ROWS)
    assert bytes(bytepairs.decode(coded.limit(1).withColumn("ids", F.lit(None).cast("array<int>")), PATH).first()["decoded"]) == b""
    none = frame.where("false")
    assert bytepairs.round_trip(none, PATH, public.PATTERN).count() == 0 == bytepairs.decode(coded.where("false"), PATH).count()
    with pytest.raises(Exception, match="no token"):
        bytepairs.decode(coded.limit(1).withColumn("ids", F.array(F.lit(1 << 30))), PATH).collect()


def test_pieces_walk_alone_and_together(lib, monkeypatch):
    """Random pieces of few letters and of whole tokens; a table that starts anew; pieces that walk alone."""
    rng, tables = random.Random(3), bytepairs.merges(PATH)
    tokens = list(tables.rank)
    texts = ["".join(rng.choice("abetnios ") for _ in range(rng.randrange(1, 70))) for _ in range(1_500)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12))).decode("utf-8", "ignore") for _ in range(1_500)]
    texts += [rng.choice("!=- a\né1") * rng.randrange(1, 300) + rng.choice("!=- a") * rng.randrange(200) for _ in range(300)]
    want = [lib.encode_ordinary(t) for t in texts]
    for together, most in ((200, 400_000), (3, 50)):
        monkeypatch.setattr(bytepairs, "_TOGETHER", together)
        table, got = bytepairs.PieceTable(PATH, public.PATTERN, most), []
        for start in range(0, len(texts), 100):
            flat, at = table.encode(texts[start : start + 100])
            got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == want


def test_neighbours_fit_as_the_merges_say():
    """Compatibility against plain merges of the joined bytes."""
    rng, tables = random.Random(4), bytepairs.merges(PATH)
    for _ in range(3_000):
        a, b = rng.randrange(5_000), rng.randrange(5_000)
        assert tables.fit(a, b) == (tables._merge(tables.token[a] + tables.token[b]) == [a, b])


def test_query_matches_the_library(spark, lib):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_byte_pairs"](spark, sf).collect()} == want


def test_a_vocabulary_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="a byte has no token"):
        bytepairs.Merges(str(tmp_path / "few"))
