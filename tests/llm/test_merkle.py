"""The manifest against a plain recursive one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from urbanflow.llm import merkle
from urbanflow.llm.common import Scratch
from urbanflow.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes, fan):
    """Root, and each node's siblings level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fan * fan
            proofs[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + fan])))
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], proofs


def plain(rows, fan):
    """doc_id, leaf, subroot, root, proof of (doc_id, source, text) rows."""
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id, leaf_of(doc_id, source, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    grown = {s: grow([leaf for _, leaf in groups[s]], fan) for s in names}
    root, tops = grow([grown[s][0] for s in names], fan)
    return root, [(d, leaf, grown[s][0], root, own + top) for s, top in zip(names, tops) for (d, leaf), own in zip(groups[s], grown[s][1])]


ROWS = [
    *((i, "hot", f"text {i % 3}") for i in range(150)), (7, "hot", "text 1"), (7, "hot", "text 1"), (7, "hot", "other"), (None, "hot", "no id"), (None, "hot", None),
    *((i, None, None if i % 2 else "") for i in range(17)), *((i, "", "x" * 20_000) for i in range(2)), *((i, f"s{i}", "É日 Text") for i in range(40)),
    *((-i, "Ünder", "same") for i in range(5)), (1, "n", "named like none"), (2, "�", "bytes"), (3, "\U00010000", "order"),
]


@pytest.mark.parametrize("fan, step", [(2, 2), (3, 1), (16, 2), (16, 1)])
def test_manifest(spark, fan, step):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], "doc_id long, source string, text string, tree string, pos int, n int")
    leaf = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("text"))
    got = merkle.manifest(frame.repartition(5), leaf, Scratch(spark, "t"), fan=fan, step=step)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    rows = got.withColumns({"folded": merkle.fold(F.col("leaf"), F.col("proof")), "digest": merkle.proof_hash(F.col("proof"))}).collect()
    root, want = plain(ROWS, fan)
    order = lambda x: (str(x[0]), x[1:])
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in rows), key=order) == sorted(want, key=order)
    assert {r["folded"] for r in rows} == {root}
    assert sorted(r["digest"] for r in rows) == sorted(H(*(t for s in w[4] for t in s)) for w in want)


def test_one_row_and_none(spark):
    frame = spark.createDataFrame([(5, None, "only")], "doc_id long, source string, text string")
    leaf = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("text"))
    row = merkle.manifest(frame, leaf, Scratch(spark, "t"), keep={"doc_id": F.col("doc_id"), "leaf_text": F.col("text")}).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf_of(5, None, "only") and row["proof"] == [] and row["leaf_text"] == "only"
    assert merkle.manifest(frame.where("false"), leaf, Scratch(spark, "t")).count() == 0


def test_query_tells_changed_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_manifest"](spark, sf).collect()
    for r in rows:
        text = docs[r["doc_id"]] or ""
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    assert {r["verified"] for r in rows} == {True, False} and len(rows) == len(docs)
