"""Groups of near copies where passages are common: rare shingles first, blocks in rounds, rows let through by a filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanflow.llm import jaccard
from urbanflow.llm.common import Scratch


def plain(rows):
    """Component of each document, from all pairs."""
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    comp, ids = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that an operator writes."""
    out, write = {}, Scratch.table

    def table(self, df, name, by=None):
        back = write(self, df, name, by)
        out[name] = back.count()
        return back

    monkeypatch.setattr(Scratch, "table", table)
    return out


def test_a_passage_in_all_documents_makes_no_group(spark, written):
    """Pairs of near copies that all hold one passage: each meets its own copy, not everyone."""
    passage, rows = [f"p{k}" for k in range(40)], []
    for i in range(60):
        own = [f"d{i}_{k}" for k in range(60)]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join([*own[:30], "other", *own[31:], *passage]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(df, Scratch(spark, "t")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
    assert written["members"] == 60


def test_blocks_in_rounds(spark, monkeypatch, written):
    """Documents made of the same few parts: large groups of which little links, more than one round."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)
    rng = np.random.default_rng(4)
    parts = [[f"w{j}_{k}" for k in range(10)] for j in range(12)]
    rows = []
    for i in range(70):
        words = [w for j in sorted(rng.choice(12, 8, replace=False)) for w in parts[j]]
        for _ in range(int(rng.integers(0, 2))):
            words[int(rng.integers(80))] = "x"
        rows.append((i, " ".join(words)))
    want = plain(rows)
    assert 1 < len(set(want.values())) < 70
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(df, Scratch(spark, "t")).collect()} == want
    assert "links-more-1" in written


def test_row_filter(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 60_000)
    rows = spark.createDataFrame([(int(k),) for k in keys[:30_000]], "row_key long")
    flags = jaccard.row_filter(rows, 30_000)
    assert jaccard.may_pass(flags, keys[:30_000]).all() and jaccard.may_pass(flags, keys[30_000:]).mean() < 0.05
    assert not jaccard.may_pass(jaccard.row_filter(rows.where(F.lit(False)), 0), keys).any()
