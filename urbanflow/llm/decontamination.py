"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch

#: Masks over consecutive words; 1 marks a position that is hashed, 0 one that may differ.
MASKS = ("1110100101", "1101011001")
#: Benchmark seeds up to this number are broadcast, with the items' words; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
_GAP = "[^\\p{L}\\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order."""
    return F.transform(F.split(F.trim(F.regexp_replace(F.lower(text), _GAP, " ")), " "), lambda w: F.xxhash64(w))


def _seed(words: str, at: str, mask: str, number: int) -> str:
    cells = ", ".join(f"{words}[{at} + {i}]" for i, bit in enumerate(mask) if bit == "1")
    return f"xxhash64({number}, {cells})"


def _seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``pos`` and ``seed``: one row for each mask at each place it fits."""
    span = max(map(len, masks))
    # explode_outer: an inner explode would add a filter that computes the sequence a second time
    placed = rows.select(
        *dict.fromkeys([*keep, "hw"]),
        F.explode_outer(F.expr(f"if(size(hw) >= {span}, sequence(0, size(hw) - {span}), null)")).alias("pos"),
    ).where("pos is not null")
    hashes = ", ".join(_seed("hw", "pos", m, i) for i, m in enumerate(masks))
    return placed.select(*keep, "pos", F.explode_outer(F.expr(f"array({hashes})")).alias("seed"))


def _overlap() -> Column:
    """Best stretch of the aligned words: 1 for each that agrees, -2 for each that differs."""
    return F.expr("""
        aggregate(
            zip_with(
                slice(hw, greatest(shift, 0) + 1, least(size(hw) - greatest(shift, 0), size(bw) - greatest(-shift, 0))),
                slice(bw, greatest(-shift, 0) + 1, least(size(hw) - greatest(shift, 0), size(bw) - greatest(-shift, 0))),
                (x, y) -> if(x = y, 1, -2)),
            named_struct('now', 0, 'best', 0),
            (a, s) -> named_struct('now', greatest(a.now + s, 0), 'best', greatest(a.best, a.now + s)),
            a -> a.best)
    """)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    least_score: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Documents and benchmark items that overlap: doc_id, row_key, item_id, score.

    Each mask is laid at every word of documents and items and hashes the words at its marked places, so
    a passage with replaced words still shares a seed. Around a shared seed, item and document are
    aligned and the best stretch is scored (1 for a word that agrees, -2 for one that differs): an item
    is found from ``least_score`` on, or from 0.6 of its words where that is less.

    ``row_key`` hashes id and text, so rows that repeat an id are told apart. Null and empty texts, and
    documents or items with fewer words than a mask, overlap with nothing. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), word_hashes(F.col(text)).alias("hw")
    )
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("hw")).where(
        F.col("hw").isNotNull()
    )
    known = _seeds(items, ["item_id"], masks).select("item_id", F.col("pos").alias("bpos"), "seed").distinct()
    placed = _seeds(rows, ["doc_id", "row_key", "hw"], masks)
    bodies = items.select("item_id", F.col("hw").alias("bw"))
    if known.count() <= broadcast_seeds:
        # words stay in the row: positions are exploded, hashed and met in one generated loop
        hits = placed.join(F.broadcast(known), "seed").join(F.broadcast(bodies), "item_id")
    else:
        met = placed.select("doc_id", "row_key", "pos", "seed").join(known, "seed")
        hits = met.join(rows.select("row_key", "hw"), "row_key").join(bodies, "item_id")
    scored = hits.withColumn("shift", F.col("pos") - F.col("bpos")).select(
        "doc_id", "row_key", "item_id", F.size("bw").alias("n"), _overlap().alias("score")
    )
    # filtered after the aggregate: as a join condition the score would end the generated loop
    best = scored.groupBy("doc_id", "row_key", "item_id", "n").agg(F.max("score").alias("score"))
    return best.where(F.col("score") >= F.least(F.lit(least_score), F.ceil(F.col("n") * 0.6))).drop("n")


def flag(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document: doc_id, n_items (items found in it), best_score, contaminated.

    Null and empty texts, and no benchmark, give rows that aren't contaminated; an empty table gives no
    rows. Rows are told apart by id and text, so repeated rows each get the same answer and null ids are
    rows like others. Very long texts are looked at whole. Other columns are not looked at.
    """
    found = overlaps(docs, benchmark, doc_id=doc_id, text=text, **how)
    by_row = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n_items"), F.max("score").alias("best_score"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"))
    return keyed.join(by_row, "row_key", "left").select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("best_score", F.lit(0)).cast("int").alias("best_score"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", broadcast_keys: int = 1_000_000, **how
) -> DataFrame:
    """The documents, all columns, that overlap with no benchmark item.

    Keys of the others are written and counted: up to ``broadcast_keys`` (8 bytes each) they are
    broadcast and documents stay where they are; more are joined by a shuffle.
    """
    bad = scratch.table(overlaps(docs, benchmark, doc_id=doc_id, text=text, **how).select(F.col("row_key").alias("__key")).distinct(), "bad")
    few = F.broadcast(bad) if bad.count() <= broadcast_keys else bad
    return docs.withColumn("__key", F.xxhash64(doc_id, text)).join(few, "__key", "left_anti").select(*docs.columns)


_WORDS = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


def _sql_seeds(source: str, key: str) -> str:
    span = max(map(len, MASKS))
    masked = " UNION ALL ".join(
        f"SELECT {key}, w, pos, {n} AS m, concat_ws(' ', "
        + ", ".join(f"w[pos + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        + f") AS seed FROM {source}_pos"
        for n, mask in enumerate(MASKS)
    )
    return f"""{source}_w AS (SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL),
{source}_pos AS (SELECT {key}, w, unnest(range(0, len(w) - {span - 1})) AS pos FROM {source}_w WHERE len(w) >= {span}),
{source}_seed AS ({masked})"""


ORACLE = f"""
WITH {_sql_seeds("documents", "doc_id")}, {_sql_seeds("benchmark", "item_id")},
hit AS (SELECT DISTINCT d.doc_id, b.item_id, d.w AS dw, b.w AS bw, d.pos - b.pos AS shift
        FROM documents_seed d JOIN benchmark_seed b USING (m, seed)),
cell AS (SELECT doc_id, item_id, shift, len(bw) AS n, j, CASE WHEN dw[j + shift] = bw[j] THEN 1 ELSE -2 END AS s
         FROM (SELECT *, unnest(range(greatest(1, 1 - shift), least(len(bw), len(dw) - shift) + 1)) AS j FROM hit)),
run AS (SELECT doc_id, item_id, shift, n, j, sum(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS upto FROM cell),
low AS (SELECT *, least(0, min(upto) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM run),
best AS (SELECT doc_id, item_id, shift, n, max(upto - coalesce(low, 0)) AS score FROM low GROUP BY ALL),
found AS (SELECT doc_id, item_id, max(score) AS score FROM best
          WHERE score >= least(10, ceil(n * 0.6)) GROUP BY ALL)
SELECT d.doc_id, count(f.item_id) AS n_items, CAST(coalesce(max(f.score), 0) AS INTEGER) AS best_score,
       count(f.item_id) > 0 AS contaminated
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
