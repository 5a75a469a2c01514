"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. Stages 1 to 4 return the columns of documents; the last returns each kept
document's SentencePiece ids and decoded text as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.llm import decontamination, jaccard, sentencepieces, substrings, toxicity
from urbanflow.llm.common import Scratch, small_batches

#: Keys of removed documents (8 bytes each) that are broadcast, at most; more meet documents by a shuffle.
BROADCAST_KEYS = 1_000_000
#: What the stage before has written below the shared folder.
_last: list[Scratch] = []


def _start(spark: SparkSession, name: str) -> Scratch:
    """Scratch space of a stage. The stage before has been written by now, so its space is dropped."""
    while _last:
        _last.pop().drop()
    small_batches(spark)
    _last.append(Scratch(spark, name))
    return _last[-1]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the labels of the training folds.

    Whole texts are scored, however long. Null and empty texts are scored as texts without words. Repeated
    rows share a score and stay or go together; null ids are rows like others. No rows give no rows. All
    columns stay, whatever their names.
    """
    _start(spark, "toxicity")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), to="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard links join: that with the least id; texts without words stay.

    Rows of a group that share the least id, or all have none, are told apart by their text; of equal
    rows one stays.
    """
    scratch = _start(spark, "jaccard")
    groups = scratch.table(jaccard.jaccard_groups(docs, scratch).where("n_shingles > 0").drop("n_shingles"), "groups")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # mostly one row a group
    firsts = groups.where(least).groupBy("group_key").agg(F.min("row_key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rivals = groups.where(least).join(firsts, "group_key")
    gone = groups.where(~least).select("row_key").union(rivals.where("row_key <> keep").select("row_key"))
    gone = scratch.table(gone.select(F.col("row_key").alias("__key")).distinct(), "gone")
    equal = rivals.where("row_key = keep").groupBy(F.col("row_key").alias("__key")).count().where("count > 1").select("__key")
    equal = scratch.table(equal, "equal")
    few, repeated = ((F.broadcast(k), n) if (n := k.count()) <= BROADCAST_KEYS else (k, n) for k in (gone, equal))
    kept = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(few[0], "__key", "left_anti")
    if repeated[1]:
        kept = kept.join(repeated[0], "__key", "left_anti").unionByName(kept.join(repeated[0], "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has; a text that loses none is unchanged.

    A text whose words all go is dropped, one that had none stays. ``n_chars``, if there, is that of the new text.
    """
    spans = substrings.repeated_spans(docs, _start(spark, "substrings"))
    cut = substrings.cut_spans(docs, spans, made=("__n", "__gone", "__kept"))
    kept = cut.where("__gone = 0 or __gone < __n")
    new = {"text": F.when(F.col("__gone") > 0, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n_chars = F.length("__kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("__gone") > 0, n_chars).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null, empty and very short texts overlap with none and stay; long ones are looked at whole. Rows of
    equal id and text stay or go together, null ids included. No rows, or no benchmark, drop nothing. All
    columns stay, whatever their names.
    """
    scratch = _start(spark, "decontamination")
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 of every document that is left.

    Null and empty texts have no ids and the hashes of empty text; a text of any length is one row.
    Repeated rows and null ids stay as they are. No rows give no rows. Other columns go.
    """
    import public_tokenizers

    _start(spark, "sentencepieces")
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.round_trip(docs, model, keep=("doc_id", "lang", "source"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", remove_toxic),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the learned classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = kept.table(stage(spark, docs, sf_dir), name)
        if k:
            kept.drop(STAGES[k - 1][0])
    while _last:
        _last.pop().drop()
    return docs
