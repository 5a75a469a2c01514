"""One query for each operator, over its whole table; the SQL of those that SQL can express is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.llm import bytepairs, decontamination, hardnegatives, jaccard, language_model, licenses, merkle, neighbours, sentencepieces, sharding, substrings, tokenfiles, toxicity
from urbanflow.llm.common import Scratch, crc_of_id, lower_ascii, small_batches
from urbanflow.llm.oracles import ORACLES  # noqa: F401


def _path(name: str) -> str:
    """A public tokenizer's file; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flag(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (crc_of_id(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "op4")
    manifest = tokenfiles.write_tokens(docs, scratch, _path("word_bpe_49k.json"), end=2)
    read = tokenfiles.read_tokens(tokenfiles.document_keys(docs), manifest, digest=True)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_groups(_read(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _path("piece_bpe_32k.model")
    coded = sentencepieces.round_trip(_read(spark, sf_dir, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_read(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), Scratch(spark, "op8"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.cut_spans(docs, substrings.repeated_spans(docs, Scratch(spark, "op9")))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hardnegatives.quantised(F.col("embedding")).alias("vector"))
    return hardnegatives.mine(rows, rows.where("vec_id % 100 = 0"), Scratch(spark, "op11"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf, changed = (merkle.leaf_hash(*(f(F.col(c)) if c == "text" else F.col(c) for c in fields)) for f in (lambda t: t, lower_ascii))
    keep = {"doc_id": F.col("doc_id"), "changed": F.when(crc_of_id(F.col("doc_id"), 5) == 0, changed)}
    proven = merkle.manifest(docs, leaf, Scratch(spark, "op12"), keep=keep)
    folded = proven.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bytepairs.round_trip(_read(spark, sf_dir, "documents"), _path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_shards": op7_shards,
    "op8_neighbours": op8_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_manifest": op12_manifest,
    "op13_byte_pairs": op13_byte_pairs,
}
