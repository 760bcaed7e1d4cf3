"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import (
    byte_bpe_codec,
    collocations,
    embedding_near_dedup,
    language_id,
    merkle_manifest,
    ngram_join,
    quality,
    secret_scan,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    template_decontamination,
    toxicity,
)
from cohortlake.llm.sql import SQL  # noqa: F401 - registered with the queries
from cohortlake.llm.workers import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(n: int) -> Column:
    """The CRC of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int, rest: int) -> Column:
    """Whether the remainder is ``rest``; a missing id has no remainder, so it is not, and is not learned from."""
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.deduplicated(table(spark, folder, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, folder, "documents"), least=50).drop("text_key")


def op3_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return template_decontamination.findings(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, remainder(4) != 2)
    return language_id.predict(docs, model).select(
        "doc_id", held_out(4, 2), "lang_pred", "score")


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_near_dedup.near_duplicates(table(spark, folder, "embeddings"), least=0.95)


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.digests(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")).filter(remainder(3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out(3, 1), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"), words=4, percent=85)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")).filter(remainder(5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out(5, 0), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def manifest(docs: DataFrame, **options) -> DataFrame:
    """The digests of ``documents`` and the roots that folding gives, where 7 divides the id's CRC a tampered one."""
    raised = [F.col("n_chars").cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in merkle_manifest.FIELDS]
    found = merkle_manifest.proofs(
        docs, tampered=F.when(remainder(7) == 0, merkle_manifest.leaf_digest(raised)), **options)
    hexed = merkle_manifest.text_of
    return found.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"), merkle_manifest.siblings_digest(F.col("steps")).alias("proof_sha256"),
        merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe_codec.digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_template_decontamination": op3_template_decontamination,
    "op4_language_id": op4_language_id,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
}
