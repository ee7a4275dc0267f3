"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, decontamination, html_extraction, line_dedup, lm_scoring, quality_rules, recompression, secret_scan, simhash
from sluice.llm.compression_classifier import CompressionClassifier
from sluice.llm.packing import pack


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    common.small_batches(spark)
    pieces = pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document."""
    docs = common.table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"), "n_markov"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    common.small_batches(spark)
    return html_extraction.extracted(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality_rules.judged(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its component within four bits."""
    common.small_batches(spark)
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item of which it holds 0.8 of the shingles."""
    common.small_batches(spark)
    return decontamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines found on ten or more sites."""
    found = line_dedup.without_boilerplate(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a smaller document has."""
    common.small_batches(spark)
    found = recompression.without_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and attention-model score."""
    common.small_batches(spark)
    held_out = common.crc32_of_id() % 7 == 2
    found = lm_scoring.scored(common.table(spark, sf_dir, "documents"), ~held_out, tokenizer_path())
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compression score for every document; predicted is 1 from a score of 0.3."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc32_of_id() % 5 == 0
    model = CompressionClassifier.fit(docs, common.table(spark, sf_dir, "labels"), allowed=~held_out)
    return model.score(docs).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op6_decontamination": decontamination.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op8_substring_dedup": recompression.ORACLE_SQL,
}
