"""A training corpus from ``documents``: filter, clean, deduplicate, decontaminate, pack.

Every stage takes what the one before has kept, written and read again, so a
lost executor costs no more than a part of the running stage.  All stages but
the last return the columns of ``documents``; the last returns the packed
pieces.  Rows without a doc_id pass the stages that go by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, decontamination, line_dedup, simhash
from sluice.llm.compression_classifier import CompressionClassifier
from sluice.llm.packing import pack
from sluice.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least ``LEAST_SCORE``; every fifth label is left for evaluation."""
    common.small_batches(spark)
    model = CompressionClassifier.fit(docs, common.table(spark, sf_dir, "labels"), allowed=common.crc32_of_id() % 5 != 0)
    return model.score(docs.select(*COLUMNS)).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines."""
    kept = line_dedup.without_boilerplate(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: within 4 bits, or with 0.8 of their five-word shingles in common.

    Rows that repeat an id go or stay together, by any of their texts.
    """
    common.small_batches(spark)
    copies = simhash.groups(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that repeat an id go if one of their texts holds one."""
    common.small_batches(spark)
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; ids as unsigned 32-bit little-endian numbers."""
    common.small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", clean),
    ("packing", packed),
]

#: The classifier, the components and the packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
