"""The corpus pipeline: five stages over documents, each a Spark job over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm import quality
from sievestone.llm.common import Scratch
from sievestone.llm.decontamination import decontaminate
from sievestone.llm.line_dedup import dedup_lines
from sievestone.llm.minhash_dedup import keep_one
from sievestone.llm.packing import pack_documents
from sievestone.llm.queries import quality_model, table

#: A character that is no white space, as ``str.split`` and so line dedup see it.
WORDS = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; null texts score as empty ones, repeated rows alike, and an empty table stays empty."""
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir), least=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with one line kept of each class of near-equal lines; texts that had lines and lose them all go.

    Null, empty and blank texts stay as they are. Lines of null ids come after
    all others; rows of equal id and text are one document and lose the same.
    """
    kept = dedup_lines(docs.withColumn("n_chars", F.coalesce(F.col("text").rlike(WORDS), F.lit(False)).cast("long")))
    kept = kept.where((F.col("n_chars") == 0) | F.col("text").rlike(WORDS))  # n_chars: whether the text had words
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words; wordless texts and rows with a null id stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words; every row is judged by its own text, null ids and repeats too, null texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048; a null text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Stages hold models, tokenizers and packing, which SQL cannot express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
