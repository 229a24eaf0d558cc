"""The corpus pipeline: stages that each work on all that the stage before has kept.

Language ID drops documents that it rejects, near-dedup keeps one document of each group, decontamination drops documents
that hold benchmark items, the secret scan redacts what it finds, and packing cuts what is left into sequences with its text.

Defined results: documents with a null or empty text, or without letters, go in the first stage; rows with a null doc_id
are never duplicates nor contaminated, and stay; of rows that repeat an id and a text one stays, and rows of one id and
different texts are duplicates or not by their texts; texts of any length are read whole; an empty table, or an empty
benchmark, gives what the stages give for it: an empty result, or no document less. Further columns of documents pass through
all stages but the last, whatever their names; n_chars is optional and follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tukeyframe.llm import decontaminate, langid, neardup, packing, scratch, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models accept. Documents without letters, or unlike all languages, go."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a placeholder; n_chars follows the new text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its span, text, bin and place: a bin's rows by bin_offset are a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Language models and packing have no SQL form; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
