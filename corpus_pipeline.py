"""A training-corpus pipeline over the documents table.

Language identification drops documents of no known language, line deduplication drops repeated lines, MinHash keeps one
document of each group of near duplicates, decontamination drops documents that hold a benchmark item, and mixing
decides how many words each source gives. Every stage works on all rows that the one before has kept, null and empty
texts included, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planimetra.llm import decontamination, language, lines, minhash, mixing
from planimetra.llm.tables import stored

#: Share of common shingles, in percent, from which the near_dedup stage takes documents as near duplicates.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language, with all their columns; 'und' ones go."""
    return language.identify(docs).filter(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats; n_chars counts what is left."""
    left = lines.drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group; rows that repeat its id and text leave one."""
    return minhash.keep_first(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.flag(docs, benchmark).filter("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with size, source_size, target, copies and taken."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Kernel regression, MinHash, latent retrieval and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
