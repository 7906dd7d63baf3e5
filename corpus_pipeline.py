"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is one operator of ``sparkchemo.llm`` and works on all that the stage before
kept. All but the last return the columns of ``documents``; ``run`` writes each
stage's result to the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkchemo.llm import decontaminate, language, line_dedup, near_dedup, packing
from sparkchemo.llm.common import stored

#: Two documents are copies from this similarity in per cent on, over shingles of five words.
ALIKE = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the cross-parser can tell; those without text or letters go."""
    own = F.struct("doc_id", F.xxhash64("text").alias("text"))  # a doc_id may repeat with another text, or be null
    found = language.predict(docs.select(own.alias("doc_id"), "text"), language.fit(docs))
    rejected = found.where(F.col("lang_pred") == language.UNKNOWN).select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(rejected, own == F.col("_row"), "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document repeats; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    found = near_dedup.near_duplicates(docs, percent=ALIKE, width=5)
    return docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL has no word for tokenising and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
