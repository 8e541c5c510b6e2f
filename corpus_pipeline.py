"""The document pipeline: language identification, near-duplicate removal,
secret removal and packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and all but the last return the columns of their input.  An empty input
passes through all stages; what a stage does with nulls, ties and repeated rows
is told by the operator that it calls.

ORACLE_SQL is None: none of the stages is expressible in SQL.  Tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.llm import langid, neardup, packing, secrets
from tesserql.llm.common import fresh_dir
from tesserql.llm.queries import BIN_BYTES, copies_of, vocabulary_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be told."""
    path = vocabulary_file("piece_bpe_32k.model")
    langs, model = langid.learn(docs.where(~langid.held_out()), path)
    return langid.keep_known(docs, path, langs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group."""
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by their kinds; all documents stay."""
    clean = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in clean.columns:
        return clean
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", n)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of all documents: ``(doc_id, piece, start, length, bin_id)``."""
    return packing.pack(
        docs, BIN_BYTES, F.octet_length("text"), source=F.col("source"), cluster=copies_of("text")
    )


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the
    shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
