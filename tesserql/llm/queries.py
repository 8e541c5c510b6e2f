"""The queries ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.llm import bpe, langid, media, packing, pii, secrets, sharding, simhash, tokenfile, topk
from tesserql.llm.common import fresh_dir


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, vocabulary_file("byte_bpe_50k.json"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


#: Room of a bin, in bytes of UTF-8.
BIN_BYTES = 8192


def copies_of(text_col: str) -> Column:
    """A number that equal texts share; null texts, which are empty, have none."""
    return F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(
        docs, BIN_BYTES, F.octet_length("text"), source=F.col("source"), cluster=copies_of("text")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = tokenfile.write_token_files(docs, vocabulary_file("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_token_files(spark, folder, with_ids=False)


#: Arrivals that the table comes in.
ARRIVALS = 4


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, fresh_dir(spark, "shards"))
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.where(arrival == k))
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select(
        "doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_payloads(media.store_texts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_top_k": op2_top_k,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_token_files": op8_token_files,
    "op9_shards": op9_shards,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op9_shards": """
        SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op2_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
