"""One query per operator, on whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_sql,
    langid,
    licenses,
    mixing,
    neardup,
    neighbours,
    packing,
    quality,
    repair,
    rules,
    simhash,
    toxicity,
    turntrie,
    warc,
)
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(rows, F.col("vec_id") % 20 == 0)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    return langid.identify(docs, langid.train(docs.where(~held_out))).withColumn(
        "held_out", held_out
    )


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "p_good",
    )


@query(
    "op10_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
    ), d AS (
        SELECT hex, string_agg(letter, '' ORDER BY i) AS digest
        FROM (
            SELECT hex, i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31 AS INT), 1) AS letter
            FROM (SELECT DISTINCT hex FROM p), range(32) AS t(i)
        ) GROUP BY hex
    ), f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
    SELECT page_id, octet_length(encode(body)) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM p JOIN d USING (hex) JOIN f USING (hex)
    """,
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, with_payload=False).drop("url")


@query("op11_simhash_trie")
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op12_conversation_trie", conversation_sql.TRIE)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_conversation_repair", conversation_sql.REPAIR)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))
