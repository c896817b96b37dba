"""Registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlane.llm import (ann, exact_dedup, language, minhash, packing, prefix_trie, quality, secret_scan, sharding, simplex,
                          tokenizing, url_filter, wrapper)
from passlane.llm.common import table
from passlane.session import apply_core_conf

#: Where the public tokenizer files are (a parameter of the operators).
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(apply_core_conf(spark), sf_dir, "documents")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(apply_core_conf(spark), sf_dir, "pages")
    return wrapper.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85, rows=5).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_documents(documents(spark, sf_dir), shards=24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    encoded = tokenizing.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), path)
    return tokenizing.decode_documents(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs.select("doc_id", "text"), language.learn(docs)).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(apply_core_conf(spark), sf_dir, "embeddings")
    return ann.nearest(rows, F.pmod(F.col("vec_id"), F.lit(20)) == 0, answers=20)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(apply_core_conf(spark), sf_dir, "pages")
    return url_filter.filter_captures(url_filter.stand_in_captures(pages), url_filter.stand_in_entries(pages))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json", capacity=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(table(apply_core_conf(spark), sf_dir, "embeddings")).drop("n_compared")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(apply_core_conf(spark), sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_main_text, op2_minhash, op3_sharding, op4_bpe, op5_language, op6_secrets, op7_nearest, op8_url_filter,
        op9_packing, op10_exact_dedup, op11_centroids, op12_prefix_trie, op13_quality)}


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


def secrets_sql() -> str:
    """Positions from the lengths of the matches and of the text between them, for each rule."""
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, r, {order} AS o, '{rule.kind}' AS kind, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS a,
         list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS b
  FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM (
    SELECT doc_id, r, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps,
           list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes,
           list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS held
    FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE held[i] >= {rule.least}""")
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    line = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {count}, sha256(coalesce({line} FILTER (o < {len(secret_scan.BASE)}), '')) AS base_sha256,
       coalesce({line}, '') AS spans
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": secrets_sql(), "op8_url_filter": url_filter.ORACLE, "op10_exact_dedup": EXACT_DEDUP_SQL,
            "op11_centroids": simplex.oracle(), "op12_prefix_trie": prefix_trie.ORACLE, "op13_quality": quality.oracle()}
