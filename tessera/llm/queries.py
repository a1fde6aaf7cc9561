"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.chat import format_chat
from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.packing import pack
from tessera.llm.secrets import secret_digests
from tessera.llm.sharding import balanced_shards
from tessera.llm.simhash import near_duplicates
from tessera.llm.spelling import spelling_variants
from tessera.llm.sstable import token_files
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity
from tessera.llm.warc import archived_pages
from tessera.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_docs(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_docs(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_docs(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("items", "hits", "longest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_chat_format": op10_chat_format,
    "op11_spelling": op11_spelling,
    "op12_warc": op12_warc,
}

ORACLES: dict[str, str] = {
    "op8_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                   lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
            SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
                   unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram
            FROM d, sizes WHERE len(w) >= n
        ), m AS (SELECT doc_id, dw.n, pos, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram
        ), spots AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS spot FROM m
        ), h AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id
        ), i AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, count(*) AS group_size, max(points) AS most FROM t GROUP BY text_sha256
        ), k AS (
            SELECT t.text_sha256, min(t.doc_id) AS keep_id FROM t JOIN g ON t.text_sha256 = g.text_sha256 AND t.points = g.most
            GROUP BY t.text_sha256
        )
        SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id = k.keep_id AS kept, t.text_sha256
        FROM t JOIN g USING (text_sha256) JOIN k USING (text_sha256)
    """,
    "op12_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
        ), d AS (SELECT page_id, strlen(html) AS payload_bytes, first_id, sha1(html) AS hex FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d
    """,
}
