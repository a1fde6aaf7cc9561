"""The jobs as queries: each runs twice into one new folder, and the output is what stands there after the second run."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F

from jobs import index_documents, usage_report
from tessera.plans.registry import query
from tessera.scratch import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "job1_index_documents",
    r"""WITH d AS (
            SELECT doc_id, lang, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text,
                   list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 2), lambda w: lower(w)) AS w
            FROM documents),
        u AS (SELECT doc_id, unnest(w) AS term FROM d)
        SELECT 'document' AS entry, CAST(doc_id % 64 AS INT) AS bucket, path AS name, lang AS language, sha256(text) AS sha256, strlen(text) AS n_bytes,
               CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, CAST(len(w) AS BIGINT) AS length, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms, CAST(NULL AS BIGINT) AS df, CAST(NULL AS BIGINT) AS cf FROM d
        UNION ALL
        SELECT 'term', CAST(doc_id % 64 AS INT) AS bucket, term, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT doc_id), count(*) FROM u GROUP BY bucket, term""",
)
def job1_index_documents(spark, sf):
    """Both tables of the index, one under the other."""
    output = _folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf}/documents.parquet", f"{output}/index", f"{output}/checkpoint")
    documents, terms = index_documents.read(spark, f"{output}/index")
    none = F.lit(None)
    docs = documents.select(
        F.lit("document").alias("entry"), "bucket", F.col("path").alias("name"), "language", "sha256", "n_bytes", "tokens", F.col("length").cast("long").alias("length"),
        F.size("terms").cast("long").alias("n_terms"), none.cast("long").alias("df"), none.cast("long").alias("cf"),
    )
    longs = [none.cast("long").alias(c) for c in ("n_bytes", "tokens", "length", "n_terms")]
    return docs.unionByName(terms.select(F.lit("term").alias("entry"), "bucket", F.col("term").alias("name"), none.cast("string").alias("language"), none.cast("string").alias("sha256"), *longs, "df", "cf"))


@query(
    "job2_usage_report",
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS tool, user_id, ts, CAST(floor(value) AS BIGINT) AS sent, CAST(floor(value * 2) AS BIGINT) AS saved FROM events),
        h AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM e WINDOW w AS (PARTITION BY day, tool, user_id ORDER BY ts)),
        n AS (SELECT *, sum(head) OVER (PARTITION BY day, tool, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM h),
        b AS (SELECT day, tool, user_id, burst, count(*) AS calls FROM n GROUP BY ALL),
        m AS (SELECT day, tool, count(*) AS bursts, max(calls) AS longest_burst FROM b GROUP BY ALL),
        t AS (SELECT day, tool, count(*) AS calls, count(DISTINCT user_id) AS files, CAST(sum(sent) AS BIGINT) AS tokens_sent, CAST(sum(saved) AS BIGINT) AS tokens_saved FROM e GROUP BY ALL)
        SELECT day, tool, calls, files, bursts, longest_burst, tokens_sent, tokens_saved,
               CASE WHEN tokens_saved + tokens_sent = 0 THEN '0%' ELSE (tokens_saved * 100 // (tokens_saved + tokens_sent)) || '%' END AS efficiency,
               printf('$%.2f', tokens_sent * (3.0::DOUBLE / 1e6)) AS cost
        FROM t JOIN m USING (day, tool)""",
)
def job2_usage_report(spark, sf):
    output = _folder(spark, "job2")
    for _ in range(2):
        usage_report.run(spark, f"{sf}/events.parquet", output)
    return usage_report.read(spark, output)
