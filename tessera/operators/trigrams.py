"""Name search by substring without a scan: an index from the trigrams of names to the names, intersected and verified."""

from __future__ import annotations

import re
import uuid
import zlib
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessera.operators.search import like_pattern, search_symbols
from tessera.scratch import made, materialise, reread, shared_dir

N, BUCKETS, SLICES = 3, 64, 16


def _bucket(text: Column) -> Column:
    return (F.crc32(F.encode(text, "UTF-8")) % BUCKETS).cast("int")


def _laid_out(rows: DataFrame, *order: str) -> DataFrame:
    """Written in partitions by `bucket`, a bucket by several tasks, and sorted."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    made(spark, path)
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("name"), F.lit(SLICES)))
    dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
    return reread(spark, path, rows)


def grams_of(text: str) -> list[str]:
    """Trigrams, by code point, of the parts of a query that no wildcard interrupts: every match has all of them."""
    return sorted({part[i : i + N] for part in re.split("[%_]", text.lower()) for i in range(len(part) - N + 1)})


def name_index(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables (gram, name, bucket) over distinct lower-case names, and the symbols with `lower_name` and its bucket.

    Both are laid out by hash partitions, so that a search reads those of its trigrams, and of the names it has found. Names
    without a trigram are in the second table only; null names in neither.
    """
    named = symbols.where(F.col("name").isNotNull()).withColumn("lower_name", F.lower("name"))
    names = named.select(F.col("lower_name").alias("name")).distinct().where(F.length("name") >= N)
    starts = F.sequence(F.lit(1), F.length("name") - (N - 1))
    grams = names.select("name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("name").substr(i, F.lit(N))))).alias("gram"))
    rows = named.withColumn("bucket", _bucket(F.col("lower_name")))
    return _laid_out(grams.withColumn("bucket", _bucket(F.col("gram"))), "gram", "name"), _laid_out(rows, "lower_name")


def trigram_search(grams: DataFrame, symbols: DataFrame, query: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `search_symbols`, and one row (grams_read, candidates, symbols_read) of how many rows that took.

    Names that have all trigrams of the query are candidates, each counted once for each trigram it has; the LIKE pattern
    verifies them, and only symbols with such a name are read. A query without a trigram (fewer than three characters in a
    row without a wildcard) says nothing about names, so all symbols are read then.
    """
    wanted = grams_of(query)
    columns = [c for c in symbols.columns if c not in ("lower_name", "bucket")]
    if not wanted:
        n = symbols.agg(F.lit(0).cast("long").alias("grams_read"), F.lit(0).cast("long").alias("candidates"), F.count(F.lit(1)).alias("symbols_read"))
        return search_symbols(symbols.select(columns), query, limit), n
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in wanted})
    read = grams.where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    have = materialise(read.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    # With every trigram, in any order: the pattern decides.
    found = have.where(F.col("n") == len(wanted))
    names = materialise(found.where(F.col("name").like(like_pattern(query))).select(F.col("name").alias("lower_name"), _bucket(F.col("name")).alias("bucket")))
    some = [r.bucket for r in names.select("bucket").distinct().collect()]  # BUCKETS at most
    hit = symbols.where(F.col("bucket").isin(some)).join(names, ["bucket", "lower_name"], "left_semi")
    sums = [have.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("grams_read")), found.agg(F.count(F.lit(1)).alias("candidates")), hit.agg(F.count(F.lit(1)).alias("symbols_read"))]
    return search_symbols(hit.select(columns), query, limit), reduce(DataFrame.crossJoin, sums)  # one row each
