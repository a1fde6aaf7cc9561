"""Counts, listings and overviews of an index: files, symbols, edges."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tessera.functions.text import alias_of, language_of


def index_counts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, n) for files, symbols and edges."""
    named = [(files, "files"), (symbols, "symbols"), (edges, "edges")]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n") for df, name in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_symbols"))


def workspace_tokens(files: DataFrame) -> DataFrame:
    return files.agg(F.floor(F.coalesce(F.sum("char_count"), F.lit(0)) / 4).cast("long").alias("tokens"))


def repo_stats(repos: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(alias, n_files, n_symbols), empty repositories included; both sides are counted before they meet the list."""
    by_file = files.select("path").distinct().groupBy(alias_of(F.col("path")).alias("alias")).agg(F.count(F.lit(1)).alias("f"))
    by_symbol = symbols.groupBy(alias_of(F.col("path")).alias("alias")).agg(F.count(F.lit(1)).alias("s"))
    joined = repos.select("alias").join(by_file, "alias", "left").join(by_symbol, "alias", "left")
    return joined.select("alias", F.coalesce("f", F.lit(0)).alias("n_files"), F.coalesce("s", F.lit(0)).alias("n_symbols"))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "language")


def top_files(symbols: DataFrame, limit: int = 10) -> DataFrame:
    return symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols")).orderBy(F.desc("n_symbols"), "path").limit(limit)


def top_directories(files: DataFrame, limit: int = 5) -> DataFrame:
    first = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(first.alias("directory")).agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "directory").limit(limit)


def exported_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_exported").orderBy("path", "name", "line")


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("line", "col")


def list_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, language, n_symbols in order of path."""
    counts = symbols_per_file(files, symbols)
    return files.select("path", "language").join(counts, "path").orderBy("path")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def symbol_slices(symbols: DataFrame, files: DataFrame, name: str | None = None) -> DataFrame:
    """Source of each symbol: its line up to the line before the next symbol of the file. symbols: path, name, line, col."""
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line", "col", "name"))
    ranged = symbols.withColumn("_next", after)
    if name is not None:
        ranged = ranged.where(F.col("name") == name)
    lines = F.split("text", "\n")
    stop = F.coalesce(F.col("_next"), F.size(lines) + 1)
    source = F.array_join(F.slice(lines, F.col("line"), F.greatest(stop - F.col("line"), F.lit(1))), "\n")
    return ranged.join(files.select("path", "text"), "path").select("path", "name", "line", source.alias("source"))
