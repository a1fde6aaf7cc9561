"""Graph operators over symbols (symbol_id, path, name, ...) and edges (from_id, to_id, kind)."""

from __future__ import annotations

import uuid
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessera.functions.text import alias_of, severity
from tessera.scratch import made, materialise, shared_dir


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct edges without self edges."""
    return edges.where("from_id <> to_id").dropDuplicates(["from_id", "to_id", "kind"])


#: Buckets that the edges into one symbol are dealt to, so that a symbol everything depends on is no single task's.
PARTS = 8


def reverse_edges(edges: DataFrame) -> tuple[DataFrame, str]:
    """(symbol_id, part, next_id) of distinct edges as a bucketed table, and its name: a join by symbol_id and part shuffles
    the other side only. The caller drops the table."""
    spark = edges.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_edges_{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("from_id"), F.lit(PARTS)).cast("int").alias("part")
    rows = edges.where("from_id is not null and to_id is not null").select(F.col("to_id").alias("symbol_id"), part, F.col("from_id").alias("next_id"))
    path = f"{shared_dir(spark)}/{name}"
    made(spark, path)
    rows = rows.repartition(n, "symbol_id", "part").dropDuplicates()
    rows.write.bucketBy(n, "symbol_id", "part").sortBy("symbol_id", "part").option("path", path).saveAsTable(name)
    return spark.table(name), name


def reach(edges: DataFrame, start: DataFrame, max_depth: int = 0) -> DataFrame:
    """(symbol_id, depth) of everything that depends on `start` (symbol_id), by fewest reverse edges; start left out.

    max_depth 0 is unlimited. Breadth first: each hop joins the frontier with the edges, keeps what is new, and writes it,
    so lineage stays short and lost executors cost one hop. Edges are laid out once, in buckets, unless there is just one
    hop; from then on a hop shuffles its frontier, never the edges. Stops when a hop finds nothing. Tables of ids are small
    as files however many they are, so joins with them are told to merge: the driver is to broadcast none of them.
    """
    if max_depth == 1:
        every, by, name = edges.where("from_id is not null").select(F.col("to_id").alias("symbol_id"), F.col("from_id").alias("next_id")), ["symbol_id"], None
    else:
        (every, name), by = reverse_edges(edges), ["symbol_id", "part"]
    frontier = materialise(start.select("symbol_id").distinct())
    seen, found, depth = frontier, [], 0
    while not max_depth or depth < max_depth:
        depth += 1
        fresh = hop(frontier, every, by)
        frontier = materialise(fresh.join(seen.hint("merge"), "symbol_id", "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    if name:
        edges.sparkSession.sql(f"DROP TABLE {name}")  # what was found is written
    out = start.select("symbol_id").limit(0).withColumn("depth", F.lit(0))
    for f in found:
        out = out.unionByName(f)
    return out


def hop(frontier: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """The distinct other ends of edges at a frontier, each of whose symbols asks every part."""
    if "part" in by:
        frontier = frontier.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return frontier.hint("merge").join(edges, by).select(F.col("next_id").alias("symbol_id")).distinct()


def impact(symbols: DataFrame, edges: DataFrame, symbol_id, max_depth: int = 0) -> DataFrame:
    """One row per affected file: path, names (sorted), n_symbols, min_depth; ids without a symbol are not counted."""
    start = symbols.sparkSession.createDataFrame([(symbol_id,)], symbols.select("symbol_id").schema)
    hit = reach(edges, start, max_depth).hint("merge").join(symbols.select("symbol_id", "path", "name"), "symbol_id")
    return hit.groupBy("path").agg(
        F.array_sort(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n_symbols"), F.min("depth").alias("min_depth")
    )


def impact_summary(affected: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n_symbols"), F.lit(0))
    return affected.agg(F.count(F.lit(1)).alias("files"), total.alias("symbols")).withColumn("severity", severity(F.col("symbols")))


def file_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_path, to_path, n) of edges between different files; both ends are looked up once and summed early."""
    at = symbols.select("symbol_id", "path")
    src = at.select(F.col("symbol_id").alias("from_id"), F.col("path").alias("from_path"))
    dst = at.select(F.col("symbol_id").alias("to_id"), F.col("path").alias("to_path"))
    joined = edges.join(src, "from_id").join(dst, "to_id").where("from_path <> to_path")
    return joined.groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("n"))


def related_files(symbols: DataFrame, edges: DataFrame, pivots: DataFrame, limit: int = 10) -> DataFrame:
    """(path, n_edges) of files joined to a pivot by edges in either direction, pivots left out, most edges first."""
    pairs = file_edges(symbols, edges)
    own = pivots.select("path").distinct()
    one = pairs.join(own, pairs.from_path == own.path, "left_semi").select(F.col("to_path").alias("path"), "n")
    two = pairs.join(own, pairs.to_path == own.path, "left_semi").select(F.col("from_path").alias("path"), "n")
    both = one.unionByName(two).join(own, "path", "left_anti").groupBy("path").agg(F.sum("n").alias("n_edges"))
    return both.orderBy(F.desc("n_edges"), "path").limit(limit)


def dependencies(symbols: DataFrame, edges: DataFrame, name: str, direction: str = "out") -> DataFrame:
    """For every symbol of this name: symbol_id, path, and each neighbour's edge_kind, other_name, other_path; a symbol
    without neighbours keeps one row with nulls."""
    here, there = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    own = symbols.where(F.col("name") == name).select("symbol_id", "path")
    links = edges.select(F.col(here).alias("symbol_id"), F.col(there).alias("other_id"), F.col("kind").alias("edge_kind"))
    others = symbols.select(F.col("symbol_id").alias("other_id"), F.col("name").alias("other_name"), F.col("path").alias("other_path"))
    return own.join(links.join(others, "other_id"), "symbol_id", "left").select("symbol_id", "path", "edge_kind", "other_name", "other_path")


# Kinds and words of a scope of which dependents are shown.
SHOWN_KINDS = ("function", "class", "interface", "type", "enum", "struct", "trait", "module")
SHOWN_SCOPES = ("export", "public", "default")


def shown(symbols: DataFrame) -> DataFrame:
    """Symbols (kind, scope, ...) whose dependents are shown: of a listed kind, in a scope that says they are visible; case aside."""
    scope = F.lower("scope")
    visible = reduce(Column.__or__, (scope.contains(w) for w in SHOWN_SCOPES))
    return symbols.where(F.lower("kind").isin(*SHOWN_KINDS) & visible)


def dependents_per_symbol(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols with the number of edges into them, 0 included."""
    into = edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.where("is_exported").join(into, "symbol_id", "left").select("symbol_id", "path", "name", F.coalesce("n", F.lit(0)).alias("dependents"))


def without_repo(symbols: DataFrame, edges: DataFrame, alias: str) -> DataFrame:
    """The edges between symbols that are not of this repository (ids that are in neither table stay)."""
    gone = symbols.where(alias_of(F.col("path")) == alias).select("symbol_id")
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("symbol_id", end), end, "left_anti")
    return edges.select("from_id", "to_id", "kind")
