"""Symbols, dependencies and edges kept up to date at the cost of what changed.

Five Parquet tables, each in hash partitions, written with dynamic partition overwrite:

    symbols, deps, edges   by the file that holds them (for an edge, the caller's)
    definitions            by name: which files define it
    uses                   by name: which files depend on it

A change of some files rewrites their partitions, finds the names that they gained or lost, and resolves again only what
depends on these: all of the changed files, and of the files that use such a name that name alone. `symbols` is written
last and everything follows from what it held before, so an update that was cut off is repeated by calling it again.
A partition that runs empty is overwritten by one row of nulls, which readers leave out.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from tessera.operators.resolve import resolved
from tessera.scratch import materialise

BUCKETS = 64
PLACE = "symbol_id long, path string, line int, col int, is_exported boolean"
SCHEMAS = {
    "symbols": f"name string, {PLACE}",
    "deps": "path string, to_name string, kind string, line int",
    "edges": "path string, to_name string, from_id long, to_id long, kind string",
    "definitions": f"name string, {PLACE}",
    "uses": "to_name string, path string",
}
#: Column that a table is partitioned by.
KEYS = {"symbols": "path", "deps": "path", "edges": "path", "definitions": "name", "uses": "to_name"}


def bucket_of(key: str, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("bucket")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(f"{root}/{name}").where(F.col(KEYS[name]).isNotNull())


def _buckets(df: DataFrame, key: str, buckets: int) -> list[int]:
    """The partitions that hold the keys of `df`: numbers, as many as there are partitions at most."""
    return [r.bucket for r in df.select(bucket_of(key, buckets)).distinct().collect()]


def _put(df: DataFrame, root: str, name: str, touched: list[int]) -> None:
    spark, schema = df.sparkSession, f"{SCHEMAS[name]}, bucket int"
    columns = spark.createDataFrame([], schema).columns
    nulls = spark.createDataFrame([(n,) for n in touched], "bucket int").select(*(F.lit(None).alias(c) for c in columns[:-1]), "bucket")
    rows = df.select(*columns).unionByName(nulls)  # it may read the partitions that it replaces: they go when all tasks are done
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")


def update(spark: SparkSession, root: str, paths: DataFrame, symbols: DataFrame, deps: DataFrame, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the tables under `root` up to date and return the number of partitions written of each.

    `paths` (path) names the files that are new, have changed or are gone; `symbols` (name, symbol_id, path, line, col,
    is_exported) and `deps` (path, to_name, kind, line) are what those files hold now; rows of other files are not taken.
    A first update with all files makes the tables. `buckets` stays the same for a root. The result is that of `resolve` over everything.
    Names and paths that changed are tables; only numbers of partitions come to the driver.
    """
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], f"{schema}, bucket int").write.mode("ignore").partitionBy("bucket").parquet(f"{root}/{name}")
    before = {name: table(spark, root, name) for name in SCHEMAS}  # listed once; each is read before it is written
    paths = materialise(paths.select("path"))
    own = _buckets(paths, "path", buckets)
    new = materialise(symbols.join(paths, "path", "left_semi").select("name", *(c.split()[0] for c in PLACE.split(", "))))
    new_deps = materialise(deps.join(paths, "path", "left_semi").select("path", "to_name", "kind", F.col("line").cast("int").alias("line")))
    new_uses = new_deps.select("to_name", "path").distinct()
    if all(df.isEmpty() for df in before.values()):  # there is nothing to compare with, to keep or to resolve again
        moved, used = _buckets(new, "name", buckets), _buckets(new_deps, "to_name", buckets)
        return _write(root, buckets, {
            "edges": (resolved(new_deps, _once(new)), own), "definitions": (new, moved), "uses": (new_uses, used), "deps": (new_deps, own), "symbols": (new, own),
        })

    def stored(name: str, some: list[int]) -> DataFrame:
        return before[name].where(F.col("bucket").isin(some)).drop("bucket")

    old = stored("symbols", own).join(paths, "path", "left_semi").select(*new.columns)
    old_uses = stored("deps", own).join(paths, "path", "left_semi").select("to_name", "path").distinct()
    names = materialise(_differ(old, new).select("name").distinct())
    moved = _buckets(names, "name", buckets)
    used = _buckets(_differ(old_uses, new_uses), "to_name", buckets)
    users = stored("uses", moved).join(names.withColumnRenamed("name", "to_name"), "to_name", "left_semi").select("path").distinct()
    users = materialise(users.join(paths, "path", "left_anti"))
    theirs = _buckets(users, "path", buckets)

    # What is to be resolved, and the symbols that this takes: all of the callers' files, and all with a name that is called.
    again = stored("deps", theirs).join(users, "path", "left_semi").join(names.withColumnRenamed("name", "to_name"), "to_name", "left_semi")
    again = materialise(new_deps.unionByName(again))
    called = materialise(again.select(F.col("to_name").alias("name")).distinct())
    elsewhere = stored("definitions", _buckets(called, "name", buckets)).join(called, "name", "left_semi").join(paths, "path", "left_anti")
    callers = stored("symbols", theirs).join(users, "path", "left_semi")
    known = _once(materialise(new.unionByName(callers.select(*new.columns)).unionByName(elsewhere.select(*new.columns))))

    def kept(name: str, some: list[int]) -> DataFrame:
        return stored(name, some).join(paths, "path", "left_anti")

    touched = sorted({*own, *theirs})
    stay = kept("edges", touched).join(users.withColumn("_user", F.lit(True)), "path", "left").join(names.select(F.col("name").alias("to_name"), F.lit(True).alias("_moved")), "to_name", "left")
    stay = stay.where("_user is null or _moved is null").drop("_user", "_moved")
    return _write(root, buckets, {
        "edges": (stay.unionByName(resolved(again, known)), touched),
        "definitions": (kept("definitions", moved).unionByName(new), moved),
        "uses": (kept("uses", used).unionByName(new_uses), used),
        "deps": (kept("deps", own).unionByName(new_deps), own),
        "symbols": (kept("symbols", own).unionByName(new), own),
    })


def _write(root: str, buckets: int, tables: dict[str, tuple[DataFrame, list[int]]]) -> dict[str, int]:
    """Replace partitions of each table, in this order, by the rows that fall in them; returns how many there are of each."""
    for name, (rows, some) in tables.items():
        _put(rows.withColumn("bucket", bucket_of(KEYS[name], buckets)).where(F.col("bucket").isin(some)), root, name, some)
    return {name: len(some) for name, (_, some) in tables.items()}


def _once(symbols: DataFrame) -> DataFrame:
    """One row for each symbol_id. A pass over the ids alone tells whether any is there twice."""
    twice = symbols.groupBy("symbol_id").count().where("count > 1")
    return symbols if twice.isEmpty() else materialise(symbols.dropDuplicates(["symbol_id"]))


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has and the other has not."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.bit_or("_n").alias("_n")).where("_n < 3").drop("_n")
