"""From raw dependencies (file, name, line) to edges between symbols."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tessera.operators.graph import edge_set


def enclosing(deps: DataFrame, symbols: DataFrame, key: str = "path", line: str = "line") -> DataFrame:
    """Adds from_id: the symbol of the same file with the greatest line not after the dependency's; of several on that line
    the first by (col, symbol_id). Dependencies before any symbol are dropped.

    An as-of join without a range join: both sides are sorted together by file and line, and the last symbol seen is
    carried forward. One shuffle by file, no pairs of rows.
    """
    columns = deps.columns
    first = symbols.groupBy(key, F.col(line).alias("_at")).agg(F.min(F.struct("col", "symbol_id")).alias("s"))
    marks = first.select(F.col(key), F.col("_at"), F.lit(0).alias("_tag"), F.col("s.symbol_id").alias("_symbol"), F.lit(None).cast(deps.select(F.struct(*columns).alias("d")).schema["d"].dataType).alias("_dep"))
    rows = deps.select(F.col(key), F.col(line).alias("_at"), F.lit(1).alias("_tag"), F.lit(None).cast(symbols.schema["symbol_id"].dataType).alias("_symbol"), F.struct(*columns).alias("_dep"))
    seen = F.last("_symbol", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(rows).withColumn("from_id", seen).where("_tag = 1 and from_id is not null").select("_dep.*", "from_id")


def _calls(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dependencies with from_id as of `enclosing`, and what their own file has of the name: _first and _second, the two
    first symbols by (line, col, symbol_id); n_own and x_own, how many there are and are exported; n_ids and x_ids, the
    exclusive or of their ids.

    Symbols and dependencies are shuffled together by file, once, and sorted there by line, then by name with symbols first.
    """
    types = {"col": symbols.schema["col"].dataType, "symbol_id": symbols.schema["symbol_id"].dataType, "is_exported": "boolean", "kind": deps.schema["kind"].dataType}
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in types.items()}
    marks = symbols.select("path", F.col("name").alias("to_name"), "line", F.lit(0).alias("_tag"), "col", "symbol_id", "is_exported", nothing["kind"])
    rows = deps.where("path is not null").select("path", "to_name", "line", F.lit(1).alias("_tag"), nothing["col"], nothing["symbol_id"], nothing["is_exported"], "kind")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    # Of symbols on one line the first comes last, so that it is the one carried on.
    lines = Window.partitionBy("path").orderBy("line", "_tag", F.desc("col"), F.desc("symbol_id")).rowsBetween(*so_far)
    names = Window.partitionBy("path", "to_name").orderBy("_tag", "line", "col", "symbol_id").rowsBetween(*so_far)
    exported = F.when(F.col("is_exported"), F.col("symbol_id"))
    both = marks.unionByName(rows).withColumn("from_id", F.last("symbol_id", ignorenulls=True).over(lines))
    both = both.withColumns({
        "_first": F.first("symbol_id", ignorenulls=True).over(names),
        "n_own": F.count("symbol_id").over(names), "x_own": F.count(exported).over(names),
        "n_ids": F.bit_xor("symbol_id").over(names), "x_ids": F.bit_xor(exported).over(names),
    })
    other = F.when(F.col("symbol_id") != F.col("_first"), F.col("symbol_id"))
    both = both.withColumn("_second", F.first(other, ignorenulls=True).over(names))
    return both.where("_tag = 1 and from_id is not null").drop("line", "_tag", "col", "symbol_id", "is_exported")


def resolved(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct edges (path, to_name, from_id, to_id, kind) of dependencies (path, to_name, kind, line): `resolve` with the
    caller's file and the name called.

    Per name there is one row of totals. What other files have is the total less the file's own; where that is one symbol,
    the exclusive or of the two has its id, so no list of files is kept and a name used everywhere costs a row per task.
    """
    symbols = symbols.where("path is not null")
    exported = F.when(F.col("is_exported"), F.col("symbol_id"))
    overall = symbols.groupBy(F.col("name").alias("to_name")).agg(
        F.count("symbol_id").alias("n_all"), F.count(exported).alias("x_all"), F.bit_xor("symbol_id").alias("n_all_ids"), F.bit_xor(exported).alias("x_all_ids")
    )
    joined = _calls(deps, symbols).where("to_name is not null").join(overall, "to_name", "left")
    near = F.coalesce(*(F.when(F.col(c) != F.col("from_id"), F.col(c)) for c in ("_first", "_second")))
    x_else, n_else = F.col("x_all") - F.col("x_own"), F.col("n_all") - F.col("n_own")

    def other(ids: str):
        own = F.coalesce(ids, F.lit(0).cast(symbols.schema["symbol_id"].dataType))
        return F.col(f"{ids[0]}_all_ids").bitwiseXOR(own)

    far = F.when(x_else == 1, other("x_ids")).when((x_else == 0) & (n_else == 1), other("n_ids"))
    edges = joined.select("path", "to_name", "from_id", F.coalesce(near, far).alias("to_id"), "kind")
    return edges.where("from_id <> to_id").distinct()


def resolve(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, kind) of dependencies (path, to_name, kind, line).

    The target is a symbol of that name in the same file other than the caller (first by line, col, symbol_id); else, in
    other files, the only exported one, or the only one at all if none is exported; otherwise there is no edge.
    """
    return edge_set(resolved(deps, symbols).select("from_id", "to_id", "kind"))


def resolve_same_file(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges within files only."""
    calls = enclosing(deps, symbols)
    target = symbols.groupBy("path", F.col("name").alias("to_name")).agg(F.min(F.struct("line", "col", "symbol_id")).alias("t"))
    return edge_set(calls.join(target, ["path", "to_name"]).select("from_id", F.col("t.symbol_id").alias("to_id"), "kind"))


def replace_outbound(edges: DataFrame, symbols: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with those that leave a changed file (path) replaced by fresh ones."""
    gone = symbols.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("symbol_id").alias("from_id"))
    return edge_set(edges.join(gone, "from_id", "left_anti").unionByName(fresh))
