"""Search history, session calls, recall, stale marks and token usage over append-only tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tessera.functions.text import capped_list, efficiency, minute_text

KEPT_SEARCHES, DEFAULT_SEARCHES, MOST_SEARCHES = 500, 50, 200
RECALL_LIMIT, LIST_CAP, TOP_PIVOTS = 20, 5, 8

CALL_SCHEMA = "query string, request string, outcome string, symbols array<string>, files array<string>, tokens long, stale boolean, timestamp long"
#: Columns of the logs of searches and of a session's calls, besides their ids.
SEARCH_COLUMNS = "task string, pivots array<string>, tokens_sent long, tokens_saved long"
CALL_COLUMNS = "query string, outcome string, symbols array<string>, files array<string>, tokens long, stale boolean, timestamp long"


def retained(history: DataFrame) -> DataFrame:
    """The newest searches by id. A top-k, so only the kept rows meet in one task."""
    return history.orderBy(F.desc("id")).limit(KEPT_SEARCHES)


def newest(history: DataFrame, limit: int = DEFAULT_SEARCHES) -> DataFrame:
    return retained(history).orderBy(F.desc("id")).limit(min(limit, MOST_SEARCHES))


def top_pivots(pivots: Column, most: int = TOP_PIVOTS) -> Column:
    """Paths of the best of array<struct<score, path>>: by falling score, then path."""
    ordered = F.array_sort(F.transform(pivots, lambda p: F.struct((-p["score"]).alias("back"), p["path"].alias("path"))))
    return F.transform(F.slice(ordered, 1, most), lambda p: p["path"])


def recorded(touched: DataFrame) -> DataFrame:
    """(session, symbols, files) of rows (session, symbol, path): sorted, each once."""
    each = [F.sort_array(F.collect_set(c)).alias(n) for c, n in (("symbol", "symbols"), ("path", "files"))]
    return touched.groupBy("session").agg(*each)


def _struct_fields() -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in CALL_SCHEMA.split(", "))


def read_sessions(spark, path: str) -> DataFrame:
    """Calls of a session document (one JSON file) as rows, with the session's id."""
    schema = f"sessions array<struct<id: string, timestamp: bigint, calls: array<struct<{_struct_fields()}>>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    calls = docs.select(F.explode("sessions").alias("s")).select(F.col("s.id").alias("session"), F.explode("s.calls").alias("c"))
    return _normal(calls.select("session", "c.*"))


def read_log(spark, path: str) -> DataFrame:
    """Calls of monthly logs, one JSON object per line; short lines carry only a time, a request and an outcome."""
    return _normal(spark.read.schema(CALL_SCHEMA).json(path).withColumn("session", F.lit(None).cast("string")))


def _normal(calls: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return calls.select(
        "session", F.coalesce("query", "request").alias("query"), "outcome", F.coalesce("symbols", empty).alias("symbols"),
        F.coalesce("files", empty).alias("files"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("stale", F.lit(False)).alias("stale"), "timestamp",
    )


def append_log(calls: DataFrame, folder: str) -> None:
    """Append calls as JSON, one folder per month."""
    month = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM")
    calls.withColumn("month", month).write.mode("append").partitionBy("month").json(folder)


def recall(calls: DataFrame, needle: str | None = None, limit: int = RECALL_LIMIT) -> DataFrame:
    """Newest calls whose query or outcome contains the needle (case aside); the filter comes before the limit."""
    if needle:
        n = needle.lower()
        calls = calls.where(F.lower("query").contains(n) | F.coalesce(F.lower("outcome").contains(n), F.lit(False)))
    shown = calls.orderBy(F.desc("timestamp"), "query").limit(limit)
    return shown.select(
        "query", "outcome", capped_list(F.col("symbols"), LIST_CAP).alias("symbols"), capped_list(F.col("files"), LIST_CAP).alias("files"),
        minute_text(F.col("timestamp")).alias("time"), "stale",
    )


def mark_stale(calls: DataFrame, changed: list[str]) -> DataFrame:
    """stale becomes true for calls that list a changed path; backslashes count as slashes."""
    paths = F.array(*[F.lit(p.replace("\\", "/")) for p in changed]).cast("array<string>")
    listed = F.transform("files", lambda f: F.regexp_replace(f, r"\\", "/"))
    return calls.withColumn("stale", F.col("stale") | F.arrays_overlap(listed, paths))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def merged(calls: DataFrame, changes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Calls (id, ...) as changes (path, before) and cuts (keep_from) beside them say.

    Calls with an id below the greatest cut are left out. If calls have files and stale, those with an id below `before` that list
    the path are stale; a null mark counts as false, a null list as empty, backslashes as slashes. Changes are reduced to the
    latest of each path and meet calls by path, so they may be many; only ids and paths are shuffled for that.
    """
    cut = cuts.agg(F.coalesce(F.max("keep_from"), F.lit(-(2**63))).alias("_from"))
    alive = calls.crossJoin(F.broadcast(cut)).where("id >= _from").drop("_from")  # one row
    if "files" not in calls.columns:
        return alive
    latest = changes.groupBy("path").agg(F.max("before").alias("before"))
    listed = alive.select("id", F.explode("files").alias("path")).select("id", slashes(F.col("path")).alias("path"))
    # Calls may share an id: each is marked only for paths of its own list.
    hit = listed.join(latest, "path").where("id < before").groupBy("id").agg(F.collect_set("path").alias("_changed"))
    own = F.coalesce(F.arrays_overlap(F.transform("files", slashes), "_changed"), F.lit(False))
    return alive.join(hit, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | own).select(*calls.columns)


def token_usage(calls: DataFrame) -> DataFrame:
    """One row over (tokens_sent, tokens_saved): sums, number of queries, efficiency and whole average per query."""
    row = calls.agg(
        F.coalesce(F.sum("tokens_sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("saved"), F.count(F.lit(1)).alias("queries")
    )
    mean: Column = F.coalesce(F.floor(F.col("sent") / F.nullif(F.col("queries"), F.lit(0))), F.lit(0)).cast("long")
    return row.withColumns({"efficiency": efficiency(F.col("saved"), F.col("sent")), "average": mean})


def latest_call(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg(F.max("timestamp").alias("latest"))


def session_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows: session, query, outcome (null without one)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    follows = turns.withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)})
    answer = F.when(F.col("_role") == "assistant", F.col("_text"))
    return follows.where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("query"), answer.alias("outcome"))
