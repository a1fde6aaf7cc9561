"""The requests that a client makes, over a stored index. Each returns DataFrames; nothing is collected here but names."""

from __future__ import annotations

import time

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import noise_keywords
from tessera.operators import catalog, compress, graph, history, relevance, search
from tessera.plans.batch import Answers, ranked_contexts
from tessera.plans.context import Answer, Index, run_pipeline
from tessera.sources import walk
from tessera.sources.overlay import Overlay
from tessera.sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: relevance.Config = relevance.Config()):
        self.spark, self.store, self.config = spark, Store(spark, root), config
        self.search_log = Overlay(spark, f"{root}/logs/search_log", history.SEARCH_COLUMNS)
        self.calls = Overlay(spark, f"{root}/logs/calls", history.CALL_COLUMNS)

    # ---- maintenance

    def add_repo(self, alias: str, root_path: str, **walk_options) -> DataFrame:
        """Register a repository, index it, and return (path, change)."""
        self.store.add_repo(alias, root_path)
        return self.reindex(alias, **walk_options)

    def reindex(self, alias: str, **walk_options) -> DataFrame:
        root = self.store.table("repos").where(F.col("alias") == alias).first().root_path
        changes = self.store.index(walk.scan(self.spark, root, alias, **walk_options), alias)
        self._outdate(changes.where("change <> 'unchanged'").select("path"))
        return changes

    def _outdate(self, paths: DataFrame) -> None:
        """Recorded calls that list one of these files are stale."""
        self.calls.change(paths, time.time_ns() // 1000)

    def reindex_all(self) -> None:
        """Clear the index and build every registered repository anew."""
        self.store.clear()
        for row in self.store.table("repos").collect():
            self.reindex(row.alias)

    def index_file(self, alias: str, relative: str) -> bool:
        """Index one file; False if it is hidden, skipped or gone."""
        relative = walk.safe_relative(relative)
        root = self.store.table("repos").where(F.col("alias") == alias).first().root_path
        listed = walk.list_one(root, relative)
        if not listed:
            return False
        self.store.index_file(walk.read_files(self.spark, root, alias, listed))
        self._outdate(self.spark.createDataFrame([(f"{alias}/{relative}",)], "path string"))
        return True

    def remove_file(self, alias: str, relative: str) -> None:
        path = f"{alias}/{walk.safe_relative(relative)}"
        self.store.remove_files([path])
        self._outdate(self.spark.createDataFrame([(path,)], "path string"))

    def remove_repo(self, alias: str) -> None:
        self.store.remove_repo(alias)

    # ---- requests

    def index(self) -> Index:
        weights = self.store.table("weights") if self.store.holds("weights") else None
        return Index(self.store.table("files"), self.store.table("symbols"), self.store.table("edges"), weights)

    def context(self, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
        return search.context(self.store.table("symbols"), query, limit, kind)

    def pipeline(self, task: str, **options) -> Answer:
        """Ranked files for a task; names of repositories are noise, files that differ from the last commit are boosted."""
        repos = self.store.table("repos").collect()
        changed = [f"{r.alias}/{p}" for r in repos for p in walk.uncommitted(r.root_path)]
        noise = noise_keywords([r.alias for r in repos], list(self.config.noise_keywords))
        answer = run_pipeline(self.index(), task, **{"config": self.config, "diff": changed, "noise": noise, **options})
        self._record(task, answer)
        return answer

    def contexts(self, tasks: DataFrame, **options) -> Answers:
        """Ranked files for every row of `tasks` (request, task), in one run. Nothing is recorded."""
        noise = noise_keywords([r.alias for r in self.store.table("repos").collect()], list(self.config.noise_keywords))
        return ranked_contexts(self.index(), tasks, **{"config": self.config, "noise": noise, **options})

    def _record(self, task: str, answer: Answer) -> None:
        """Append the search with its best files, and its tokens, to the store's logs."""
        now = time.time_ns() // 1000
        best = answer.pivots.agg(history.top_pivots(F.collect_list(F.struct("score", "path"))).alias("pivots"))  # max_pivots rows
        sent = answer.summary.select(F.col("total_tokens").cast("long").alias("tokens_sent"), F.greatest(F.col("workspace_tokens") - F.col("total_tokens"), F.lit(0)).cast("long").alias("tokens_saved"))
        row = best.crossJoin(sent).withColumns({"id": F.lit(now), "task": F.lit(task), "ts": F.current_timestamp(), "tool": F.lit("pipeline")})
        self.search_log.append(row)
        self._tidy(self.search_log, history.KEPT_SEARCHES)
        self.store.append("usage", row)

    def _tidy(self, log: Overlay, keep: int) -> None:
        """Prune a log that has grown to twice what is kept, and fold it."""
        if log.stored().first().base > 2 * keep:
            log.prune(keep)
            log.compact()

    def session_log(self, query: str, outcome: str, symbols: list[str] = (), files: list[str] = (), tokens: int = 0) -> None:
        """Record a call of the session; it becomes stale when one of its files changes."""
        row = [(time.time_ns() // 1000, query, outcome, list(symbols), list(files), tokens, False, time.time_ns() // 1_000_000)]
        self.calls.append(self.spark.createDataFrame(row, f"id long, {history.CALL_COLUMNS}"))

    def session_calls(self, needle: str | None = None, limit: int = history.RECALL_LIMIT) -> DataFrame:
        """Newest recorded calls, with their marks."""
        return history.recall(self.calls.read(), needle, limit)

    def searches(self, limit: int = history.DEFAULT_SEARCHES) -> DataFrame:
        """The newest searches of the log, of which the newest 500 count."""
        return history.newest(self.search_log.read(), limit)

    def usage(self) -> DataFrame:
        return history.token_usage(self.store.log("usage"))

    def impact(self, symbol_id: int, max_depth: int = 0) -> tuple[DataFrame, DataFrame]:
        affected = graph.impact(self.store.table("symbols"), self.store.table("edges"), symbol_id, max_depth)
        return affected, graph.impact_summary(affected)

    def dependencies(self, name: str, direction: str = "out") -> DataFrame:
        return graph.dependencies(self.store.table("symbols"), self.store.table("edges"), name, direction)

    def symbol(self, name: str, path: str | None = None) -> DataFrame:
        """Source of the symbols of a name."""
        files = self.store.table("files")
        files = files if path is None else files.where(F.col("path") == path)
        return catalog.symbol_slices(self.store.table("symbols"), files, name)

    def files(self) -> DataFrame:
        return catalog.list_files(self.store.table("files"), self.store.table("symbols"))

    def file_summary(self, path: str) -> DataFrame:
        return catalog.file_symbols(self.store.table("symbols"), path)

    def overview(self) -> dict[str, DataFrame]:
        files, symbols, edges = (self.store.table(t) for t in ("files", "symbols", "edges"))
        return {
            "counts": catalog.index_counts(files, symbols, edges),
            "languages": catalog.language_histogram(files),
            "top_files": catalog.top_files(symbols),
            "directories": catalog.top_directories(files),
            "repos": catalog.repo_stats(self.store.table("repos"), files, symbols),
            "tokens": catalog.workspace_tokens(files),
        }

    def diff_context(self, alias: str, base: str = "HEAD~1") -> DataFrame:
        """(path, symbol, line) of files changed since a reference; files that are not indexed keep one row with nulls."""
        root = self.store.table("repos").where(F.col("alias") == alias).first().root_path
        changed = self.spark.createDataFrame([(f"{alias}/{p}",) for p in walk.changed_since(root, base)], "path string")
        return changed.join(self.store.table("symbols").select("path", F.col("name").alias("symbol"), "line"), "path", "left")

    def compress_file(self, path: str, level: int) -> DataFrame:
        return compress.compression_stats(self.store.table("files").where(F.col("path") == path), level)

    def recall(self, sessions: str | None = None, log: str | None = None, needle: str | None = None, limit: int = history.RECALL_LIMIT) -> DataFrame:
        """Newest calls of a session document and of logs together."""
        parts = [history.read_sessions(self.spark, sessions)] if sessions else []
        parts += [history.read_log(self.spark, log)] if log else []
        calls = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return history.recall(calls, needle, limit)
