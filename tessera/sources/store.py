"""Index snapshots in plain Parquet: each commit writes the tables that changed, then a new pointer to all of them.

Tables: repos, files, symbols, deps, edges. Readers follow the newest pointer, so they see a whole snapshot; the one before
stays readable until the next commit. Writers are serialised by the caller; a second one fails. Logs grow beside them.
"""

from __future__ import annotations

import json
import uuid
import warnings

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from tessera.functions.text import relative_of
from tessera.operators.catalog import top_directories
from tessera.operators.dependencies import extract_dependencies
from tessera.operators.resolve import resolve
from tessera.operators.search import tfidf_postings
from tessera.scratch import discard, materialise, remove
from tessera.session import ship
from tessera.sources.code import code_symbols
from tessera.sources.documents import document_symbols, document_text
from tessera.sources.walk import change_set

SCHEMAS = {
    "repos": "alias string, root_path string",
    "files": "path string, repo string, hash string, language string, last_indexed timestamp, char_count long, text string",
    "symbols": "symbol_id long, path string, name string, kind string, line int, col int, scope string, is_exported boolean, signature string",
    "deps": "path string, to_name string, kind string, line int",
    "edges": "from_id long, to_id long, kind string",
    "weights": "path string, term string, weight double, norm double",
}
#: Append-only tables.
LOGS = {
    "searches": "id long, task string, pivots array<string>, tokens_sent long, tokens_saved long",
    "usage": "ts timestamp, tool string, tokens_sent long, tokens_saved long",
}
#: Languages whose text is inside an archive or a container.
PACKED = ("docx", "pptx", "xlsx", "pdf")
MAX_SYMBOLS, WARN_FILES = 200_000, 2000


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content binary); ids are hashes of place and name, stable over re-indexing."""
    names = ["path", "name", "kind", "line", "col", "scope", "is_exported", "signature"]

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, data in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                found = document_symbols(language, data)
                if found is not None:
                    rows += [(path, n, k, line, col, None, True, s) for n, k, line, col, s in found]
                    continue
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                rows += [(path, n, k, line, col, scope, public, s) for n, k, line, col, _, _, scope, public, s in code_symbols(language, text)]
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = files.select("path", "language", "content").mapInArrow(
        run, "path string, name string, kind string, line int, col int, scope string, is_exported boolean, signature string"
    )
    ordinal = F.row_number().over(Window.partitionBy("path", "line", "col", "name", "kind").orderBy("scope"))
    return found.withColumn("_n", ordinal).select(F.xxhash64("path", "line", "col", "name", "kind", "_n").alias("symbol_id"), *names)


def with_text(files: DataFrame) -> DataFrame:
    """`files` (language, content, ...) with text: what archives and PDF hold, UTF-8 decoded, else null."""
    packed = files.where(F.col("language").isin(*PACKED))
    plain = files.where(~F.col("language").isin(*PACKED) | F.col("language").isNull())
    raw = F.col("content").cast("string")
    plain = plain.withColumn("text", F.when(F.is_valid_utf8(raw) & (F.coalesce("language", F.lit("")) != "parquet"), raw))

    def run(batches):
        for batch in batches:
            found = [document_text(la, data or b"") for la, data in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "text"])

    return plain.unionByName(packed.mapInArrow(run, packed.withColumn("text", F.lit("")).schema))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshots(self) -> list[int]:
        """Numbers of the pointers that are there, in order."""
        fs, folder = self._files(), self._path("snapshots")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self, number: int | None = None) -> dict[str, str]:
        """Folder of each table in a snapshot, by default the newest."""
        number = number or next(reversed(self._snapshots()), None)
        if number is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/snapshots/{number:012d}").first()[0])

    def table(self, name: str) -> DataFrame:
        folder = self._folders().get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}")

    def holds(self, name: str) -> bool:
        """Whether the newest snapshot has this table; one that an earlier version wrote may lack some."""
        return name in self._folders()

    def commit(self, **tables: DataFrame) -> None:
        """Write the given tables and point to them and to the unchanged others.

        A pointer is a file of its own, written aside and renamed, so a reader sees it whole or not at all. Tables that the
        newest two snapshots do without are removed: readers of the one before keep theirs.
        """
        folders = self._folders()
        for name, df in tables.items():
            folders[name] = f"tables/{name}-{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
            df.select(*columns).write.parquet(f"{self.root}/{folders[name]}")
        fs, old = self._files(), self._snapshots()
        number, aside = (old[-1] if old else 0) + 1, self._path(f"snapshots/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if fs.exists(self._path(f"snapshots/{number:012d}")) or not fs.rename(aside, self._path(f"snapshots/{number:012d}")):
            raise RuntimeError(f"another writer has made snapshot {number}")
        kept = {f for n in [*old[-1:], number] for f in self._folders(n).values()}
        for n in old[:-1]:
            for folder in set(self._folders(n).values()) - kept:
                remove(self.spark, f"{self.root}/{folder}")
            remove(self.spark, f"{self.root}/snapshots/{n:012d}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Append to a log (searches, usage). Logs are no part of snapshots and only grow; their readers choose what counts."""
        columns = self.spark.createDataFrame([], LOGS[name]).columns
        rows.select(*columns).write.mode("append").parquet(f"{self.root}/logs/{name}")

    def log(self, name: str) -> DataFrame:
        if not self._files().exists(self._path(f"logs/{name}")):
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).parquet(f"{self.root}/logs/{name}")

    def add_repo(self, alias: str, root_path: str) -> None:
        """Insert or move a repository; the alias is the key."""
        new = self.spark.createDataFrame([(alias, root_path)], SCHEMAS["repos"])
        self.commit(repos=self.table("repos").where(F.col("alias") != alias).unionByName(new))

    def _apply(self, gone: DataFrame, scanned: DataFrame | None) -> None:
        """Replace the files of `gone` (path) by those of `scanned`, and rebuild every edge that this can touch."""
        files, symbols, deps = (self.table(n).join(gone, "path", "left_anti") for n in ("files", "symbols", "deps"))
        if scanned is not None:
            stored = with_text(scanned).where(F.col("text").isNotNull() | F.col("language").isin(*PACKED, "parquet"))
            rows = stored.select(
                "path", F.substring_index("path", "/", 1).alias("repo"), "hash", "language", F.current_timestamp().alias("last_indexed"),
                F.octet_length("content").cast("long").alias("char_count"), "text",
            )
            files = files.unionByName(rows)
            symbols = symbols.unionByName(extract_symbols(stored))
            deps = deps.unionByName(extract_dependencies(rows.where("text is not null")).withColumn("line", F.col("line").cast("int")))
        # Names decide which edges exist, so edges are resolved anew from the stored dependencies.
        symbols, deps = materialise(symbols), materialise(deps)
        self.commit(files=files, symbols=symbols, deps=deps, edges=resolve(deps, symbols), weights=tfidf_postings(symbols))
        discard(symbols)
        discard(deps)
        if self.over_limit():
            warnings.warn(f"the index holds more than {MAX_SYMBOLS} symbols", stacklevel=3)

    def index(self, scanned: DataFrame, repo: str) -> DataFrame:
        """Bring a repository up to date with a scan of it; returns (path, change)."""
        if scanned.count() > WARN_FILES:
            warnings.warn(f"{repo} has more than {WARN_FILES} files; the largest folders: {top_directories(scanned.select(relative_of(F.col('path')).alias('path'))).collect()}", stacklevel=2)
        changes = materialise(change_set(self.table("files").where(F.col("repo") == repo), scanned))
        touched = changes.where("change <> 'unchanged'").select("path")
        if not touched.isEmpty():
            self._apply(touched, scanned.join(changes.where("change in ('new', 'changed')").select("path"), "path", "left_semi"))
        return changes

    def index_file(self, scanned: DataFrame) -> None:
        self._apply(scanned.select("path"), scanned)

    def remove_files(self, paths: list[str]) -> None:
        self._apply(self.spark.createDataFrame([(p,) for p in paths], "path string"), None)

    def remove_repo(self, alias: str) -> None:
        gone = self.table("files").where(F.col("repo") == alias).select("path")
        self._apply(gone, None)
        self.commit(repos=self.table("repos").where(F.col("alias") != alias))

    def clear(self) -> None:
        """Without files and what comes from them; repositories stay."""
        self.commit(**{n: self.spark.createDataFrame([], SCHEMAS[n]) for n in ("files", "symbols", "deps", "edges", "weights")})

    def over_limit(self, limit: int = MAX_SYMBOLS) -> bool:
        return self.table("symbols").count() > limit
