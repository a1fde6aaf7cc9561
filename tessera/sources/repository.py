"""A repository as a Spark data source: `spark.read.format("repository").option("root", ...).option("alias", ...).load()`.

The driver lists the folders of the first levels only; everything below, and all contents, are listed and read by the tasks,
one for each such folder, so the root is a path that the driver and all executors see. A filter on `path`, equality or a prefix, leaves the folders that can hold it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from tessera.functions.text import language_of, relative_of
from tessera.session import ship
from tessera.sources.walk import MAX_FILE_BYTES, list_files

SCHEMA = "path string, repo string, size long, modified long, content binary"
#: Files and bytes of contents that a task holds at a time, at most; a larger file is alone.
BATCH, BATCH_BYTES = 64, 8 << 20


@dataclass
class Folder(InputPartition):
    """A folder of the repository, with what is below it or not."""

    path: str
    whole: bool


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.alias = re.sub("^file:/+", "/", options["root"]), options["alias"]
        self.walk = {
            "exclude": tuple(x for x in options.get("exclude", "").split(",") if x),
            "ignore_file": options.get("ignorefile"),
            "max_bytes": int(options.get("maxbytes", MAX_FILE_BYTES)),
        }
        self.levels, self.contents = int(options.get("levels", 1)), options.get("contents", "true").lower() != "false"
        self.prefix, self.one = "", None

    def pushFilters(self, filters) -> Iterator:
        """Filters on path narrow the listing. Spark applies all of them to the rows as well."""
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("path",):
                value = str(f.value)
                if isinstance(f, EqualTo):
                    self.one = value
                self.prefix = max(self.prefix, value, key=len)
            yield f

    def _relative(self) -> str | None:
        """The prefix that paths in the repository have; None if no path of this alias can have it."""
        own = f"{self.alias}/"
        if self.prefix.startswith(own):
            return self.prefix[len(own) :]
        return "" if own.startswith(self.prefix) and self.one is None else None

    def partitions(self) -> list[Folder]:
        prefix = self._relative()
        if prefix is None:
            return []
        under = prefix.rpartition("/")[0]
        if not os.path.isdir(os.path.join(self.root, under)):
            return []
        if self.one is not None:
            return [Folder(under, False)]
        listed = list_files(self.root, under=under, levels=self.levels, **self.walk)
        below = [p for p, size, _ in listed if size < 0]
        near = sorted({p.rpartition("/")[0] for p, size, _ in listed if size >= 0})
        return [Folder(p, False) for p in near if p == under or f"{p}/".startswith(prefix)] + [Folder(p, True) for p in below if f"{p}/".startswith(prefix)]

    def read(self, partition: Folder | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # Spark's way to say that there are no partitions
            return
        prefix = self._relative()
        found = list_files(self.root, under=partition.path, levels=None if partition.whole else 0, **self.walk)
        found = [f for f in found if f[1] >= 0 and (f[0] == prefix if self.one is not None else f[0].startswith(prefix))]
        for some in self._batches(found):
            columns = [
                pa.array([f"{self.alias}/{p}" for p, *_ in some], pa.string()), pa.array([self.alias] * len(some), pa.string()),
                pa.array([s for _, s, _ in some], pa.int64()), pa.array([t for *_, t in some], pa.int64()),
                pa.array([self._bytes(p) for p, *_ in some], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "repo", "size", "modified", "content"])

    def _batches(self, found: list) -> Iterator[list]:
        some, held = [], 0
        for file in found:
            size = file[1] if self.contents else 0
            if some and (len(some) == BATCH or held + size > BATCH_BYTES):
                yield some
                some, held = [], 0
            some.append(file)
            held += size
        if some:
            yield some

    def _bytes(self, path: str) -> bytes | None:
        if not self.contents:
            return None
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()


class Repository(DataSource):
    """Options: root, alias; exclude (names, comma-separated), ignoreFile, maxBytes; levels (folders that the driver lists, 1);
    contents (false leaves content null)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Repository)


def scan(spark: SparkSession, root: str, alias: str, **options) -> DataFrame:
    """The table of `walk.scan`, listed by the tasks. The root must be a folder that they see."""
    register(spark)
    files = spark.read.format("repository").options(root=root, alias=alias, **options).load()
    return files.select("*", F.sha2("content", 256).alias("hash"), language_of(relative_of(F.col("path"))).alias("language"))
