"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage like a checkpoint and survives the loss of executors; it is columnar, so later passes
read only the columns they name. The folder is the session's spark.checkpoint.dir. Only where that is unset (tests, a
laptop) and the master is local, a temporary folder of this machine is chosen and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and return a DataFrame that reads it back."""
    return reread(df.sparkSession, write(df, codec), df)


def write(df: DataFrame, codec: str = "zstd") -> str:
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    made(spark, path)
    df.write.option("compression", codec).parquet(path)
    return path


def made(spark: SparkSession, path: str) -> None:
    """Have a folder removed at the end of the process."""
    _made.append((spark, path))


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with two columns that tell every row from all others, repeated rows too, and their names.

    They are a row's file and place in it, so a lost task finds them again; what is not a plain scan, or some columns of
    one, is written first. Their names clash with no column of `df`, and a column named `_metadata` does not hide them.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter") and plan.children().size() == 1:
        plan = plan.children().head()
    if not (plan.children().isEmpty() and df.inputFiles()):
        df = materialise(df)
    names = [f"_row_{part}_{len(''.join(df.columns))}" for part in ("file", "place")]
    place = df.metadataColumn("_metadata")
    own = [F.xxhash64(place.getField("file_path")).alias(names[0]), place.getField("row_index").alias(names[1])]
    return df.select("*", *own), names


def without_rows(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `df`, less its `keys`, whose keys are not among `dropped`, a narrow table: Spark broadcasts it if it is small."""
    return df.join(materialise(dropped.select(*keys)), keys, "left_anti").drop(*keys)


def discard(df: DataFrame | None) -> None:
    """Remove a table that `materialise` returned and that nothing reads any more."""
    if df is not None:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera-" in path:
                remove(df.sparkSession, path)


@contextmanager
def quiet_shuffles(spark: SparkSession, partitions: int):
    """Use `partitions` shuffle partitions for the jobs that run inside, for tables of known small size."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Remove the shuffle files of each job that runs inside as soon as it ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
            return
