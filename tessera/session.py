"""Session construction and input readers shared by every plan."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on (time zone) or that every plan here assumes (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks. On a cluster, pass your own session to the operators instead."""
    n = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{n}]").appName("tessera").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless they find it by the driver's own import paths."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = {Path(p or ".").resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())}
    if root in paths or getattr(sc, "_tessera_sent", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", root, "tessera"))
    sc._tessera_sent = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, reduced to `columns` when given, so that the scan reads nothing else."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Deal a small unsplittable input over all cores; an input of enough partitions comes back as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df
