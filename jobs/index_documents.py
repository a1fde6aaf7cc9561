"""Keep the search index of a growing folder of documents up to date, reading new files only.

    python -m jobs.index_documents --documents PATH --output PATH --checkpoint PATH [--config FILE]

Output, Parquet in partitions bucket=N:

    documents   one row per document: key, doc_id, path, language, sha256, n_bytes, tokens, length, terms, version, buckets
    terms       term, df (documents of the bucket with it), cf (its occurrences): sums over buckets are those of the index

A document is what its doc_id names; the last row of the newest file that has it counts (by time of change, then name, then
place in the file), whatever the order in which files are taken. Without doc_id it is named by its text. Null texts are
empty. `terms` holds the words that ranking needs, so that a search reads this folder and no text again.

The file stream's checkpoint remembers which files were taken. A batch rewrites only the buckets that it touches, documents
first and then terms, from the documents as they lie in their buckets; so a run that is cut off or repeated leaves what one
whole run would have.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import count_tokens, plain_tokens, with_counts
from tessera.scratch import discard, materialise, row_keys, without_rows
from tessera.session import spread

log = logging.getLogger("index_documents")

INPUT = "doc_id long, text string, lang string, source string"
DOCUMENTS = (
    "key string, doc_id long, path string, language string, sha256 string, n_bytes long, tokens long, length int, "
    "terms array<struct<term: string, tf: int>>, version struct<changed: timestamp, file: string, place: long>, buckets int, bucket int"
)
TERMS = "term string, df long, cf long, bucket int"


def forward(files: DataFrame, buckets: int) -> DataFrame:
    """Rows of `documents` for rows of the input with `version`: one narrow pass, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    rows = files.select("doc_id", "lang", "source", "version", text.alias("text"), sha.alias("sha256"), F.sort_array(plain_tokens(text)).alias("words"))
    return with_counts(rows, "words").select(
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("sha256:"), "sha256")).alias("key"), "doc_id",
        F.concat_ws("/", "source", "lang", F.coalesce(F.col("doc_id").cast("string"), "sha256")).alias("path"), F.col("lang").alias("language"), "sha256",
        F.octet_length("text").cast("long").alias("n_bytes"), count_tokens(F.col("text")).cast("long").alias("tokens"), "length",
        "terms", "version", F.lit(buckets).alias("buckets"),
        F.pmod(F.coalesce("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(buckets)).cast("int").alias("bucket"),
    )


def _put(df: DataFrame, folder: str) -> None:
    """Replace the buckets that `df` has, and no others. Rebalancing makes files of even size, several for a large bucket."""
    df.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def _newest(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """The newest row of each document in either table; of several with its version, one.

    Only names of rows are shuffled; the rows themselves, with their words, stay where they are unless very many are old.
    """
    (fresh, place), (stored, _) = row_keys(fresh), row_keys(stored.select(*fresh.columns))  # of the same columns, so of the same names
    rows = fresh.unionByName(stored)
    rank = F.struct("version", *place)
    named = rows.select("bucket", "key", rank.alias("_rank"))
    newest = named.groupBy("bucket", "key").agg(F.max("_rank").alias("_newest"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    old = named.join(newest, ["bucket", "key"]).where("_rank < _newest").select(*(F.col("_rank")[c].alias(c) for c in place))
    return without_rows(rows, old, place)


def _merge(batch: DataFrame, output: str, buckets: int) -> dict[str, int]:
    spark = batch.sparkSession
    fresh = materialise(forward(spread(batch), buckets))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # `buckets` at most

    def stored(table: int) -> DataFrame:
        return read(spark, output)[table].where(F.col("bucket").isin(touched))

    _put(_newest(fresh, stored(0)), f"{output}/documents")  # it reads what it replaces: that goes when all tasks are done
    words = stored(0).select("bucket", F.inline("terms"))
    _put(words.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), f"{output}/terms")
    counts = {"read": fresh.count(), "buckets": len(touched), "written": stored(0).count()}
    discard(fresh)
    return counts


def read(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The tables (documents, terms) of an index."""
    return spark.read.schema(DOCUMENTS).parquet(f"{output}/documents"), spark.read.schema(TERMS).parquet(f"{output}/terms")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, buckets: int = 64, files_per_batch: int = 1000) -> dict[str, int]:
    """Take what is new under `documents` (a folder, a file or a pattern), wait until it is indexed, and return how much was read and written.

    `buckets` is fixed when an index is made. Extra columns of the input are not read; a run without new files does nothing.
    """
    for name, schema in (("documents", DOCUMENTS), ("terms", TERMS)):  # an index that is not there yet is empty
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(f"{output}/{name}")
    made = read(spark, output)[0].select("buckets").first()
    if made and made.buckets != buckets:
        raise ValueError(f"this index has {made.buckets} buckets, not {buckets}")
    total = {"batches": 0, "read": 0, "buckets": 0, "written": 0}

    def take(batch: DataFrame, number: int) -> None:
        counts = _merge(batch, output, buckets)
        log.info("batch %d: read %d documents, wrote %d of %d buckets with %d", number, counts["read"], counts["buckets"], buckets, counts["written"])
        total["batches"] += 1
        for k, n in counts.items():
            total[k] += n

    path = documents.rstrip("/")
    if path[-1].isalnum():  # as a pattern that only it matches, since a stream reads a single file in no other way
        path = f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    where = F.struct(*(F.col(f"_metadata.{c}").alias(n) for c, n in (("file_modification_time", "changed"), ("file_name", "file"), ("row_index", "place"))))
    stream = files.select("*", where.alias("version")).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%s: %d batches, read %d documents of %s, wrote %d", output, total["batches"], total["read"], documents, total["written"])
    return total


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_documents").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.documents, args.output, args.checkpoint, **json.loads(Path(args.config).read_text(encoding="utf-8")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
