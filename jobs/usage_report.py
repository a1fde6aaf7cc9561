"""Report what the tools of a workspace were used for, day by day: calls, files, bursts of work, tokens sent and saved.

    python -m jobs.usage_report --events PATH --output PATH [--since YYYY-MM-DD] [--until YYYY-MM-DD] [--config FILE]

Output, Parquet in partitions day=YYYY-MM-DD, one row per tool: calls, files (distinct ones), bursts (runs of calls of the
tool on one file on that day, at most `gap` apart), longest_burst (its calls), tokens_sent, tokens_saved, efficiency and
cost (of the tokens sent, at the rate of `model`).

Every day is computed from its own events alone, so a run for some days, `since` to `until` inclusive, gives what a run for
all would give, and rewrites only those. Without limits all days are written. A rerun replaces days by the same rows; a day
whose events are all gone is left as it was. Events without a time are reported under the day null in a run without limits.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import dollars, efficiency
from tessera.scratch import discard, materialise
from tessera.session import spread
from tessera.streaming.changes import debounced

log = logging.getLogger("usage_report")

INPUT = "event_id long, ts timestamp, user_id long, event_type string, value double"
REPORT = "tool string, calls long, files long, bursts long, longest_burst long, tokens_sent long, tokens_saved long, efficiency string, cost string, day date"


def report(calls: DataFrame, gap: str = "30 minutes", model: str = "sonnet") -> DataFrame:
    """Rows of the output for calls (ts, tool, path, tokens_sent, tokens_saved); a null tool is one of its own, null tokens are none.

    Sums come from partial aggregates. Files and bursts are counted from one row for each day, tool and file, so no task
    gathers the calls of a busy tool, only those of one file on one day.
    """
    calls = calls.withColumn("day", F.to_date("ts"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_sent", "tokens_saved")]
    each = calls.groupBy("day", "tool", "path").agg(F.count(F.lit(1)).alias("calls"), *sums)
    totals = each.groupBy("day", "tool").agg(F.sum("calls").alias("calls"), F.count("path").alias("files"), *(F.sum(c).alias(c) for c in ("tokens_sent", "tokens_saved")))
    # A burst belongs to a day, a tool and a file, so these three are the path of its events.
    named = calls.select(F.struct("day", "tool", "path").alias("path"), "ts", F.lit("change").alias("op"))
    bursts = debounced(named, gap, late=None).groupBy(F.col("path.day").alias("day"), F.col("path.tool").alias("tool"))
    bursts = bursts.agg(F.count(F.lit(1)).alias("bursts"), F.max("n_events").alias("longest_burst"))
    same = totals["day"].eqNullSafe(bursts["day"]) & totals["tool"].eqNullSafe(bursts["tool"])
    return totals.join(bursts, same, "left").select(
        totals["tool"], "calls", "files", F.coalesce("bursts", F.lit(0)).cast("long").alias("bursts"), F.coalesce("longest_burst", F.lit(0)).cast("long").alias("longest_burst"),
        "tokens_sent", "tokens_saved", efficiency(F.col("tokens_saved"), F.col("tokens_sent")).alias("efficiency"), dollars(F.col("tokens_sent"), model).alias("cost"), totals["day"],
    )


def calls_of(events: DataFrame) -> DataFrame:
    """Events as calls: the tool is the event's type, the file its user's, tokens its value and twice that."""
    sent, saved = F.floor("value").cast("long"), F.floor(F.col("value") * 2).cast("long")
    path = F.concat(F.lit("repo/"), F.col("user_id").cast("string"), F.lit(".rs"))
    return events.select("ts", F.col("event_type").alias("tool"), path.alias("path"), sent.alias("tokens_sent"), saved.alias("tokens_saved"))


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def run(spark: SparkSession, events: str, output: str, since: str | None = None, until: str | None = None, gap: str = "30 minutes", model: str = "sonnet") -> dict[str, int]:
    """Write the days from `since` to `until` and return how much was read and written."""
    rows = spark.read.schema(INPUT).parquet(events)
    if since:  # bounds on ts itself, so that they reach the scan
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    made = materialise(report(calls_of(spread(rows)), gap, model))
    made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(output)
    counts = made.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("read"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("written")).first().asDict()
    discard(made)
    log.info("%s: read %d calls of %s, wrote %d rows of %d days", output, counts["read"], events, counts["written"], counts["days"])
    return counts


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output"):
        p.add_argument(f"--{name}", required=True)
    for name in ("since", "until"):
        p.add_argument(f"--{name}")
    p.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("usage_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.events, args.output, args.since, args.until, **json.loads(Path(args.config).read_text(encoding="utf-8")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
