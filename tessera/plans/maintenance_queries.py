"""Named queries of tables that are kept up to date by delta, of streams with state, and of the index of names."""

from __future__ import annotations

import time
import uuid

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException

from tessera.operators import history, trigrams
from tessera.plans import adapters
from tessera.plans.registry import query
from tessera.scratch import materialise, shared_dir
from tessera.session import spread, table
from tessera.sources import delta, overlay, repository
from tessera.streaming import stateful

# ---- one changed file of many ---------------------------------------------------------------------------------------

#: One file per part: it defines f<key> and g<size>, calls f<key + 1> and imports another g. In the file of the smallest key,
#: both names then give way to new ones.
_BUCKETS = 16
_REPOSITORY = """
    p AS (SELECT p_partkey AS k, p_size AS s, p_partkey = (SELECT min(p_partkey) FROM part) AS ch FROM part),
    sym AS (SELECT k * 10 + 1 AS id, k, 'f' || k AS name, true AS x FROM p WHERE NOT ch UNION ALL SELECT k * 10 + 2, k, 'g' || s, k % 50 = 7 FROM p WHERE NOT ch
            UNION ALL SELECT k * 10 + 3, k, 'f_new', true FROM p WHERE ch UNION ALL SELECT k * 10 + 4, k, 'g1', true FROM p WHERE ch),
    dep AS (SELECT k, k * 10 + 1 AS from_id, 'f' || (k + 1) AS name, 'function_call' AS kind FROM p WHERE NOT ch
            UNION ALL SELECT k, k * 10 + CASE WHEN ch THEN 4 ELSE 2 END, 'g' || CASE WHEN ch THEN 2 ELSE s % 50 + 1 END, 'import' FROM p)"""


def _updated(spark, sf):
    """The root of an index of all files, after the update by the one that changed, and what that update wrote."""
    part = spread(table(spark, sf, "part", "p_partkey", "p_size"))
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("p/"), key.cast("string"), F.lit(".py")).alias("path")

    def symbol(name, line: int, number: int, public):
        return F.struct(name.alias("name"), (key * 10 + number).alias("symbol_id"), F.lit(line).alias("line"), F.lit(1).alias("col"), public.alias("is_exported"))

    def dependency(name, line: int, kind: str):
        return F.struct(name.alias("to_name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"))

    def g(n):
        return F.concat(F.lit("g"), n.cast("string"))

    f = F.concat(F.lit("f"), key.cast("string"))
    symbols = part.select(path, F.inline(F.array(symbol(f, 1, 1, F.lit(True)), symbol(g(size), 5, 2, key % 50 == 7))))
    deps = part.select(path, F.inline(F.array(dependency(F.concat(F.lit("f"), (key + 1).cast("string")), 2, "function_call"), dependency(g(size % 50 + 1), 6, "import"))))
    root = f"{shared_dir(spark)}/tessera-delta-{uuid.uuid4().hex}"
    delta.update(spark, root, part.select(path), symbols, deps, _BUCKETS)
    first = materialise(part.orderBy("p_partkey").limit(1))
    symbols = first.select(path, F.inline(F.array(symbol(F.lit("f_new"), 1, 3, F.lit(True)), symbol(F.lit("g1"), 5, 4, F.lit(True)))))
    deps = first.select(path, F.inline(F.array(dependency(F.lit("g2"), 6, "import"))))
    return root, delta.update(spark, root, first.select(path), symbols, deps, _BUCKETS)


@query(
    "delta_edges",
    f"""WITH {_REPOSITORY}, n AS (SELECT name, count(*) AS n, count(*) FILTER (x) AS nx, min(id) FILTER (x) AS xid, min(id) AS aid FROM sym GROUP BY name)
        SELECT 'p/' || k || '.py' AS path, name AS to_name, from_id, CASE WHEN nx = 1 THEN xid ELSE aid END AS to_id, kind FROM dep JOIN n USING (name) WHERE nx = 1 OR (nx = 0 AND n = 1)""",
)
def delta_edges(spark, sf):
    """All edges after a change of one file, kept up to date by delta; the SQL resolves everything anew."""
    return delta.table(spark, _updated(spark, sf)[0], "edges").drop("bucket")


@query(
    "delta_partitions",
    f"""WITH {_REPOSITORY}, one AS (SELECT k, s FROM p WHERE ch),
        names AS (SELECT unnest(['f' || k, 'g' || s, 'f_new', 'g1']) AS name FROM one),
        was AS (SELECT unnest(['f' || (k + 1), 'g' || (s % 50 + 1)]) AS name FROM one),
        used AS (SELECT name FROM was WHERE name <> 'g2' UNION SELECT 'g2' WHERE NOT EXISTS (SELECT 1 FROM was WHERE name = 'g2')),
        files AS (SELECT k FROM one UNION SELECT k FROM dep WHERE name IN (SELECT name FROM names)),
        b AS (SELECT 'definitions' AS name, name AS key FROM names UNION ALL SELECT 'uses', name FROM used UNION ALL SELECT 'edges', 'p/' || k || '.py' FROM files
              UNION ALL SELECT unnest(['deps', 'symbols']), 'p/' || k || '.py' FROM one)
        SELECT name, count(DISTINCT CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {_BUCKETS}) AS written FROM b GROUP BY name""",
)
def delta_partitions(spark, sf):
    """Partitions, of 16 a table, that the change of one file had written anew."""
    return spark.createDataFrame(list(_updated(spark, sf)[1].items()), "name string, written long")


# ---- names by trigrams ----------------------------------------------------------------------------------------------

_WANTED = "all_r%ing"


@query(
    "symbol_trigram_search",
    f"""WITH s AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '/' || p_size AS path, CAST(p_partkey AS INT) AS line FROM part),
        g AS (SELECT unnest(['all', 'ing']) AS gram), n AS (SELECT DISTINCT lower(name) AS name FROM s),
        r AS (SELECT count(*) AS grams_read FROM n, g WHERE contains(n.name, gram)),
        c AS (SELECT count(*) AS candidates FROM n WHERE contains(name, 'all') AND contains(name, 'ing')),
        m AS (SELECT count(*) AS symbols_read FROM s WHERE lower(name) LIKE '%{_WANTED}%')
        SELECT * FROM (SELECT symbol_id, name, path FROM s WHERE lower(name) LIKE '%{_WANTED}%' ORDER BY (lower(name) = '{_WANTED}') DESC, length(name), path, line, name LIMIT 25), r, c, m""",
)
def symbol_trigram_search(spark, sf):
    """A name search with wildcards through the index of names, with the rows that it read."""
    grams, stored = trigrams.name_index(adapters.part_symbols(spark, sf))
    found, work = trigrams.trigram_search(grams, stored, _WANTED, 25)
    return found.select("symbol_id", "name", "path").crossJoin(F.broadcast(work))  # one row


# ---- logs merged when they are read ----------------------------------------------------------------------------------

#: Events as calls that list a file of the user; every third purchase changes the file of its user; the newest half counts.
_LOG = """calls AS (SELECT event_id AS id, event_type AS tool, user_id FROM events),
    n AS (SELECT count(*) // 2 AS keep FROM events), cut AS (SELECT min(id) AS f FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS r FROM calls), n WHERE r <= keep),
    ch AS (SELECT user_id, max(event_id) AS before FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 GROUP BY user_id)"""
_LOG_SQL = f"WITH {_LOG} SELECT id, tool, before IS NOT NULL AND id < before AS stale FROM calls LEFT JOIN ch USING (user_id), cut WHERE id >= f"


def _log(spark, sf) -> overlay.Overlay:
    calls = adapters.tool_calls(spark, sf)
    log = overlay.Overlay(spark, f"{shared_dir(spark)}/tessera-log-{uuid.uuid4().hex}", "tool string, files array<string>, stale boolean")
    log.append(calls.select("id", "tool", F.array("path").alias("files"), F.lit(None).cast("boolean").alias("stale")))
    changed = calls.where("tool = 'purchase' AND id % 3 = 0").select(F.replace("path", F.lit("/"), F.lit("\\")).alias("path"), F.col("id").alias("before"))
    log.changes(changed)
    log.prune(calls.count() // 2)
    return log


@query("log_overlay", _LOG_SQL)
def log_overlay(spark, sf):
    """Calls merged with changes and a cut beside them."""
    return _log(spark, sf).read().select("id", "tool", "stale")


@query("log_compacted", _LOG_SQL)
def log_compacted(spark, sf):
    """The same calls after compaction."""
    log = _log(spark, sf)
    log.compact()
    return log.read().select("id", "tool", "stale")


@query("log_rows", f"WITH {_LOG} SELECT 'merged' AS state, (SELECT count(*) FROM calls) AS base, (SELECT count(*) FROM ch) AS changes, CAST(1 AS BIGINT) AS cuts UNION ALL SELECT 'compacted', (SELECT count(*) FROM calls, cut WHERE id >= f), 0, 1")
def log_rows(spark, sf):
    """Rows that a reader of the log merges before and after compaction."""
    log = _log(spark, sf)
    before = log.stored().withColumn("state", F.lit("merged"))
    log.compact()
    return before.unionByName(log.stored().withColumn("state", F.lit("compacted")))


# ---- a repository as a data source --------------------------------------------------------------------------------

#: Documents of each source, as files that Spark writes: one line of text each, and a line end.
_SOURCES = "SELECT coalesce(source, 'none') AS folder, count(*) AS n_docs, sum(strlen(replace(text, chr(10), ' ')) + 1)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL"


def _repository(spark, sf) -> str:
    docs = table(spark, sf, "documents", "text", "source").where("text is not null")
    root = f"{shared_dir(spark)}/tessera-repository-{uuid.uuid4().hex}"
    line = F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")
    docs.select(line, F.coalesce("source", F.lit("none")).alias("folder")).write.option("maxRecordsPerFile", 500).partitionBy("folder").text(root)
    return root


def _folders(files):
    lines = F.length(F.regexp_replace(F.decode("content", "UTF-8"), "[^\n]", "")).cast("long")
    folder = F.substring_index(F.element_at(F.split("path", "/"), 2), "=", -1)
    return files.groupBy(folder.alias("folder")).agg(F.sum(lines).alias("n_docs"), F.sum("size").alias("n_bytes"))


@query("repository_source", _SOURCES)
def repository_source(spark, sf):
    """Files of a folder for each source of documents, listed and read by the tasks."""
    return _folders(repository.scan(spark, _repository(spark, sf), "docs", maxBytes=2**40, exclude="_SUCCESS"))


@query("repository_folder", f"SELECT * FROM ({_SOURCES}) WHERE starts_with(folder, 'src1')")
def repository_folder(spark, sf):
    """The same with a filter on the path, which leaves the other folders unlisted."""
    files = repository.scan(spark, _repository(spark, sf), "docs", maxBytes=2**40)
    return _folders(files.where(F.col("path").startswith("docs/folder=src1")))


# ---- streams with state ----------------------------------------------------------------------------------------------

#: Seconds after which a stream that has not handed everything over is taken for broken.
PATIENCE = 600


def _streamed(spark, df, batches: int):
    """A stream over a written copy of `df` that takes it in so many micro-batches, about; tasks write and read parts of each."""
    folder = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    if batches == 1:
        df.write.parquet(f"{folder}/in")  # as the input is split; all of it is one micro-batch
        return spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder
    df.repartitionByRange(parts * batches, "id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(f"{folder}/in"), folder


@query(
    "debounce_timers",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS head FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
       SELECT 'repo/' || user_id || '.rs' AS path, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n_events FROM g GROUP BY user_id, burst""",
)
def debounce_timers(spark, sf):
    """Bursts as timers close them: the query ends when every change was handed over, though no event follows the last ones."""
    events = adapters.tool_calls(spark, sf).select("id", "path", "ts", F.when(F.col("tool") == "error", "delete").otherwise("change").alias("op"))
    changed = events.where("op <> 'delete'").count()
    stream, folder = _streamed(spark, events, 1)
    with stateful.state_store(spark):
        bursts = stateful.debounced_by_timer(stream, 6 * 3_600_000, 500).writeStream.format("parquet").outputMode("append")
        running = bursts.option("checkpointLocation", f"{folder}/state").trigger(processingTime="500 milliseconds").start(f"{folder}/out")
    out, until = spark.read.schema(stateful.BURST), time.monotonic() + PATIENCE

    def handed_over() -> int:
        try:
            return out.parquet(f"{folder}/out").agg(F.coalesce(F.sum("n_events"), F.lit(0))).first()[0]
        except AnalysisException:  # nothing is written yet
            return 0

    try:  # timers keep such a stream busy, so it never counts as having processed all that is available
        while handed_over() < changed:
            if running.exception() or time.monotonic() > until:
                raise RuntimeError("the stream stopped before all bursts were handed over") from running.exception()
            time.sleep(0.5)
    finally:
        running.stop()
    return out.parquet(f"{folder}/out").select("path", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n_events")


@query("rolling_history", "SELECT event_id AS id, event_type AS tool FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) ORDER BY event_id DESC LIMIT 200")
def rolling_history(spark, sf):
    """The newest searches as the state of a stream holds them after its last micro-batch."""
    calls = adapters.tool_calls(spark, sf)
    stream, folder = _streamed(spark, calls, 3)
    with stateful.state_store(spark):
        stateful.rolling_history(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return history.newest(stateful.read_history(spark, f"{folder}/out", calls.schema), 300).select("id", "tool")
