import pyspark.sql.functions as F

from tessera.operators import history
from tessera.plans.context import Index, run_pipeline
from tessera.streaming.changes import debounced, maintain


def index(spark):
    files = spark.createDataFrame(
        [(f"app/src/{n}.rs", "rust", 4000, None) for n in ("auth", "login_user", "db", "cache", "misc")]
        + [("app/doc/auth.md", "markdown", 9000, "the auth token flow explained: auth token refresh"), ("app/doc/x.md", "markdown", 50, "nothing here")],
        "path string, language string, char_count long, text string",
    )
    rows = [("auth", "authenticate_user"), ("auth", "AuthToken"), ("login_user", "login"), ("login_user", "checkAuth"), ("db", "connect"), ("cache", "evict"), *[("misc", f"filler{i}") for i in range(30)]]
    symbols = spark.createDataFrame([(i, f"app/src/{p}.rs", n, "function", i, 1, True) for i, (p, n) in enumerate(rows)], "symbol_id long, path string, name string, kind string, line int, col int, is_exported boolean")
    edges = spark.createDataFrame([(4, 0, "function_call"), (2, 0, "function_call")], "from_id long, to_id long, kind string")
    return Index(files, symbols, edges)


def test_pipeline(spark):
    answer = run_pipeline(index(spark), "where is the AuthToken auth", include_content=False)
    pivots = answer.pivots.collect()
    assert pivots[0].path == "app/src/auth.rs" and "app/doc/auth.md" in [p.path for p in pivots]
    scores = [p.score for p in pivots]
    assert scores == sorted(scores, reverse=True) and sum(p.tokens for p in pivots) <= 8000 and all(p.tokens <= 2000 for p in pivots)
    summary = answer.summary.first()
    assert summary.confidence == "high" and not summary.weak and summary.n_pivots == len(pivots)
    assert "app/src/db.rs" in [r.path for r in answer.related.collect()]


def test_gibberish_is_weak(spark):
    summary = run_pipeline(index(spark), "zzqxv blorptang").summary.first()
    assert summary.confidence == "low" and summary.weak and summary.uncovered == ["blorptang", "zzqxv"]


def test_diff_files_join(spark):
    pivots = run_pipeline(index(spark), "AuthToken", diff=["app/src/cache.rs", "app/none.rs"]).pivots.collect()
    assert "git_diff" in {p.path: p.reasons for p in pivots}["app/src/cache.rs"]


def test_sessions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"sessions": [{"id": "a", "timestamp": 1, "calls": [{"query": "Find auth", "symbols": ["s"], "files": ["app/x.rs"], "tokens": 5, "stale": false, "timestamp": 1000}]}]}')
    (tmp_path / "log.jsonl").write_text('{"timestamp": 2000, "request": "short", "outcome": "fixed AUTH"}\n{"timestamp": 3000, "request": "other", "outcome": null}\n')
    calls = history.read_sessions(spark, str(tmp_path / "s.json")).unionByName(history.read_log(spark, str(tmp_path / "log.jsonl")))
    assert [r.query for r in history.recall(calls, "auth").collect()] == ["short", "Find auth"]
    assert [r.query for r in history.recall(calls, limit=1).collect()] == ["other"]
    assert [r.query for r in history.mark_stale(calls, ["app\\x.rs"]).where("stale").collect()] == ["Find auth"]
    history.append_log(calls, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_streaming_debounce_equals_batch(spark, tmp_path):
    rows = [("a.rs", "change", 0), ("a.rs", "change", 300), ("b.rs", "change", 400), ("a.rs", "change", 2000), ("b.rs", "delete", 2100)]
    table = spark.createDataFrame(rows, "path string, op string, ms long").select("path", "op", F.timestamp_millis("ms").alias("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "events"))
    batch = {(r.path, r.n_events) for r in debounced(table, "500 milliseconds").collect()}
    assert batch == {("a.rs", 2), ("a.rs", 1), ("b.rs", 1)}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))
    q = debounced(stream, "500 milliseconds", "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.path, r.n_events) for r in spark.sql("select * from bursts").collect()} == batch
    seen = []
    keep = lambda what: lambda paths: seen.append((what, [r.path for r in paths.collect()]))
    maintain(stream, keep("index"), keep("remove"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(seen) == [("index", ["a.rs"]), ("remove", ["b.rs"])]
