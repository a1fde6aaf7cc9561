"""The jobs on copies of inputs that grow, on runs that are cut off, and from the command line."""

import datetime
import json
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import index_documents, usage_report

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string, terms string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, day string"


def add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def words(text):
    return [w.lower() for w in re.split(r"[\W_]+", text or "") if len(w.encode()) >= 2]


def index_of(spark, output):
    documents, terms = index_documents.read(spark, str(output))
    docs = {r.key: (r.path, r.length, r.buckets, {t.term: t.tf for t in r.terms}) for r in documents.collect()}
    found = terms.groupBy("term").sum("df", "cf").collect()
    return docs, {r[0]: (r[1], r[2]) for r in found}, documents.count()


def expected(rows, buckets):
    import hashlib

    newest = {}
    for doc_id, text, lang, source, _ in rows:
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        name = str(doc_id) if doc_id is not None else sha
        newest[str(doc_id) if doc_id is not None else f"sha256:{sha}"] = ("/".join(x for x in (source, lang, name) if x is not None), len(words(text)), buckets, dict(Counter(words(text))))
    df, cf = Counter(), Counter()
    for *_, tf in newest.values():
        df.update(tf.keys())
        cf.update(tf)
    return newest, {t: (df[t], cf[t]) for t in df}


FIRST = [(i, f"Alpha beta{i % 3} x 9 gamma_delta Été {'long ' * (i % 4)}", "en", "web", "clash") for i in range(12)]
FIRST += [(20, None, "en", "web", ""), (21, "", None, None, ""), (None, "nameless one", "en", "web", ""), (22, " .,- x ", "de", "web", ""), (3, "again in the same file", "en", "web", "")]
SECOND = [(3, "three is new", "de", "book", ""), (30, "thirty alpha alpha", "en", "web", ""), (None, "nameless one", "en", "web", ""), (-5, "negative id", "en", "web", "")]


def test_index_takes_only_what_is_new(spark, tmp_path):
    source, output, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    add(spark, FIRST, DOCS, source)

    def run():
        return index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4, files_per_batch=1)

    assert run()["read"] == len(FIRST)
    docs, terms, n = index_of(spark, output)
    assert (docs, terms) == expected(FIRST, 4) and n == len(docs)
    before = {f: f.stat().st_mtime_ns for f in output.rglob("*.parquet")}
    assert run() == {"batches": 0, "read": 0, "buckets": 0, "written": 0}
    assert before == {f: f.stat().st_mtime_ns for f in output.rglob("*.parquet")}
    add(spark, SECOND, DOCS, source)
    counts = run()
    assert counts["read"] == len(SECOND) and counts["batches"] == 1
    docs, terms, n = index_of(spark, output)
    assert (docs, terms) == expected(FIRST + SECOND, 4) and n == len(docs)
    # Nothing but the checkpoint knows what was taken: without it all is read again, to the same end.
    again = index_documents.run(spark, str(source), str(output), str(tmp_path / "other"), buckets=4, files_per_batch=100)
    assert again["read"] == len(FIRST + SECOND) and index_of(spark, output) == (docs, terms, n)
    with pytest.raises(ValueError, match="4 buckets"):
        index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=8)


def test_index_after_a_run_that_was_cut_off(spark, tmp_path, monkeypatch):
    source, output, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    add(spark, FIRST, DOCS, source)
    index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    add(spark, SECOND, DOCS, source)
    put = index_documents._put

    def broken(df, folder):
        if folder.endswith("documents"):
            raise OSError("the power went")
        put(df, folder)

    monkeypatch.setattr(index_documents, "_put", broken)
    with pytest.raises(Exception, match="the power went"):
        index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    monkeypatch.setattr(index_documents, "_put", put)
    index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    assert index_of(spark, output)[:2] == expected(FIRST + SECOND, 4)


def test_newest_rows_are_found_by_name(spark, tmp_path):
    """Of repeated names, within a batch and between it and the index, one row stays; rows with words are in no shuffle for it."""
    row = "key string, terms array<string>, version struct<changed: timestamp, file: string, place: long>, bucket int"

    def rows(*some):
        return spark.createDataFrame([(k, [w], (at(1, minute), file, place), 0) for k, w, minute, file, place in some], row)

    fresh = rows(("a", "old", 1, "f", 0), ("a", "new", 1, "f", 1), ("b", "late", 2, "f", 2), ("c", "only", 2, "f", 3), ("d", "tie", 2, "f", 4), ("d", "tie", 2, "f", 4), ("e", "early", 1, "f", 5))
    stored = rows(("b", "was", 1, "e", 9), ("d", "tie", 2, "f", 4), ("e", "kept", 3, "e", 1), ("f", "only", 1, "e", 2))
    found = index_documents._newest(fresh, stored)
    expect = [("a", "new"), ("b", "late"), ("c", "only"), ("d", "tie"), ("e", "kept"), ("f", "only")]
    assert sorted((r.key, r.terms[0]) for r in found.collect()) == expect and found.columns == fresh.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan, plan


def test_index_cut_off_between_its_tables(spark, tmp_path, monkeypatch):
    source, output, checkpoint, put = tmp_path / "in", tmp_path / "out", tmp_path / "state", index_documents._put
    add(spark, FIRST, DOCS, source)
    index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    add(spark, SECOND, DOCS, source)
    done = []

    def broken(df, folder):
        if done:
            raise OSError("the power went")
        put(df, folder)
        done.append(folder.rsplit("/", 1)[1])

    monkeypatch.setattr(index_documents, "_put", broken)
    with pytest.raises(Exception, match="the power went"):
        index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    assert done == ["documents"]
    monkeypatch.setattr(index_documents, "_put", put)
    index_documents.run(spark, str(source), str(output), str(checkpoint), buckets=4)
    assert index_of(spark, output)[:2] == expected(FIRST + SECOND, 4)


def test_index_of_nothing(spark, tmp_path):
    add(spark, [], DOCS, tmp_path / "in")
    index_documents.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert index_of(spark, tmp_path / "out") == ({}, {}, 0)


def at(day, minute):
    return datetime.datetime(2024, 1, day, 12, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minute)


CALLS = [(1, at(1, 0), 7, "search", 10.5, "x"), (2, at(1, 30), 7, "search", 1.0, "x"), (3, at(1, 61), 7, "search", 2.0, "x"), (4, at(1, 5), 8, "search", 3.0, "x"),
         (5, at(1, 5), 8, "read", None, "x"), (6, at(2, 1), None, None, 4.0, "x"), (7, None, 7, "search", 5.0, "x"), (8, at(2, 1), 7, "read", 1e6, "x"), (8, at(2, 1), 7, "read", 1e6, "x")]
REPORT = {
    ("2024-01-01", "search"): (4, 2, 3, 2, 16, 33, "67%", "$0.00"),
    ("2024-01-01", "read"): (1, 1, 1, 1, 0, 0, "0%", "$0.00"),
    ("2024-01-02", None): (1, 0, 1, 1, 4, 8, "66%", "$0.00"),
    ("2024-01-02", "read"): (2, 1, 1, 2, 2_000_000, 4_000_000, "66%", "$6.00"),
    (None, "search"): (1, 1, 0, 0, 5, 10, "66%", "$0.00"),
}


def report_of(spark, output):
    rows = usage_report.read(spark, str(output)).collect()
    return {(r.day and str(r.day), r.tool): (r.calls, r.files, r.bursts, r.longest_burst, r.tokens_sent, r.tokens_saved, r.efficiency, r.cost) for r in rows}


def test_usage_report(spark, tmp_path):
    source, output = tmp_path / "in", tmp_path / "out"
    add(spark, CALLS, EVENTS, source)
    for _ in range(2):
        assert usage_report.run(spark, str(source), str(output))["written"] == len(REPORT)
        assert report_of(spark, output) == REPORT
    # A day more: only it is read and written.
    add(spark, [(9, at(3, 0), 7, "read", 8.0, "x"), (10, at(1, 3), 7, "read", 8.0, "x")], EVENTS, source)
    assert usage_report.run(spark, str(source), str(output), since="2024-01-03", until="2024-01-03") == {"read": 1, "days": 1, "written": 1}
    assert report_of(spark, output) == REPORT | {("2024-01-03", "read"): (1, 1, 1, 1, 8, 16, "66%", "$0.00")}
    usage_report.run(spark, str(source), str(output))
    assert report_of(spark, output)["2024-01-01", "read"] == (2, 2, 2, 1, 8, 16, "66%", "$0.00")


def test_usage_of_nothing(spark, tmp_path):
    add(spark, [], EVENTS, tmp_path / "in")
    assert usage_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"read": 0, "days": 0, "written": 0}


def test_command_lines(spark, tmp_path):
    add(spark, FIRST, DOCS, tmp_path / "docs")
    config = tmp_path / "small.json"
    config.write_text(json.dumps({"buckets": 2}))
    given = ["--documents", tmp_path / "docs", "--output", tmp_path / "index", "--checkpoint", tmp_path / "state", "--config", config]
    done = subprocess.run([sys.executable, "-m", "jobs.index_documents", *map(str, given)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 17 documents" in done.stderr, done.stderr
    assert index_of(spark, tmp_path / "index")[:2] == expected(FIRST, 2)
