import random

import pytest

from tessera.sources.overlay import Overlay, greatest

COLUMNS = "task string, files array<string>, stale boolean"


def rows(log):
    return sorted((r.id, r.task, r.stale) for r in log.read().collect())


def brute(calls, changes, cuts):
    floor = max(cuts, default=-1)

    def stale(c):
        return bool(c[3]) or any(p == (f or "").replace("\\", "/") and c[0] < b for p, b in changes for f in c[2] or [])

    return sorted((c[0], c[1], stale(c)) for c in calls if c[0] is not None and c[0] >= floor)


def test_merged_and_compacted_alike(spark, tmp_path):
    rng, log, calls, changes, cuts = random.Random(4), Overlay(spark, str(tmp_path / "log"), COLUMNS), [], [], []
    for step in range(4):
        new = [(step * 10 + i, f"t{i}", rng.sample(["a/x.rs", "a\\y.rs", "b", "", "hot"], 2) + ["hot"], None if i % 2 else False) for i in range(8)]
        new += [(step * 10 + 7, "same id", ["b"], False), (step * 10 + 7, "same id", ["b"], False), (step * 10, "none", None, True), (None, "no id", ["hot"], False)]
        log.append(spark.createDataFrame([(*c, "clash") for c in new], f"id long, {COLUMNS}, before string"))
        calls += new
        path = ["a\\x.rs", "hot", "a/y.rs", "gone"][step]
        log.change(spark.createDataFrame([(path,), (path,), (None,)], "path string"), step * 10 + 4)
        changes.append((path.replace("\\", "/"), step * 10 + 4))
        assert rows(log) == brute(calls, changes, cuts)
        if step == 1:
            log.prune(9)
            cuts.append(sorted((c[0] for c in calls if c[0] is not None), reverse=True)[8])
            assert rows(log) == brute(calls, changes, cuts)
        if step == 2:
            want = rows(log)
            reader = log.read()
            assert log.compact() == 1 and rows(log) == want and sorted((r.id, r.task, r.stale) for r in reader.collect()) == want
            assert tuple(log.stored().first())[1:] == (0, 1) and log.stored().first().base == len(want)
            # What an interrupted compaction leaves is not seen, and written again.
            log.read().limit(2).selectExpr("*", "2 AS generation").write.mode("append").partitionBy("generation").parquet(f"{log.root}/base")
            assert rows(log) == want and Overlay(spark, log.root, COLUMNS).compact() == 2 and rows(log) == want
    log.prune(0)
    assert rows(log) == []


@pytest.mark.parametrize("columns", [COLUMNS, "task string"])
def test_nothing(spark, tmp_path, columns):
    log = Overlay(spark, str(tmp_path / "none"), columns)
    log.prune(3)
    assert log.read().collect() == [] and log.compact() == 1 and log.read().collect() == []


def test_greatest(spark):
    ids = [5, 5, 5, 0, 2**62, 2**62, -(2**63) + 1, 2**63 - 2, 7, 1_700_000_000_000_000, 1_700_000_000_000_001]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long").repartition(3)
    for k in range(1, len(ids) + 3):
        assert greatest(df, k) == sorted(ids, reverse=True)[min(k, len(ids)) - 1]
    assert greatest(df, 0) == 2**63 - 1 and greatest(df.limit(0), 3) is None
