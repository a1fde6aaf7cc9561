import datetime
import time

import numpy as np
import pytest

from tessera.operators import history
from tessera.plans import maintenance_queries
from tessera.streaming import changes, stateful

EVENTS = "path string, op string, ts timestamp, n_events long"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(ms):
    return T0 + datetime.timedelta(milliseconds=ms)


def test_merged():
    b = np.array([[10, 10, 1], [0, 4, 2], [3, 3, 1], [20, 20, 1], [15, 30, 1]], np.int64)
    assert stateful.merged(b, 5).tolist() == [[0, 4, 3], [10, 30, 3]]
    assert stateful.merged(b, 6).tolist() == [[0, 30, 6]]
    assert stateful.merged(b[:0], 5).tolist() == []


def test_last_burst_comes_without_a_further_event(spark, tmp_path):
    batches = [
        [("a", "change", at(0), 1), ("a", "change", at(400), 1), ("b", "change", at(10), 1), ("a", "delete", at(5), 1), (None, "change", at(5), 1), ("c", "change", None, 1)],
        [("a", "change", at(900), 1), ("a", "change", at(2000), 1), ("a", "change", at(2100), 1), ("b", "change", at(10), 1)],
    ]
    source, out = tmp_path / "in", tmp_path / "out"
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    with stateful.state_store(spark):
        query = stateful.debounced_by_timer(stream, 500, 8000).writeStream.format("parquet").outputMode("append")
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start(str(out))
    try:
        for _ in range(240):
            time.sleep(0.5)
            if query.exception():
                raise query.exception()
            got = [] if not out.exists() else spark.read.schema(stateful.BURST).parquet(str(out)).collect()
            if sum(r.n_events for r in got) == 7:
                break
    finally:
        query.stop()
    every = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    assert sorted(got) == sorted(changes.debounced(every, "500 milliseconds", None).where("path is not null").collect())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "unset") == "unset"


SEARCHES = "id long, task string, slot int, row string"


def test_history_after_every_batch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for batch in ([(i * 7 % 100, f"t{i}", 1, "x") for i in range(100)], [(3, "again", 2, None), (None, "no id", 1, "x")], [(200 + i, None, i, "y") for i in range(4)] * 2):
        spark.createDataFrame(batch, SEARCHES).coalesce(2).write.mode("append").parquet(source)
        seen += batch
        with stateful.state_store(spark):
            stream = spark.readStream.schema(SEARCHES).parquet(source)
            stateful.rolling_history(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=10, slots=3).awaitTermination()
        got = stateful.read_history(spark, str(tmp_path / "out"), SEARCHES, keep=10).collect()
        want = sorted((r for r in seen if r[0] is not None), key=lambda r: -r[0])[:10]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        assert [r.id for r in got] == [r[0] for r in want]
    assert spark.read.parquet(str(tmp_path / "out")).count() <= 30


def test_one_micro_batch_is_written_and_read_by_several_tasks(spark):
    rows = spark.range(0, 100, 1, 4)
    stream, folder = maintenance_queries._streamed(spark, rows, 1)
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) == 4
    seen = []
    stream.writeStream.foreachBatch(lambda b, _: seen.append(b.count())).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [100]
