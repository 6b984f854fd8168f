"""Snapshots of micro-batches, and alerts while a silence lasts."""

import datetime as dt
import os
import shutil

from sceneweave.streaming import folds, runs

EVENT = "run_id int, type string, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame([(r, kind, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for r, kind, s in rows], EVENT)


def test_reading_costs_the_same_after_many_batches(spark, tmp_path):
    path, seen = str(tmp_path / "k1"), []
    write = runs.append_summaries(path, every=3)
    for k in range(14):
        write(events(spark, [(k % 2, "step", k), (7, "step", k)]), k)
        seen.append(len(folds.FoldedFolder(spark, path, runs.added_summaries)._folders()))
        assert len(os.listdir(path)) <= 9
    assert max(seen) <= 3
    write(events(spark, [(7, "error", 13)]), 11)  # a batch that a snapshot holds
    write(events(spark, [(1, "complete", 13), (7, "step", 13)]), 13)  # the last batch, tried again
    found = {r.run_id: (r.status, r.steps, r.n_events) for r in runs.summaries(spark, path).collect()}
    assert found == {0: ("running", 7, 7), 1: ("complete", 6, 7), 7: ("running", 14, 14)}


def test_a_broken_snapshot_or_batch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "k3")
    rows = lambda k: spark.createDataFrame([("m", "b", k, float(k)), ("n", "b", -k, float(k))], "model string, benchmark string, seq int, value double")
    write = runs.upsert_headlines(path, every=2)
    for k in range(5):
        write(rows(k), k)
    for name in ("snapshot=4", "batch=5"):
        shutil.copytree(f"{path}/batch=4", f"{path}/{name}")
        os.remove(f"{path}/{name}/_SUCCESS")
    read = lambda: {r.model: r.value for r in runs.headlines(spark, path).collect()}
    assert read() == {"m": 4.0, "n": 0.0}
    write(rows(5), 5)
    assert read() == {"m": 5.0, "n": 0.0} and "snapshot=5" in os.listdir(path)


def test_alerts_come_while_the_silence_lasts_and_once(spark, tmp_path):
    source, out = tmp_path / "in", {}
    batches = [[(1, "start", 0), (2, "start", 0)], [(2, "step", 14)], [(2, "step", 16)], [(2, "complete", 28), (1, "step", 29)], [(3, "start", 100)]]

    def write(batch, batch_id):
        for r in batch.collect():
            out.setdefault(len(sent), []).append((r.run_id, (r.silent_since - dt.datetime(2024, 1, 1)).seconds))

    sent = []
    for k, rows in enumerate(batches):
        sent.append(k)
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = runs.silence_alerts(spark.readStream.schema(EVENT).parquet(str(source)), 15)
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    # run 1 is told of at 16 s, before it goes on at 29 s; run 2 ends at 28 s and is never told of.
    assert out == {3: [(1, 0)], 5: [(1, 29)]}
    table = events(spark, [r for rows in batches for r in rows])
    assert sorted((r.run_id, (r.silent_since - dt.datetime(2024, 1, 1)).seconds) for r in runs.silence_alerts(table, 15).collect()) == [(1, 0), (1, 29)]
