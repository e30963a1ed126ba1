"""Keyed timers, closing heartbeats and the upsert sink."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scorelake.sources.storage import work_dir
from scorelake.streaming import jobs

SCHEMA = "event_id long, ts timestamp, experiment_id long, status string, value double"
START = datetime(2024, 1, 1)


def put(spark, folder, rows):
    made = [(i, START + timedelta(hours=h), e, s, 1.0) for i, h, e, s in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stale_tasks_are_told_by_timers_and_revived(spark):
    folder, beats = work_dir(spark), work_dir(spark)
    put(spark, folder, [(1, 0, 7, "queued"), (2, 1, 7, "running"), (3, 0, 8, "queued"), (4, 2, 8, "completed"), (5, 0, 9, "queued")])
    events = stream_of(spark, folder)
    told = []
    stream = jobs.lifecycle(jobs.heartbeat_stream(events, beats), timedelta(days=1), "0 seconds")
    checkpoint = work_dir(spark)

    def run():
        rows = []
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: rows.extend(b.collect())).start()
        query.awaitTermination()
        told.append({r["experiment_id"]: (r["status"], r["error"], r["attempts"]) for r in rows})

    run()
    assert told[0] == {7: ("running", None, 1), 8: ("completed", None, 1), 9: ("queued", None, 1)}
    jobs.beat(spark, beats, events.schema, START + timedelta(hours=24, minutes=30))
    run()
    assert told[1] == {9: ("failed", "stale", 1)}
    put(spark, folder, [(6, 25, 9, "running")])
    jobs.beat(spark, beats, events.schema, START + timedelta(hours=26))
    run()
    assert told[2] == {9: ("running", None, 1), 7: ("failed", "stale", 1)}


def test_lifecycle_equals_the_batch_form(spark):
    folder = "/root/testdata/sf0.001"
    events = jobs.event_stream(spark, folder)
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]
    for after in (timedelta(hours=3), timedelta(days=5)):
        batch = jobs.with_stale_failed(jobs.settle(jobs.task_states(events), "update", ["experiment_id"]), F.lit(last), f"{int(after.total_seconds())} SECONDS")
        columns = batch.columns
        got = jobs.final_lifecycle(events, after, last).select(*columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_no_session_is_left_open(spark):
    folder = work_dir(spark)
    put(spark, folder, [(1, 0, 7, "queued"), (2, 1, 7, "scored"), (3, 9, 7, "failed"), (4, 9, 8, "scored")])
    got = jobs.all_sessions(stream_of(spark, folder), "2 hours", START + timedelta(hours=9)).collect()
    hours = lambda t: (t - START).total_seconds() / 3600
    assert sorted((r["experiment_id"], hours(r["start"]), hours(r["end"]), r["n"]) for r in got) == [(7, 0.0, 3.0, 2), (7, 9.0, 11.0, 1), (8, 9.0, 11.0, 1)]


def test_upserts_survive_a_killed_and_retried_batch(spark):
    frame = lambda rows: spark.createDataFrame(rows, "experiment_id long, row_idx long, score double")
    batches = [[(1, 0, 0.1), (1, 1, 0.2), (2, 0, 0.3)], [(1, 1, 0.9), (1, 2, 0.4)], [(3, 0, 0.5), (2, 0, 0.6)]]
    want = [(1, 0, 0.1), (1, 1, 0.9), (1, 2, 0.4), (2, 0, 0.6), (3, 0, 0.5)]
    folder = work_dir(spark)
    write = jobs.upsert(folder, "experiment_id", ["row_idx"])
    table = lambda: sorted(map(tuple, jobs.upserted(spark, folder, frame([]).schema, "experiment_id").collect()))
    assert table() == []
    for number, rows in enumerate(batches):
        before = table()
        # killed before its commit: its data are there, and no reader sees them
        frame([(1, 77, 7.0), (9, 9, 9.0)]).write.parquet(f"{folder}/data/batch={number}")
        assert table() == before
        write(frame(rows), number)
        after = table()
        # killed after its commit, so that the stream runs it again
        write(frame(rows), number)
        assert table() == after
    assert table() == want
    plan = jobs.upserted(spark, folder, frame([]).schema, "experiment_id")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_scores_of_many_batches_are_upserted(spark):
    from scorelake.operators.scoring import ScoringPlan

    folder = work_dir(spark)
    for n in range(3):
        spark.createDataFrame([(e, r, "a" if (e + r + n) % 2 else "b", "a") for e in range(2 + n) for r in range(n, n + 3)], "experiment_id long, row_idx long, output string, expected string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("experiment_id long, row_idx long, output string, expected string").option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.scored_stream(stream, ScoringPlan("exact_match_ci"), "experiment_id", ["row_idx"]).collect()
    assert len({(r["experiment_id"], r["row_idx"]) for r in got}) == len(got) == len({(e, r) for n in range(3) for e in range(2 + n) for r in range(n, n + 3)})


def test_notifications_join_on_the_project(spark):
    events = spark.createDataFrame([(1, 5, "completed", 10), (2, 5, "running", 10), (3, 6, "failed", 11)], "event_id long, experiment_id long, status string, project_id long")
    subs = spark.createDataFrame([(100, 10, ["completed"]), (101, 11, ["completed"]), (102, 11, ["failed", "completed"])], "sub_id long, project_id long, events array<string>")
    assert sorted(map(tuple, jobs.notified(events, subs).collect())) == [(1, 100, "completed"), (3, 102, "failed")]


@pytest.mark.parametrize("mode", ["append"])
def test_an_empty_stream_gives_an_empty_table(spark, mode):
    folder = work_dir(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert jobs.settle(stream_of(spark, folder), mode).count() == 0


def test_lifecycle_folds_plain_arrays():
    """A task's few events are folded without a frame operation for each step: sorting or indexing frames cost more than they."""
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.timer = at

        def getCurrentWatermarkMs(self):
            return 0

    at = pd.to_datetime(["2024-01-01 00:00:02", "2024-01-01 00:00:05.000001", "2024-01-01 00:00:01", "2024-01-01 00:00:05.000001"], format="ISO8601")
    frame = pd.DataFrame({"event_id": [7, 3, 9, 2], "ts": at, "status": ["running", "completed", "queued", "scored"]})
    state, fold = State(), jobs._lifecycle(timedelta(days=1))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pd.DataFrame, "sort_values", None)
        row = next(fold((5,), iter([frame[:0], frame]), state)).iloc[0]
        assert (row["experiment_id"], row["status"], row["attempts"], row["error"]) == (5, "completed", 1, None)
        assert (row["started_at"], row["finished_at"], row["last_ts"]) == (at[0], at[1], at[1])
        later = pd.DataFrame({"event_id": [1], "ts": pd.to_datetime(["2024-01-01 00:00:09"]), "status": ["running"]})
        row = next(fold((5,), iter([later]), state)).iloc[0]
    assert (row["status"], row["started_at"], row["last_ts"]) == ("running", at[0], later["ts"][0]) and state.timer > 0
