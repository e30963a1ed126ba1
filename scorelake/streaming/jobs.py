"""Structured Streaming jobs over result events: progress, idempotent intake, windowed trend, notifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.numbers import ratio, rounded
from scorelake.operators.scoring import ScoringPlan, score_rows
from scorelake.sources.storage import work_dir

ACTIVE = ["queued", "running", "scored"]


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, with status and experiment columns."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    # Which event type plays which status.
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "scored").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("experiment_id"), status.alias("status"), "value")


def heartbeat_stream(events: DataFrame, folder: str) -> DataFrame:
    """events and the heartbeats that are later put into folder: rows with a time and nothing else, which move a watermark on
    when no event comes any more."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("append").parquet(folder)
    return events.union(spark.readStream.schema(events.schema).parquet(folder))


def beat(spark: SparkSession, folder: str, schema: T.StructType, at: datetime, column: str = "ts") -> None:
    """Put a heartbeat of a time into folder."""
    row = spark.createDataFrame([(at,)], "at timestamp").select(*[F.col("at").cast("timestamp").alias(f.name) if f.name == column else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(folder)


def settle(stream: DataFrame, mode: str, keys: list[str] | None = None, closing: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there into a Parquet table and return the table.

    Each batch writes a folder of its own, so that a retried batch replaces what it wrote before. append: the table is all
    of them. update: a batch holds the keys that changed; the row of the latest batch counts, and nothing is rewritten.
    closing is called when all input is read; the stream then goes on from its checkpoint with what that has added.
    """
    spark = stream.sparkSession
    folder = work_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    def run() -> bool:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        return any(r["numInputRows"] for r in query.recentProgress)

    ran = run()
    if closing is not None:
        closing()
        ran = run() or ran
    if not ran:
        return spark.createDataFrame([], stream.schema)
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    table = spark.read.schema(schema).parquet(f"{folder}/table")
    if mode == "append":
        return table.select(*columns)
    row = F.struct(*columns)
    return table.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select("row.*")


def progress(events: DataFrame) -> DataFrame:
    """Live progress of each experiment: events seen, scored, failed, the mean value of scored ones, and when it began
    and was last seen."""
    scored = F.col("status") == "scored"
    return events.groupBy("experiment_id").agg(F.count("*").alias("processed"), F.count_if(scored).alias("scored"), F.count_if(F.col("status") == "failed").alias("failed"), rounded(F.avg(F.when(scored, F.col("value"))), 4).alias("mean_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def with_eta(progress: DataFrame, planned: DataFrame) -> DataFrame:
    """progress with its planned rows, the mean time per row so far and the time that the rest will take at that pace."""
    out = progress.join(planned, "experiment_id", "left")
    spent = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000
    out = out.withColumn("ms_per_row", rounded(ratio(spent, F.col("processed")), 3))
    return out.withColumn("eta_ms", rounded(F.greatest(F.col("planned") - F.col("processed"), F.lit(0)) * F.col("ms_per_row"), 3))


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; state older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, failure rate, mean value and cost in tumbling or sliding windows of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _trend(events.withWatermark("ts", late).groupBy(window.alias("w")))


def _is_event() -> Column:
    """Not a heartbeat. The condition reads the time, so that it stays above the watermark, which has to see heartbeats."""
    return F.when(F.col("ts").isNull(), False).otherwise(F.col("experiment_id").isNotNull())


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """The same for the sessions of each experiment: runs of events with less than the gap between them. Rows without an
    experiment, such as heartbeats, only move the watermark."""
    seen = events.withWatermark("ts", late).where(_is_event())
    return _trend(seen.groupBy("experiment_id", F.session_window("ts", gap).alias("w")), "experiment_id")


def all_sessions(events: DataFrame, gap: str, last: datetime, late: timedelta = timedelta(hours=1)) -> DataFrame:
    """The table of all sessions of a stream that ends at `last`: once it is read, a heartbeat beyond the last gap closes the
    sessions that are still open."""
    spark, folder = events.sparkSession, work_dir(events.sparkSession)
    stream = sessions(heartbeat_stream(events, folder), gap, f"{int(late.total_seconds())} seconds")
    return settle(stream, "append", closing=lambda: beat(spark, folder, events.schema, last + late + timedelta(days=3650)))


def _trend(groups, *keys: str) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    out = groups.agg(F.count("*").alias("n"), failed.alias("failed"), rounded(failed / F.count("*"), 4).alias("failure_rate"), rounded(F.avg("value"), 4).alias("mean_value"), rounded(F.sum("value"), 4).alias("sum_value"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "failed", "failure_rate", "mean_value", "sum_value")


def task_states(events: DataFrame) -> DataFrame:
    """The lifecycle of each task, as a stream in update mode: latest status, attempts, when it started and finished."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    done = F.col("status").isin("completed", "failed")
    return events.groupBy("experiment_id").agg(last.alias("status"), F.count_if(F.col("status") == "queued").alias("attempts"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("finished_at"), F.max("ts").alias("last_ts"))


def with_stale_failed(states: DataFrame, now, after: str) -> DataFrame:
    """Tasks that are still active but were last seen more than `after` before now count as failed, and say so."""
    stale = F.col("status").isin(ACTIVE) & (F.col("last_ts") < now - F.expr(f"INTERVAL {after}"))
    return states.withColumn("error", F.when(stale, "stale")).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


LIFECYCLE = "experiment_id long, status string, attempts long, started_at timestamp, finished_at timestamp, last_ts timestamp, error string"
_STATE = "status string, attempts long, started long, finished long, last long, last_id long, stale boolean"


def _lifecycle(after: timedelta):
    """One task's state: it folds a batch's events in, and a timer that the events set tells when it has become stale."""
    wait = int(after.total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts, started, finished, last, last_id, stale = state.get if state.exists else (None, 0, None, None, -(1 << 62), -(1 << 62), False)
        if state.hasTimedOut:
            stale = status in ACTIVE
        for frame in frames:
            if not len(frame):
                continue
            # plain arrays: a task has few events, for which operations on frames would cost more than the events
            at, ids, said = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), frame["event_id"].to_numpy(), frame["status"].to_numpy(dtype=object)
            attempts += int((said == "queued").sum())
            began, ended = at[said == "running"], at[(said == "completed") | (said == "failed")]
            if len(began):
                started = int(began.min()) if started is None else min(started, int(began.min()))
            if len(ended):
                finished = int(ended.max()) if finished is None else max(finished, int(ended.max()))
            newest = np.lexsort((ids, at))[-1]
            if (int(at[newest]), int(ids[newest])) > (last, last_id):
                status, last, last_id = said[newest], int(at[newest]), int(ids[newest])
            stale = False
        state.update((status, attempts, started, finished, last, last_id, stale))
        if status in ACTIVE and not stale:
            state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        moment = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us")
        row = (key[0], "failed" if stale else status, attempts, moment(started), moment(finished), moment(last), "stale" if stale else None)
        yield pd.DataFrame([row], columns=["experiment_id", "status", "attempts", "started_at", "finished_at", "last_ts", "error"])

    return fold


def lifecycle(events: DataFrame, after: timedelta, late: str = "1 hour") -> DataFrame:
    """The lifecycle of each task as a stream that tells by itself when a task has become stale: `failed` with the error
    `stale` once the watermark is more than `after` past the last event of an active task. A later event revives it."""
    rows = events.withWatermark("ts", late).where(_is_event()).select("experiment_id", "event_id", "ts", "status")
    return rows.groupBy("experiment_id").applyInPandasWithState(_lifecycle(after), LIFECYCLE, _STATE, "update", "EventTimeTimeout")


def final_lifecycle(events: DataFrame, after: timedelta, now: datetime, late: timedelta = timedelta(hours=1)) -> DataFrame:
    """The table of the lifecycles of a stream when its time is `now`."""
    spark, folder = events.sparkSession, work_dir(events.sparkSession)
    stream = lifecycle(heartbeat_stream(events, folder), after, f"{int(late.total_seconds())} seconds")
    return settle(stream, "update", ["experiment_id"], closing=lambda: beat(spark, folder, events.schema, now + late))


def _changes(step: float):
    def emit(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, seen, ended = state.get if state.exists else (None, -1.0, False)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if ended:
                break
            if r.status != status or abs(r.value - seen) > step:
                status, seen = r.status, float(r.value)
                out.append((key[0], r.event_id, r.ts, status, seen))
            ended = r.status in ("completed", "failed")
        state.update((status, seen, ended))
        yield pd.DataFrame(out, columns=["experiment_id", "event_id", "ts", "status", "value"])

    return emit


def change_feed(events: DataFrame, step: float = 0.5) -> DataFrame:
    """The events at which an experiment changes: another status, or a progress value more than step away from the last
    one told. After a terminal status an experiment tells nothing more; its state is three values."""
    schema = "experiment_id long, event_id long, ts timestamp, status string, value double"
    rows = events.select("experiment_id", "event_id", "ts", "status", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.groupBy("experiment_id").applyInPandasWithState(_changes(step), schema, "status string, seen double, ended boolean", "append", "NoTimeout")


def upsert(folder: str, group: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that keeps the latest row of each key, whole groups at a time.

    A batch writes the rows of the groups that it touches, merged with what they had, into a folder of its own, and then, as
    its commit, one small file that tells for every group the batch which holds its rows. Before the commit readers see the
    batch before; a batch that is run again starts from that one and replaces what it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([group, *keys])
        pointers = _pointers(spark, folder, group, number)
        touched = rows.select(group).distinct()
        if pointers is not None:
            old = _pointed(spark, folder, rows.schema, pointers.join(touched, group, "left_semi"), group)
            rows = rows.unionByName(old.join(rows.select(group, *keys), [group, *keys], "left_anti"))
        data = f"{folder}/data/batch={number}"
        rows.write.mode("overwrite").parquet(data)
        now = spark.read.schema(rows.schema).parquet(data).select(group).distinct().withColumn("at", F.lit(number).cast("long"))
        if pointers is not None:
            now = now.unionByName(pointers.join(now.select(group), group, "left_anti"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointers/version={number}")

    return write


def _pointers(spark: SparkSession, folder: str, group: str, before: int | None = None) -> DataFrame | None:
    """(group, at): the pointers of the last commit, or of the last one before a batch; None if there is none."""
    try:
        every = spark.read.parquet(f"{folder}/pointers")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if before is not None:
        every = every.where(F.col("version") < before)
    last = every.agg(F.max("version").alias("v")).first()["v"]
    return None if last is None else every.where(F.col("version") == last).select(group, "at")


def _pointed(spark: SparkSession, folder: str, schema: T.StructType, pointers: DataFrame, group: str) -> DataFrame:
    """The rows that pointers name: a join with one row for each group, and only the named batches are read."""
    named = [r["at"] for r in pointers.select("at").distinct().collect()]
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/batch={n}" for n in named]) if named else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return table.join(pointers, (table[group] == pointers[group]) & (F.col("batch") == F.col("at")), "left_semi").select(*schema.names)


def upserted(spark: SparkSession, folder: str, schema: T.StructType, group: str) -> DataFrame:
    """The table that an `upsert` sink keeps, as of its last commit."""
    pointers = _pointers(spark, folder, group)
    return spark.createDataFrame([], schema) if pointers is None else _pointed(spark, folder, schema, pointers, group)


def scored_stream(answers: DataFrame, plan: ScoringPlan, group: str, keys: list[str]) -> DataFrame:
    """Score a stream of answers batch by batch into an upserted table and return the table."""
    scored = score_rows(answers, plan).select(group, *keys, "cleaned", "score", "error_kind")
    spark, folder = answers.sparkSession, work_dir(answers.sparkSession)
    query = scored.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(upsert(folder, group, keys)).start()
    query.awaitTermination()
    return upserted(spark, folder, scored.schema, group)


def notified(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Terminal events with a project_id joined to the static subscriptions of their project that list their status."""
    ended = events.where(F.col("status").isin("completed", "failed"))
    return ended.join(subscriptions, "project_id").where(F.array_contains("events", F.col("status"))).select("event_id", "sub_id", "status")
