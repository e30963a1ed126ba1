"""Queries T1-T7: streams run to the end of their files, with oracle SQL over the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from scorelake.operators.scoring import ScoringPlan
from scorelake.plans.scoring_queries import ORACLE as SCORING
from scorelake.sources.fixtures import oracle, raw, view
from scorelake.streaming import jobs as J


def _plain_times(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _last(s, d):
    """The time of the last event."""
    return raw(s, d, "events").agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]


def t1_live_progress(s, d):
    out = J.settle(J.progress(J.event_stream(s, d)), "update", ["experiment_id"])
    planned = raw(s, d, "events").select(F.col("user_id").alias("experiment_id")).distinct().withColumn("planned", F.lit(100))
    return _plain_times(J.with_eta(out, planned))


def t2_idempotent_intake(s, d):
    events = J.event_stream(s, d)
    return J.settle(J.once(events.union(events), ["event_id"]), "append").select("event_id", "experiment_id", "status")


def t3_change_feed(s, d):
    return J.settle(J.change_feed(J.event_stream(s, d)), "append").select("experiment_id", "event_id", "status", "value")


def t4_windowed_trend(s, d):
    return _plain_times(J.settle(J.windowed(J.event_stream(s, d), "1 day"), "update", ["start"]).drop("end"))


def t4_sliding_trend(s, d):
    return _plain_times(J.settle(J.windowed(J.event_stream(s, d), "2 days", "1 day"), "update", ["start"]).drop("end"))


def t4_session_trend(s, d):
    return _plain_times(J.all_sessions(J.event_stream(s, d), "6 hours", _last(s, d)))


def t5_task_states(s, d):
    states = J.settle(J.task_states(J.event_stream(s, d)), "update", ["experiment_id"])
    now = raw(s, d, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    out = J.with_stale_failed(states.crossJoin(F.broadcast(now)), F.col("now"), "1 DAY")
    return _plain_times(out.drop("now"))


def t5_lifecycle(s, d):
    """The same from keyed state, whose timers tell stale tasks by themselves."""
    return _plain_times(J.final_lifecycle(J.event_stream(s, d), timedelta(days=1), _last(s, d)))


def t6_streamed_scores(s, d):
    parts = s.readStream.schema(raw(s, d, "part").schema).option("pathGlobFilter", "part.parquet").parquet(d)
    answers = view(s, d, "answer_sheets", part=parts).withColumn("error", F.when(F.col("row_idx") % 10 == 0, "rate limited"))
    return J.scored_stream(answers, ScoringPlan("exact_match_ci"), "experiment_id", ["row_idx"]).drop("experiment_id")


def t7_stream_notifications(s, d):
    subs = raw(s, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("sub_id"), (F.col("n_nationkey") % 4).alias("project_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("completed"), F.lit("failed"))).otherwise(F.array(F.lit("failed"))).alias("events"))
    # the fixture's events have no project of their own
    events = J.event_stream(s, d).withColumn("project_id", F.pmod("experiment_id", F.lit(4)))
    return J.settle(J.notified(events, subs), "append").groupBy("sub_id", "status").agg(F.count("*").alias("n"))


def _r(x: str, digits: int = 4) -> str:
    return f"FLOOR(({x})*{10**digits}+0.5)/CAST({10**digits} AS DOUBLE)"


TREND = f"COUNT(*) AS n, COUNT(*) FILTER (status='failed') AS failed, {_r("COUNT(*) FILTER (status='failed')/CAST(COUNT(*) AS DOUBLE)")} AS failure_rate, {_r('AVG(value)')} AS mean_value, {_r('SUM(value)')} AS sum_value"
ORACLE = {
    "t1_live_progress": oracle(f"SELECT *, {_r('GREATEST(planned-processed, 0)*ms_per_row', 3)} AS eta_ms FROM (SELECT *, 100 AS planned, {_r('(EPOCH_US(last_ts)-EPOCH_US(first_ts))/1000.0/processed', 3)} AS ms_per_row FROM (SELECT experiment_id, COUNT(*) AS processed, COUNT(*) FILTER (status='scored') AS scored, COUNT(*) FILTER (status='failed') AS failed, {_r("AVG(CASE WHEN status='scored' THEN value END)")} AS mean_value, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM result_stream GROUP BY 1))"),
    "t2_idempotent_intake": oracle("SELECT event_id, experiment_id, status FROM result_stream"),
    "t4_windowed_trend": oracle(f"SELECT DATE_TRUNC('day', ts)::TIMESTAMP AS start, {TREND} FROM result_stream GROUP BY 1"),
    "t4_sliding_trend": oracle(f"SELECT start, {TREND} FROM (SELECT *, UNNEST([DATE_TRUNC('day', ts)::TIMESTAMP, DATE_TRUNC('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start FROM result_stream) GROUP BY 1"),
    "t5_task_states": oracle("SELECT experiment_id, attempts, started_at, finished_at, last_ts, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'stale' END AS error FROM (SELECT *, status IN ('queued','running','scored') AND last_ts < (SELECT MAX(ts) FROM result_stream) - INTERVAL 1 DAY AS stale FROM (SELECT experiment_id, ARG_MAX(status, (ts, event_id)) AS status, COUNT(*) FILTER (status='queued') AS attempts, MIN(CASE WHEN status='running' THEN ts END) AS started_at, MAX(CASE WHEN status IN ('completed','failed') THEN ts END) AS finished_at, MAX(ts) AS last_ts FROM result_stream GROUP BY 1))"),
    "t4_session_trend": oracle(f"SELECT experiment_id, MIN(ts)::TIMESTAMP AS start, MAX(ts)::TIMESTAMP + INTERVAL 6 HOUR AS \"end\", {TREND} FROM (SELECT *, SUM(fresh) OVER (PARTITION BY experiment_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY experiment_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM result_stream)) GROUP BY experiment_id, session"),
    "t6_streamed_scores": SCORING["m25_score_rows"],
    "t7_stream_notifications": oracle("SELECT sub_id, status, COUNT(*) AS n FROM (SELECT experiment_id%4 AS project_id, status FROM result_stream) JOIN (SELECT n_nationkey AS sub_id, n_nationkey%4 AS project_id, n_nationkey%2=0 AS even FROM nation WHERE n_nationkey%5<>0) USING (project_id) WHERE status='failed' OR (even AND status='completed') GROUP BY 1, 2"),
}
ORACLE["t5_lifecycle"] = ORACLE["t5_task_states"]
