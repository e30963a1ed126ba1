"""Run summaries: one row per experiment from its row scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import exact_mean, ratio, rounded


def is_clean(error: str = "error") -> Column:
    """Whether a result row carries no error; an empty error text counts as none."""
    return F.coalesce(F.col(error), F.lit("")) == ""


def run_summary(results: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Accuracy, latency, cost and error counts per experiment.

    planned: (experiment_id, rows_total) where the plan is known; else the rows at hand are the plan. Partial
    aggregation keeps one huge experiment from landing in one task.
    """
    clean = is_clean()
    out = results.groupBy("experiment_id").agg(
        F.count("*").alias("rows_seen"),
        F.count_if(clean).alias("rows_scored"),
        F.count_if(~clean).alias("rows_failed"),
        F.count_if(F.col("error").startswith("metric_error")).alias("metric_errors"),
        F.count_if(~clean & ~F.col("error").startswith("metric_error")).alias("provider_errors"),
        F.count_if(F.col("error").startswith("rate limited")).alias("rate_limited"),
        rounded(exact_mean(F.when(clean, F.col("score")))).alias("accuracy"),
        rounded(F.avg("latency_ms")).alias("avg_latency_ms"),
        rounded(F.sum("cost")).alias("total_cost"),
        F.sum("tokens").alias("total_tokens"),
    )
    total = F.col("rows_seen")
    if planned is not None:
        out = out.join(planned, "experiment_id", "left")
        total = F.coalesce("rows_total", "rows_seen")
    return out.withColumns({
        "rows_total": total,
        "rows_unprocessed": F.greatest(total - F.col("rows_seen"), F.lit(0)),
        "coverage": rounded(ratio(F.col("rows_scored"), total)),
        "failure_rate": rounded(ratio(F.col("rows_failed"), total)),
    })


def with_status(summary: DataFrame) -> DataFrame:
    """failed if any row was refused for rate limits, partial if any row failed otherwise, else completed."""
    return summary.withColumn("status", F.when(F.col("rate_limited") > 0, "failed").when(F.col("rows_failed") > 0, "partial").otherwise("completed"))


def metric_means(scores: DataFrame) -> DataFrame:
    """(experiment_id, metric, mean_score, n) of long rows (experiment_id, metric, score); null scores do not count."""
    return scores.where("score IS NOT NULL").groupBy("experiment_id", "metric").agg(rounded(F.avg("score")).alias("mean_score"), F.count("*").alias("n"))


def normalized_blob(experiments: DataFrame, blob: str = "metrics") -> DataFrame:
    """Typed fields of old and new metric blobs: scored rows from the field, else from coverage, else all rows."""
    number = lambda key: F.get_json_object(blob, f"$.{key}").try_cast("double")
    total = F.coalesce(number("rows_total"), F.lit(0.0))
    scored = F.coalesce(number("rows_scored"), F.bround(total * number("coverage")), total)
    failed = F.coalesce(number("rows_failed"), F.bround(total * number("failure_rate")), total - scored)
    return experiments.withColumns({"rows_total": total.cast("long"), "rows_scored": scored.cast("long"), "rows_failed": failed.cast("long"), "coverage": rounded(ratio(scored, total)), "failure_rate": rounded(ratio(failed, total))})
