"""Scoring of whole runs: a plan made from a benchmark's settings, applied to rows without a shuffle.

A plan says once how outputs are cleaned (by the benchmark's metric and type, the answer policy and the mode), which metrics
are computed with which settings, and how their scores are weighed. Two modes differ in cleaning only:

- `run`: outputs are cut at the first comma for the exact and numeric metrics when one answer is asked for; coding answers are
  the fenced code;
- `recompute`: outputs are cut at the first comma whenever one answer is asked for, and code is cleaned like any text.

White space inside an answer always stays; metrics that ignore it remove it themselves.
"""

from __future__ import annotations

import inspect
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.cleaning import clean_prediction, extract_code, stripped
from scorelake.functions.numbers import ratio, rounded
from scorelake.operators.answers import AnswerSet, answer_set
from scorelake.operators.metrics import METRICS, canonical_expected, guarded, score_reason
from scorelake.sources.storage import stored

# The metrics for which a run cuts outputs at the first comma.
SHORT_ANSWER_METRICS = frozenset(["exact_match", "exact_match_ci", "numeric_match"])
MODES = ("run", "recompute")
#: Differences between stored scores that do not count.
SAME_SCORE = 1e-9


def check_suite(suite: list[dict]) -> list[tuple[str, float, dict]]:
    """(name, weight, config) of a metric suite; ValueError on unknown or repeated names, bad weights and settings."""
    out: list[tuple[str, float, dict]] = []
    for entry in suite:
        if not isinstance(entry, dict) or not isinstance(entry.get("name"), str) or not entry["name"]:
            raise ValueError("every metric of a suite needs a name")
        name, config = entry["name"], entry.get("config") or {}
        if name not in METRICS:
            raise ValueError(f"unknown metric {name}")
        if name in {n for n, _, _ in out}:
            raise ValueError(f"metric {name} is given twice")
        try:
            weight = float(entry.get("weight", 1.0))
        except (TypeError, ValueError) as e:
            raise ValueError(f"weight of {name} is no number") from e
        if not math.isfinite(weight) or weight < 0:
            raise ValueError(f"weight of {name} must be finite and not negative")
        if not isinstance(config, dict):
            raise ValueError(f"config of {name} must be an object")
        out.append((name, weight, config))
    if sum(w for _, w, _ in out) <= 0:
        raise ValueError("a suite needs a positive total weight")
    return out


@dataclass(frozen=True)
class ScoringPlan:
    """metric: the benchmark's metric; suite: weighted metrics with their settings, or none for the metric alone with
    `config`; benchmark_type and policy as the benchmark and the dataset declare them."""

    metric: str
    suite: list[dict] | None = None
    config: dict = field(default_factory=dict)
    benchmark_type: str = "qa"
    policy: dict = field(default_factory=dict)
    mode: str = "run"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.parts()

    def parts(self) -> list[tuple[str, float, dict]]:
        return check_suite(self.suite or [{"name": self.metric, "config": self.config}])

    def label(self) -> str:
        """What a reason calls the score."""
        return "metric_suite" if self.suite and self.mode == "recompute" else self.metric

    def cleaned(self, output: Column) -> Column:
        one_answer = self.policy.get("multi_answer") not in ("all", "set")
        if self.mode == "run" and self.benchmark_type == "coding":
            return extract_code(output)
        cut = one_answer and (self.mode == "recompute" or self.metric in SHORT_ANSWER_METRICS)
        return clean_prediction(output, split_commas=cut, normalize_whitespace=False, strip_units=self.policy.get("strip_units", True))

    def metric_score(self, name: str, config: dict, prediction: Column, answers: AnswerSet, raw: Column | None) -> Column:
        """One metric's guarded score; of the settings it takes those it knows, and a policy of its own."""
        metric = METRICS[name]
        known = {k: v for k, v in config.items() if k in inspect.signature(metric).parameters and k not in ("policy", "raw")}
        return guarded(metric(prediction, answers, config.get("answer_policy", self.policy), raw, **known))


def score_rows(results: DataFrame, plan: ScoringPlan) -> DataFrame:
    """results (output; expected, the canonical answer, or expected_raw, the JSON it is read from, or both; perhaps error)
    with cleaned, score_NAME, score and error_kind. A failed row scores 0: error_kind tells `provider` (it came with an
    error) from `metric` (a metric gave no score in [0, 1])."""
    raw = F.col("expected_raw") if "expected_raw" in results.columns else None
    canonical = F.col("expected") if "expected" in results.columns else canonical_expected(raw)
    out = results.withColumns({"expected": stripped(F.coalesce(canonical, F.lit(""))), "cleaned": plan.cleaned(F.col("output"))})
    # settings with a policy of their own read an answer set of their own
    policies = {name: config.get("answer_policy", plan.policy) for name, _, config in plan.parts()}
    slots = [p for i, p in enumerate(policies.values()) if p not in list(policies.values())[:i]]
    out = out.withColumns({f"answers_{i}": answer_set(F.col("expected"), p, raw).struct() for i, p in enumerate(slots)})
    out = out.withColumns({f"score_{n}": plan.metric_score(n, c, F.col("cleaned"), AnswerSet.of(f"answers_{slots.index(policies[n])}"), raw) for n, _, c in plan.parts()})
    total = sum(w for _, w, _ in plan.parts())
    score = sum((F.col(f"score_{n}") * w for n, w, _ in plan.parts()), F.lit(0.0)) / total
    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in results.columns else F.lit(False)
    kind = F.when(failed, "provider").when(F.col("score").isNull(), "metric")
    scored = out.drop(*(f"answers_{i}" for i in range(len(slots)))).withColumn("score", F.when(~failed, score)).withColumn("error_kind", kind)
    return scored.withColumn("score", F.coalesce("score", F.lit(0.0)))


def reason(plan: ScoringPlan, finish: Column | None = None) -> Column:
    """Why a row that `score_rows` gave has its score."""
    parts = {n: F.col(f"score_{n}") for n, _, _ in plan.parts()}
    return score_reason(plan.label(), F.col("score"), F.col("cleaned"), F.col("expected"), parts if plan.suite else None, finish)


def recomputed(results: DataFrame, plan: ScoringPlan) -> DataFrame:
    """results (experiment_id, row_idx, output, score, expected or expected_raw, error) scored again without a model:
    stored_score, score, cleaned, error_kind and score_reason. They are stored, since filters on a score would else compute it
    again."""
    before = results.withColumn("stored_score", F.coalesce(F.col("score"), F.lit(0.0))).drop("score")
    return stored(score_rows(before, plan)).withColumn("score_reason", reason(plan))


def differences(rescored: DataFrame, limit: int | None = 100) -> DataFrame:
    """The rows of each experiment whose score changed, the first `limit` by row; None: all of them."""
    changed = rescored.where(F.col("error_kind").isNull() & (F.abs(F.col("stored_score") - F.col("score")) > SAME_SCORE))
    if limit is not None:
        changed = changed.withColumn("place", F.row_number().over(Window.partitionBy("experiment_id").orderBy("row_idx"))).where(F.col("place") <= limit)
    return changed.select("experiment_id", "row_idx", "stored_score", F.col("score").alias("recomputed_score"), F.col("cleaned").alias("cleaned_prediction"), F.col("expected").alias("expected_canonical"), "score_reason")


def recompute_report(rescored: DataFrame, experiments: DataFrame, limit: int = 100) -> DataFrame:
    """What a recomputation found for each experiment. experiments: experiment_id, and stored_accuracy and
    dataset_rows_total where they are known. changed_rows is the true count, changed_shown what `differences` shows."""
    scored = F.col("error_kind").isNull()
    changed = scored & (F.abs(F.col("stored_score") - F.col("score")) > SAME_SCORE)
    sums = rescored.groupBy("experiment_id").agg(F.count("*").alias("rows_total"), F.count_if(scored).alias("rows_scored"), F.count_if(~scored).alias("rows_failed"), F.count_if(F.col("error_kind") == "metric").alias("metric_errors"), F.coalesce(F.avg(F.when(scored, F.col("score"))), F.lit(0.0)).alias("recomputed_accuracy"), F.count_if(changed).alias("changed_rows"))
    known = experiments.select("experiment_id", F.coalesce("stored_accuracy", F.lit(0.0)).alias("stored_accuracy"), F.nullif("dataset_rows_total", F.lit(0)).alias("planned"))
    total = F.coalesce("planned", "rows_total")
    out = sums.join(known, "experiment_id", "left").withColumn("dataset_rows_total", total.cast("long")).drop("planned")
    n = F.col("dataset_rows_total")
    return out.select("experiment_id", "rows_total", "dataset_rows_total", "rows_scored", "rows_failed", F.greatest(n - F.col("rows_total"), F.lit(0)).alias("rows_unprocessed"), rounded(ratio(F.col("rows_scored"), n)).alias("coverage"), rounded(ratio(F.col("rows_failed"), n)).alias("failure_rate"), "metric_errors", F.coalesce("stored_accuracy", F.lit(0.0)).alias("stored_accuracy"), rounded(F.col("recomputed_accuracy")).alias("recomputed_accuracy"), "changed_rows", F.least("changed_rows", F.lit(limit)).alias("changed_shown"))
