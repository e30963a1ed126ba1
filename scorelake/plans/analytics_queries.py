"""Queries A1-A36 over the fixture views, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import rounded
from scorelake.operators import analytics as A
from scorelake.operators import pairs as P
from scorelake.operators import stats, summaries
from scorelake.sources.fixtures import oracle, raw, view

CLEAN = "COALESCE(error,'')=''"
WRONG = f"(NOT ({CLEAN}) OR score < 1.0)"


def r6(x: str, digits: int = 6) -> str:
    k = f"CAST({10**digits} AS DOUBLE)"
    return f"FLOOR(({x})*{k}+0.5)/{k}"


SUMMARY = f"""SELECT experiment_id, COUNT(*) AS rows_seen, COUNT(*) FILTER ({CLEAN}) AS rows_scored, COUNT(*) FILTER (NOT ({CLEAN})) AS rows_failed,
 COUNT(*) FILTER (error LIKE 'metric_error%') AS metric_errors, COUNT(*) FILTER (NOT ({CLEAN}) AND error NOT LIKE 'metric_error%') AS provider_errors,
 COUNT(*) FILTER (error LIKE 'rate limited%') AS rate_limited,
 {r6(f"AVG(CASE WHEN {CLEAN} THEN score END)")} AS accuracy, {r6("AVG(latency_ms)")} AS avg_latency_ms, {r6("SUM(cost)")} AS total_cost, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
 COUNT(*) AS rows_total, CAST(0 AS BIGINT) AS rows_unprocessed, {r6(f"COUNT(*) FILTER ({CLEAN})/CAST(COUNT(*) AS DOUBLE)")} AS coverage, {r6(f"COUNT(*) FILTER (NOT ({CLEAN}))/CAST(COUNT(*) AS DOUBLE)")} AS failure_rate
FROM eval_results GROUP BY experiment_id"""
#: The same with the mean of scores as decimals, whose sum does not rest on the order of the rows.
EXACT_SUMMARY = SUMMARY.replace(f"AVG(CASE WHEN {CLEAN} THEN score END)", f"CAST(SUM(CASE WHEN {CLEAN} THEN CAST(score AS DECIMAL(28,9)) END) AS DOUBLE)/COUNT(CASE WHEN {CLEAN} THEN score END)")
BOARD = "SELECT s.*, m.experiment_name AS name, m.experiment_name, m.model_id, m.provider, m.organization_id, m.dataset_id, m.dataset_version, m.benchmark_id FROM summary s LEFT JOIN models m USING (experiment_id)"
COHORT = "dataset_id, dataset_version, benchmark_id"
DIMS = "accuracy, avg_latency_ms, total_cost, total_tokens, coverage, failure_rate"


def _summary(s: SparkSession, d: str) -> DataFrame:
    return summaries.run_summary(view(s, d, "eval_results"))


def _board(s: SparkSession, d: str) -> DataFrame:
    return A.leaderboard(_summary(s, d), view(s, d, "models"))


def _full(s: SparkSession, d: str) -> DataFrame:
    return _summary(s, d).join(view(s, d, "models"), "experiment_id", "left")


def a1_run_summary(s, d):
    return _summary(s, d)


def a2_run_status(s, d):
    return summaries.with_status(_summary(s, d)).select("experiment_id", "rate_limited", "rows_failed", "status")


def a3_metric_means(s, d):
    one = view(s, d, "eval_results").where(summaries.is_clean())
    long = one.select("experiment_id", F.explode(F.array(F.struct(F.lit("exact").alias("metric"), F.floor("score").cast("double").alias("score")), F.struct(F.lit("graded").alias("metric"), F.col("score")))).alias("m")).select("experiment_id", "m.*")
    return summaries.metric_means(long)


def a4_normalized_blobs(s, d):
    text = F.when(F.col("event_id") % 3 == 0, F.format_string('{"rows_total": %d, "rows_scored": %d}', F.col("event_id") % 97 + 3, F.col("event_id") % 3)).when(F.col("event_id") % 3 == 1, F.format_string('{"rows_total": %d, "coverage": 0.5}', (F.col("event_id") % 50) * 2 + 2)).otherwise(F.format_string('{"rows_total": %d}', F.col("event_id") % 40))
    return summaries.normalized_blob(raw(s, d, "events").select("event_id", text.alias("metrics"))).drop("metrics")


def _stored(s, d):
    """Summaries as experiments store them: some runs unfinished, some accuracies in the blob only."""
    e = F.col("experiment_id")
    status = F.when(e % 5 == 0, "running").when(e % 5 == 1, "partial").when(e % 11 == 3, "failed").otherwise("completed")
    return _summary(s, d).withColumns({"status": status, "accuracy": F.when(e % 7 == 0, F.lit(0.0)).otherwise(F.col("accuracy")), "metrics": F.format_string('{"accuracy": 0.%d}', e % 10)})


def a5_leaderboard(s, d):
    return A.leaderboard(_stored(s, d), view(s, d, "models"), 50)


def a6_leaderboard_intervals(s, d):
    return _board(s, d).join(stats.bootstrap_means(view(s, d, "eval_results").where(summaries.is_clean()), resamples=500), "experiment_id").select("experiment_id", *A.COHORT, "accuracy", "ci_low", "ci_high")


def a7_cohort_rank(s, d):
    return A.ranked(_board(s, d)).select("experiment_id", *A.COHORT, "accuracy", "total_cost", "rank_in_cohort")


def a8_comparable_pairs(s, d):
    m = view(s, d, "models").select("experiment_id", *A.COHORT)
    a = m.select(F.col("experiment_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in A.COHORT])
    b = m.select((F.col("experiment_id") - 1).alias("a"), F.col("experiment_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in A.COHORT])
    return A.mismatched_fields(a.join(b, "a")).select("a", "b", "mismatched", "comparable")


def a9_compare_dimensions(s, d):
    return A.compared(_board(s, d))


def a9_compare_wide(s, d):
    picked = _board(s, d).where("dataset_id = 0 AND dataset_version = 1")
    wide = A.compared_wide(picked)
    return wide.select("dimension", F.array_join(F.transform("experiments", lambda x: x.cast("string")), ",").alias("experiments"), rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 3).alias("total"))


def a10_failure_cases(s, d):
    return A.failure_cases(view(s, d, "eval_results"), 5).select("experiment_id", "row_idx", "score", "error", "place")


def a10_shown_cases(s, d):
    """Failure cases with their inputs and outputs, redacted."""
    rows = view(s, d, "dataset_rows").select("row_idx", F.to_json(F.struct("question", F.concat(F.lit("mail a.b@c.org, "), F.col("answer")).alias("note"))).alias("input"), F.to_json(F.struct("answer")).alias("expected"), F.concat(F.col("category"), F.lit(" 13912345678")).alias("output"))
    cases = A.failure_cases(view(s, d, "eval_results"), 3).join(rows, "row_idx")
    return A.redacted_cases(cases, ["answer"]).select("experiment_id", "row_idx", "input", "expected", "output", "place")


def a11_trend(s, d):
    last = view(s, d, "eval_results").groupBy("experiment_id").agg(F.max("created_at").cast("date").alias("created_at"))
    return A.trend(_board(s, d).join(last, "experiment_id")).select("model_id", "experiment_id", "created_at", "accuracy", "accuracy_delta")


def a12_project_summary(s, d):
    return A.project_summary(_full(s, d), "organization_id")


def a13_subgroups(s, d):
    return A.subgroups(view(s, d, "eval_results"), view(s, d, "dataset_rows"), "category")


def a14_bootstrap_intervals(s, d):
    return stats.bootstrap_means(view(s, d, "eval_results").where(summaries.is_clean()))


def _clean(s, d):
    return view(s, d, "eval_results").where(summaries.is_clean())


def _first_pairs(s, d):
    """The first pair of each cohort."""
    return A.first_pairs(view(s, d, "models"))


def a15_paired_bootstrap(s, d):
    counts, most = P.bounded_score_pairs(_clean(s, d), view(s, d, "models"))
    return stats.paired_bootstrap(counts, most=most)


def a16_mcnemar_corrected(s, d):
    return stats.mcnemar_corrected(P.discordants(_clean(s, d), view(s, d, "models"))).select("a", "b", "only_a", "only_b", "chi2")


def a17_mcnemar_exact(s, d):
    return stats.mcnemar_exact(P.discordants(_clean(s, d), view(s, d, "models"))).withColumn("p_value", rounded(F.col("p_value"), 9))


def a18_wilson_interval(s, d):
    return stats.wilson(_summary(s, d).join(view(s, d, "eval_results").groupBy("experiment_id").agg(F.count_if(summaries.is_clean() & (F.col("score") >= 1)).alias("passed")), "experiment_id").select("experiment_id", "passed", F.col("rows_scored").alias("n")))


def _significance(s, d, wanted=None, **given):
    counts, most = P.bounded_score_pairs(_clean(s, d), view(s, d, "models"), wanted)
    return stats.significance(counts, most=most, **given)


def a20_cohort_significance(s, d):
    return _significance(s, d)


def _facts(report):
    sums = [rounded(F.col(c) * F.col("n"), 3).alias(s) for c, s in (("a_mean", "sum_a"), ("b_mean", "sum_b"), ("diff", "sum_diff"))]
    return report.select("a", "b", "n", *sums, "only_a", "only_b", rounded(F.col("chi2")).alias("chi2"), "mcnemar_significant")


def a20_cohort_facts(s, d):
    """What of the reports of all pairs does not rest on draws."""
    return _facts(_significance(s, d, resamples=50))


def a19_pair_facts(s, d):
    return _facts(_significance(s, d, _first_pairs(s, d), resamples=50))


def a19_pair_significance(s, d):
    return _significance(s, d, _first_pairs(s, d))


def a21_failure_diff(s, d):
    return P.failure_diff(view(s, d, "eval_results").withColumn("wrong", A.is_failure()), view(s, d, "models"))


def a22_model_routing(s, d):
    return A.model_routing(_full(s, d).withColumn("cost_unknown", F.col("model_id") % 4 == 1), 0.4, 20)


def a24_judge_calibration(s, d):
    return stats.calibration(view(s, d, "judge_labels"), "gold", "judge_a")


def a25_judge_agreement(s, d):
    return stats.agreement(view(s, d, "judge_labels"), "judge_a", "judge_b")


def a26_by_provider(s, d):
    return A.by_provider(_board(s, d))


def a27_status_counts(s, d):
    return summaries.with_status(_summary(s, d)).groupBy("status").agg(F.count("*").alias("n"))


def a28_top_models(s, d):
    return A.top_models(_board(s, d), 5)


def a28_accuracy_series(s, d):
    last = view(s, d, "eval_results").groupBy("experiment_id").agg(F.max("created_at").cast("date").alias("created_at"))
    return A.accuracy_series(_board(s, d).join(last, "experiment_id"))


def _spend(s, d):
    costs = raw(s, d, "orders").join(raw(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("organization_id"), F.col("o_orderdate").alias("created_at"), F.floor(F.col("o_totalprice")).cast("double").alias("cost"))
    budgets = raw(s, d, "nation").select(F.col("n_nationkey").alias("organization_id"), (F.col("n_nationkey") * 100000).cast("double").alias("budget"))
    return costs, budgets


def a29_running_spend(s, d):
    return A.running_spend(*_spend(s, d))


def a29_monthly_budget(s, d):
    costs = raw(s, d, "orders").join(raw(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("organization_id"), F.col("o_orderdate").alias("created_at"), F.floor(F.col("o_totalprice")).cast("double").alias("cost"))
    budgets = raw(s, d, "nation").select(F.col("n_nationkey").alias("organization_id"), (F.col("n_nationkey") * 100000).cast("double").alias("budget"))
    return A.monthly_budget(costs, budgets)


def a30_regression_gate(s, d):
    board = _board(s, d)
    return A.regressions(board, board.groupBy("model_id").agg(F.max("accuracy").alias("baseline")), 0.05).select("experiment_id", "model_id", "accuracy", "baseline")


def a31_report_facts(s, d):
    return A.report_facts(view(s, d, "eval_results"), _summary(s, d))


def a33_result_matrix(s, d):
    return A.result_matrix(_board(s, d), [0, 1, 2])


def a34_first_wrong_samples(s, d):
    bad = view(s, d, "eval_results").where(A.is_failure()).join(view(s, d, "models"), "experiment_id")
    from pyspark.sql import Window

    order = Window.partitionBy("model_id", "dataset_id").orderBy("row_idx", "experiment_id")
    return bad.withColumn("place", F.row_number().over(order)).where("place <= 20").select("model_id", "dataset_id", "experiment_id", "row_idx", "score", "place")


def a35_filtered_page(s, d):
    last = view(s, d, "eval_results").groupBy("experiment_id").agg(F.max("created_at").cast("date").alias("created_at"))
    return A.listed(_full(s, d).join(last, "experiment_id"), {"benchmark_id": 1, "dataset_id": ""}, "supplier", 5, 10).select("experiment_id", "experiment_name", "accuracy", "created_at", "total")


def a36_missing_work(s, d):
    m = view(s, d, "models")
    plan = m.select("model_id").distinct().crossJoin(F.broadcast(m.select("dataset_id").distinct()))
    return A.missing_work(plan, m.select("model_id", "dataset_id"), ["model_id", "dataset_id"])


PAIRED = f"SELECT p.a, p.b, x.row_idx, x.score AS score_a, y.score AS score_b FROM pairs p JOIN eval_results x ON x.experiment_id=p.a JOIN eval_results y ON y.experiment_id=p.b AND y.row_idx=x.row_idx WHERE COALESCE(x.error,'')='' AND COALESCE(y.error,'')=''"
PAIRS = "SELECT x.experiment_id AS a, y.experiment_id AS b FROM models x JOIN models y USING (dataset_id, dataset_version, benchmark_id) WHERE x.experiment_id < y.experiment_id"
DISCORDANT = "SELECT a, b, COUNT(*) FILTER (score_a>=1 AND score_b<1) AS only_a, COUNT(*) FILTER (score_b>=1 AND score_a<1) AS only_b FROM paired GROUP BY a, b"
PAIR_FACTS = f"SELECT a, b, n, {r6('ma', 3)} AS sum_a, {r6('mb', 3)} AS sum_b, {r6('ma-mb', 3)} AS sum_diff, only_a, only_b, chi2, chi2 > 3.841458820694124 AS mcnemar_significant FROM (SELECT *, CASE WHEN only_a+only_b=0 THEN 0.0 ELSE {r6('POWER(ABS(only_a-only_b)-1,2)/CAST(only_a+only_b AS DOUBLE)')} END AS chi2 FROM (SELECT a, b, COUNT(*) AS n, SUM(score_a) AS ma, SUM(score_b) AS mb, COUNT(*) FILTER (score_a>=1 AND score_b<1) AS only_a, COUNT(*) FILTER (score_b>=1 AND score_a<1) AS only_b FROM paired GROUP BY a, b))"
FIRST_PAIRS = f"SELECT (p).a AS a, (p).b AS b FROM (SELECT MIN({{'a': x.experiment_id, 'b': y.experiment_id}}) AS p FROM models x JOIN models y USING ({COHORT}) WHERE x.experiment_id < y.experiment_id GROUP BY {COHORT})"
Z = 1.959963984540054


def _board_sql(sql: str, **more: str) -> str:
    return oracle(sql, summary=SUMMARY, board=BOARD, **more)


STATUS = "CASE WHEN rate_limited>0 THEN 'failed' WHEN rows_failed>0 THEN 'partial' ELSE 'completed' END"
ORACLE = {
    "a1_run_summary": oracle(SUMMARY),
    "a2_run_status": oracle(f"SELECT experiment_id, rate_limited, rows_failed, {STATUS} AS status FROM summary", summary=SUMMARY),
    "a3_metric_means": oracle(f"SELECT experiment_id, metric, {r6('AVG(v)')} AS mean_score, COUNT(*) AS n FROM (SELECT experiment_id, 'exact' AS metric, FLOOR(score) AS v FROM eval_results WHERE {CLEAN} UNION ALL SELECT experiment_id, 'graded', score FROM eval_results WHERE {CLEAN}) GROUP BY 1, 2"),
    "a4_normalized_blobs": f"SELECT event_id, t AS rows_total, sc AS rows_scored, t-sc AS rows_failed, CASE WHEN t=0 THEN 0.0 ELSE {r6('sc/CAST(t AS DOUBLE)')} END AS coverage, CASE WHEN t=0 THEN 0.0 ELSE {r6('(t-sc)/CAST(t AS DOUBLE)')} END AS failure_rate FROM (SELECT event_id, CASE event_id%3 WHEN 0 THEN event_id%97+3 WHEN 1 THEN (event_id%50)*2+2 ELSE event_id%40 END AS t, CASE event_id%3 WHEN 0 THEN event_id%3 WHEN 1 THEN event_id%50+1 ELSE event_id%40 END AS sc FROM events)",
    "a5_leaderboard": _board_sql(f"SELECT experiment_id, name, model_id, provider, {COHORT}, shown AS accuracy, {DIMS.split(', ', 1)[1]} FROM (SELECT *, CASE WHEN experiment_id%7=0 OR accuracy=0 THEN (experiment_id%10)/10.0 ELSE accuracy END AS shown FROM board WHERE experiment_id%5=1 OR (experiment_id%5<>0 AND experiment_id%11<>3)) ORDER BY {COHORT}, shown DESC, total_cost, experiment_id LIMIT 50"),
    "a10_shown_cases": oracle(f"SELECT experiment_id, row_idx, '{{\"question\":\"' || question || '\",\"note\":\"mail [REDACTED], ' || answer || '\"}}' AS input, '{{\"answer\":\"[REDACTED]\"}}' AS expected, category || ' [REDACTED]' AS output, place FROM (SELECT experiment_id, row_idx, CAST(ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY score NULLS FIRST, row_idx) AS INT) AS place FROM eval_results WHERE {WRONG}) JOIN dataset_rows USING (row_idx) WHERE place<=3"),
    "a7_cohort_rank": oracle(f"SELECT experiment_id, {COHORT}, accuracy, total_cost, CAST(RANK() OVER (PARTITION BY {COHORT} ORDER BY accuracy DESC NULLS LAST, total_cost) AS INT) AS rank_in_cohort FROM board", summary=EXACT_SUMMARY, board=BOARD),
    "a8_comparable_pairs": oracle("SELECT a, b, mismatched, mismatched='' AS comparable FROM (SELECT x.experiment_id AS a, y.experiment_id AS b, CONCAT_WS(',', CASE WHEN x.dataset_id<>y.dataset_id THEN 'dataset_id' END, CASE WHEN x.dataset_version<>y.dataset_version THEN 'dataset_version' END, CASE WHEN x.benchmark_id<>y.benchmark_id THEN 'benchmark_id' END) AS mismatched FROM models x JOIN models y ON y.experiment_id=x.experiment_id+1)"),
    "a9_compare_dimensions": _board_sql(" UNION ALL ".join(f"SELECT experiment_id, '{x.strip()}' AS dimension, CAST({x} AS DOUBLE) AS value FROM board" for x in DIMS.split(","))),
    "a9_compare_wide": _board_sql("SELECT dimension, STRING_AGG(CAST(experiment_id AS VARCHAR), ',' ORDER BY experiment_id) AS experiments, FLOOR(SUM(COALESCE(value, 0))*1000+0.5)/1000 AS total FROM (" + " UNION ALL ".join(f"SELECT experiment_id, '{x.strip()}' AS dimension, CAST({x} AS DOUBLE) AS value FROM board WHERE dataset_id=0 AND dataset_version=1" for x in DIMS.split(",")) + ") GROUP BY 1"),
    "a10_failure_cases": oracle(f"SELECT * FROM (SELECT experiment_id, row_idx, score, error, CAST(ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY score NULLS FIRST, row_idx) AS INT) AS place FROM eval_results WHERE {WRONG}) WHERE place<=5"),
    "a11_trend": _board_sql(f"SELECT model_id, b.experiment_id, created_at, accuracy, {r6('accuracy - LAG(accuracy) OVER (PARTITION BY model_id ORDER BY created_at, b.experiment_id)')} AS accuracy_delta FROM board b JOIN last_day l ON l.experiment_id=b.experiment_id", last_day="SELECT experiment_id, CAST(MAX(created_at) AS DATE) AS created_at FROM eval_results GROUP BY 1"),
    "a12_project_summary": _board_sql(f"SELECT organization_id, COUNT(*) AS runs, COUNT(*) FILTER (rows_failed=0) AS clean_runs, {r6('AVG(accuracy)')} AS avg_accuracy, {r6('SUM(total_cost)')} AS sum_cost, CAST(SUM(total_tokens) AS BIGINT) AS sum_tokens, {r6('SUM(rows_scored)/CAST(SUM(rows_total) AS DOUBLE)')} AS pooled_coverage, {r6('SUM(rows_failed)/CAST(SUM(rows_total) AS DOUBLE)')} AS pooled_failure_rate, ARG_MAX(experiment_id, accuracy*1e6 - experiment_id/1e6) AS best_experiment FROM board GROUP BY 1"),
    "a13_subgroups": oracle(f"SELECT CASE WHEN TRIM(COALESCE(category,''))='' THEN '(unlabelled)' ELSE category END AS subgroup, COUNT(*) AS n_rows, {r6(f'AVG(CASE WHEN {CLEAN} THEN score END)')} AS avg_score, COUNT(*) FILTER ({CLEAN} AND score>=1) AS n_pass, COUNT(*) FILTER ({CLEAN} AND score<1) AS n_fail, COUNT(*) FILTER (NOT ({CLEAN})) AS n_error FROM eval_results LEFT JOIN dataset_rows USING (row_idx) GROUP BY 1"),
    "a16_mcnemar_corrected": oracle("SELECT a, b, only_a, only_b, CASE WHEN only_a+only_b=0 THEN 0.0 ELSE FLOOR(POWER(ABS(only_a-only_b)-1,2)/CAST(only_a+only_b AS DOUBLE)*1000000+0.5)/1000000 END AS chi2 FROM d", pairs=PAIRS, paired=PAIRED, d=DISCORDANT),
    "a17_mcnemar_exact": oracle(f"SELECT a, b, only_a, only_b, {r6('LEAST(1.0, 2*LIST_SUM(LIST_TRANSFORM(RANGE(0, LEAST(only_a, only_b)+1), lambda i: EXP(LGAMMA(only_a+only_b+1)-LGAMMA(i+1)-LGAMMA(only_a+only_b-i+1)-(only_a+only_b)*LN(2)))))', 9)} AS p_value FROM d", pairs=PAIRS, paired=PAIRED, d=DISCORDANT),
    "a20_cohort_facts": oracle(PAIR_FACTS, pairs=PAIRS, paired=PAIRED),
    "a19_pair_facts": oracle(PAIR_FACTS, pairs=FIRST_PAIRS, paired=PAIRED),
    "a18_wilson_interval": oracle(f"SELECT experiment_id, passed, n, {r6(f'(p+{Z*Z}/(2*n))/(1+{Z*Z}/n) - {Z}*SQRT(p*(1-p)/n+{Z*Z}/(4.0*n*n))/(1+{Z*Z}/n)')} AS low, {r6(f'(p+{Z*Z}/(2*n))/(1+{Z*Z}/n) + {Z}*SQRT(p*(1-p)/n+{Z*Z}/(4.0*n*n))/(1+{Z*Z}/n)')} AS high FROM (SELECT experiment_id, COUNT(*) FILTER ({CLEAN} AND score>=1) AS passed, COUNT(*) FILTER ({CLEAN}) AS n, COUNT(*) FILTER ({CLEAN} AND score>=1)/CAST(COUNT(*) FILTER ({CLEAN}) AS DOUBLE) AS p FROM eval_results GROUP BY 1)"),
    "a21_failure_diff": oracle("SELECT a, b, COUNT(*) AS shared_rows, COUNT(*) FILTER (x.w AND NOT y.w) AS a_only_wrong, COUNT(*) FILTER (y.w AND NOT x.w) AS b_only_wrong, COUNT(*) FILTER (x.w AND y.w) AS both_wrong FROM pairs JOIN marked x ON x.experiment_id=a JOIN marked y ON y.experiment_id=b AND y.row_idx=x.row_idx GROUP BY a, b", pairs=PAIRS, marked=f"SELECT experiment_id, row_idx, {WRONG} AS w FROM eval_results"),
    "a22_model_routing": _board_sql(f"SELECT model_id, experiment_id, accuracy, cost_per_row, unknown AS cost_unknown, qualified, CAST(ROW_NUMBER() OVER w AS INT) AS route_rank, qualified AND ROW_NUMBER() OVER w = 1 AS recommended FROM (SELECT model_id, experiment_id, accuracy, {r6('total_cost/CAST(rows_total AS DOUBLE)', 9)} AS cost_per_row, model_id%4=1 AS unknown, accuracy>=0.4 AS qualified, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY accuracy DESC, experiment_id) AS r FROM board JOIN top USING ({COHORT})) WHERE r=1 WINDOW w AS (ORDER BY qualified DESC, CASE WHEN qualified THEN unknown END NULLS FIRST, CASE WHEN qualified THEN cost_per_row END NULLS FIRST, accuracy DESC, model_id) ORDER BY route_rank LIMIT 20", top=f"SELECT {COHORT} FROM board GROUP BY {COHORT} ORDER BY COUNT(*) DESC, {COHORT} LIMIT 1"),
    "a24_judge_calibration": oracle(f"SELECT tp, fp, fn, tn, {r6('(tp+tn)/CAST(tp+fp+fn+tn AS DOUBLE)')} AS accuracy, {r6('tp/CAST(tp+fp AS DOUBLE)')} AS precision, {r6('tp/CAST(tp+fn AS DOUBLE)')} AS recall, {r6('2.0*tp/(2*tp+fp+fn)')} AS f1 FROM (SELECT COUNT(*) FILTER (gold=1 AND judge_a=1) AS tp, COUNT(*) FILTER (gold=0 AND judge_a=1) AS fp, COUNT(*) FILTER (gold=1 AND judge_a=0) AS fn, COUNT(*) FILTER (gold=0 AND judge_a=0) AS tn FROM judge_labels)"),
    "a25_judge_agreement": oracle(f"SELECT n, {r6('po')} AS agreement, {r6('(po-pe)/(1-pe)')} AS kappa FROM (SELECT COUNT(*) AS n, AVG(CASE WHEN judge_a=judge_b THEN 1.0 ELSE 0.0 END) AS po, AVG(CAST(judge_a AS DOUBLE))*AVG(CAST(judge_b AS DOUBLE))+(1-AVG(CAST(judge_a AS DOUBLE)))*(1-AVG(CAST(judge_b AS DOUBLE))) AS pe FROM judge_labels)"),
    "a26_by_provider": _board_sql(f"SELECT provider, COUNT(*) AS runs, COUNT(DISTINCT model_id) AS models, {r6('AVG(accuracy)')} AS avg_accuracy, {r6('SUM(total_cost)')} AS sum_cost FROM board GROUP BY 1"),
    "a27_status_counts": oracle(f"SELECT {STATUS} AS status, COUNT(*) AS n FROM summary GROUP BY 1", summary=SUMMARY),
    "a28_top_models": _board_sql("SELECT model_id, MAX(accuracy) AS best_accuracy FROM board GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "a29_monthly_budget": f"SELECT organization_id, month, month_cost, unknown_costs, CAST(organization_id*100000 AS DOUBLE) AS budget, month_cost>=organization_id*100000 OR unknown_costs>0 AS exhausted FROM (SELECT c_nationkey AS organization_id, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, {r6('SUM(FLOOR(o_totalprice))')} AS month_cost, CAST(0 AS BIGINT) AS unknown_costs FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2)",
    "a28_accuracy_series": _board_sql(f"SELECT model_id, created_at, b.experiment_id, accuracy, {r6('AVG(accuracy) OVER (PARTITION BY model_id ORDER BY created_at, b.experiment_id ROWS UNBOUNDED PRECEDING)')} AS running_accuracy FROM board b JOIN last_day l ON l.experiment_id=b.experiment_id", last_day="SELECT experiment_id, CAST(MAX(created_at) AS DATE) AS created_at FROM eval_results GROUP BY 1"),
    "a29_running_spend": "SELECT organization_id, day, day_cost, spent, CAST(organization_id*100000 AS DOUBLE) AS budget, spent>=organization_id*100000 AS exhausted FROM (SELECT *, SUM(day_cost) OVER (PARTITION BY organization_id, DATE_TRUNC('month', day) ORDER BY day) AS spent FROM (SELECT c_nationkey AS organization_id, CAST(o_orderdate AS DATE) AS day, SUM(FLOOR(o_totalprice)) AS day_cost FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2))",
    "a30_regression_gate": _board_sql("SELECT experiment_id, model_id, accuracy, baseline FROM (SELECT *, MAX(accuracy) OVER (PARTITION BY model_id) AS baseline FROM board) WHERE accuracy < baseline - 0.05"),
    "a31_report_facts": oracle(f"SELECT experiment_id, accuracy, total_cost, rows_total, COALESCE(failure_count, 0) AS failure_count, first_failures FROM summary LEFT JOIN (SELECT experiment_id, MAX(n) AS failure_count, STRING_AGG(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx) FILTER (place<=5) AS first_failures FROM (SELECT experiment_id, row_idx, COUNT(*) OVER (PARTITION BY experiment_id) AS n, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY row_idx) AS place FROM eval_results WHERE {WRONG}) GROUP BY 1) USING (experiment_id)", summary=SUMMARY),
    "a33_result_matrix": _board_sql("SELECT model_id, MAX(accuracy) FILTER (dataset_id=0) AS dataset_0, MAX(accuracy) FILTER (dataset_id=1) AS dataset_1, MAX(accuracy) FILTER (dataset_id=2) AS dataset_2 FROM board GROUP BY 1"),
    "a34_first_wrong_samples": oracle(f"SELECT * FROM (SELECT model_id, dataset_id, experiment_id, row_idx, score, CAST(ROW_NUMBER() OVER (PARTITION BY model_id, dataset_id ORDER BY row_idx, experiment_id) AS INT) AS place FROM eval_results JOIN models USING (experiment_id) WHERE {WRONG}) WHERE place<=20"),
    "a35_filtered_page": _board_sql("SELECT b.experiment_id, experiment_name, accuracy, created_at, COUNT(*) OVER () AS total FROM board b JOIN last_day l ON l.experiment_id=b.experiment_id WHERE benchmark_id=1 AND experiment_name ILIKE '%supplier%' ORDER BY created_at DESC, b.experiment_id DESC LIMIT 10 OFFSET 5", last_day="SELECT experiment_id, CAST(MAX(created_at) AS DATE) AS created_at FROM eval_results GROUP BY 1"),
    "a36_missing_work": oracle("SELECT model_id, dataset_id FROM (SELECT DISTINCT model_id FROM models) CROSS JOIN (SELECT DISTINCT dataset_id FROM models) EXCEPT SELECT model_id, dataset_id FROM models"),
}
