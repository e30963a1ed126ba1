"""Queries of whole runs: canonical answers, prompts, inference, judges, tool calls, contracts and repair, with oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scorelake.functions.numbers import rounded
from scorelake.functions.vectorized import redacted_json
from scorelake.operators import datasets as D
from scorelake.operators import governance as G
from scorelake.operators import inference as I
from scorelake.operators import judges as J
from scorelake.operators import metrics as M
from scorelake.operators import scoring as S
from scorelake.operators import prompts as P
from scorelake.operators import repair as R
from scorelake.operators import summaries
from scorelake.plans.analytics_queries import r6
from scorelake.plans.dataset_queries import ROWS, _rows
from scorelake.plans.scoring_queries import SQUEEZED
from scorelake.sources.fixtures import oracle, raw, view
from scorelake.sources.storage import spread


def _expected(s, d):
    """Expected objects of six shapes over the parts: flat, list, nested, number, other key, empty."""
    shapes = [
        F.to_json(F.struct("category", F.col("answer"))),
        F.to_json(F.struct(F.array(F.lit(""), F.col("answer"), F.col("category")).alias("label"))),
        F.to_json(F.struct(F.struct(F.col("size"), F.struct(F.col("answer").alias("value")).alias("text")).alias("target"))),
        F.to_json(F.struct(F.col("size").alias("answer"))),
        F.to_json(F.struct(F.col("category").alias("result"), F.col("question"))),
        F.lit("{}"),
    ]
    picked = shapes[5]
    for i, x in enumerate(shapes[:5]):
        picked = F.when(F.col("row_idx") % 6 == i, x).otherwise(picked)
    return view(s, d, "dataset_rows").withColumn("expected", picked)


def m1_canonical_expected(s, d):
    return _expected(s, d).select("row_idx", M.canonical_expected(F.col("expected")).alias("answer"))


def m15_tool_call(s, d):
    call = F.to_json(F.struct(F.col("category").alias("name"), F.struct("question", "size").alias("arguments")))
    short = F.to_json(F.struct(F.struct(F.col("category").alias("name")).alias("function"), F.to_json(F.struct("size")).alias("parameters")))
    said = F.when(F.col("row_idx") % 5 == 0, call).when(F.col("row_idx") % 5 == 1, F.concat(F.lit("I call it:\n```json\n"), call, F.lit("\n```"))).when(F.col("row_idx") % 5 == 2, short).when(F.col("row_idx") % 5 == 3, F.concat(F.lit("so "), F.regexp_replace(call, "Brand", "Other"), F.lit(" it is"))).otherwise("no call")
    wanted = F.to_json(F.struct(F.struct(F.lit("text").alias("question"), F.lit(1).alias("size")).alias("arguments")))
    return view(s, d, "dataset_rows").select("row_idx", M.tool_call(said, F.col("category"), raw=wanted).alias("score"))


def _judged(s, d):
    pairs = view(s, d, "dataset_rows").select("row_idx", F.lower("category").alias("prediction"), F.when(F.col("row_idx") % 3 == 0, F.col("category")).otherwise(F.lit("Brand#11")).alias("expected"))
    return pairs


def _offline_judge(asked):
    """A judge that compares what stands in its question, case apart."""
    expected, got = F.regexp_extract("prompt", r"Expected: (.*)\n", 1), F.regexp_extract("prompt", r"Prediction: (.*)\n", 1)
    return asked.select("judge_key", F.when(F.lower(expected) == F.lower(got), "match").otherwise("No_Match").alias("answer"))


def m18_judged_once(s, d):
    rows = _judged(s, d)
    _, cache = J.judged_once(rows.where("row_idx % 2 = 0"), _offline_judge, "m", "p")
    out, _ = J.judged_once(rows, _offline_judge, "m", "p", cache=cache)
    return out.select("row_idx", "judge_score")


def m19_rubric_scores(s, d):
    dims = J.rubric([{"name": "Correctness"}, {"name": "full coverage", "weight": 3}])
    a, b = (F.col("row_idx") % 6).cast("string"), (F.col("row_idx") % 4).cast("string")
    said = F.when(F.col("row_idx") % 5 == 0, F.concat(F.lit('```json\n{"scores": {"correctness": '), a, F.lit(', "full_coverage": '), b, F.lit("}}\n```"))).when(F.col("row_idx") % 5 == 1, F.concat(F.lit('{"full_coverage": "'), b, F.lit('"}'))).when(F.col("row_idx") % 5 == 2, F.concat(F.lit("correctness: "), a, F.lit(" of 5\nfull_coverage = "), b)).when(F.col("row_idx") % 5 == 3, "no points").otherwise('{"scores": broken} correctness: 9')
    found = J.rubric_scores(said, dims, 5)
    return view(s, d, "dataset_rows").select("row_idx", found.alias("r")).select("row_idx", rounded(F.col("r.correctness")).alias("correctness"), rounded(F.col("r.full_coverage")).alias("coverage"), rounded(F.col("r.total")).alias("total"))


def m20_judge_prompts(s, d):
    long = F.concat(F.col("question"), F.repeat(F.lit("x"), 2500))
    return view(s, d, "dataset_rows").select("row_idx", J.judge_prompt("qa", F.col("answer"), long).alias("judge"), J.rubric_prompt(J.rubric(None, "coding"), 5, F.col("answer"), long).alias("rubric"))


def p3_missing_paths(s, d):
    rows = view(s, d, "dataset_rows").select("row_idx", F.to_json(F.struct("question", F.when(F.col("row_idx") % 2 == 0, F.struct("size")).alias("more"))).alias("input"))
    return rows.select("row_idx", P.rendered_or_dumped("{question}/{more.size}{none}", F.col("input")).alias("prompt"))


def p6_structured_chains(s, d):
    role = F.when(F.col("row_idx") % 9 == 0, "robot").otherwise("assistant")
    source = F.to_json(F.struct(F.array(F.struct(role.alias("role"), F.col("category").alias("content"))).alias("messages"), F.when(F.col("row_idx") % 2 == 0, F.array(F.struct(F.col("answer").alias("question"), F.col("size").cast("string").alias("answer")))).alias("examples"), F.col("question").alias("question")))
    chain = P.message_chain("Q: {question}", source)
    return view(s, d, "dataset_rows").select("row_idx", chain.alias("c")).select("row_idx", F.size("c.messages").alias("n"), F.element_at("c.messages", -1)["content"].alias("last"), F.col("c.error").isNotNull().alias("refused"))


def p9_offline_model(s, d):
    prompt = F.when(F.col("row_idx") % 4 == 0, F.concat(F.lit("What is "), F.col("size"), F.lit(" * "), F.col("row_idx"), F.lit("?"))).when(F.col("row_idx") % 4 == 1, "The capital of France?").when(F.col("row_idx") % 4 == 2, F.concat(F.lit("Say:\n"), F.repeat(F.col("question"), 9), F.lit("\n \n"))).otherwise(F.concat(F.lit("7 / "), F.col("size") % 2, F.lit(" ?")))
    return I.offline_model(view(s, d, "dataset_rows").select("row_idx", prompt.alias("prompt")), F.lit("m1")).select("row_idx", "answer", "prompt_tokens", "completion_tokens", "latency_ms")


def p9_completed(s, d):
    """The hook for a model of the user's: here one that shouts the prompt back."""
    rows = view(s, d, "dataset_rows").select("row_idx", F.col("question").alias("prompt"))
    shout = lambda prompts: [{"answer": p.upper(), "prompt_tokens": len(p)} for p in prompts]
    return I.completed(rows, shout, 4).select("row_idx", "answer", "prompt_tokens", F.col("error").isNull().alias("fine"))


def w1_evaluation_run(s, d):
    """Rows to prompts, prompts to answers of the offline model, answers to scores, scores to run summaries."""
    rows = spread(_expected(s, d).select("row_idx", "dataset_id", "expected", F.to_json(F.struct("question", "answer")).alias("input")))
    prompts = rows.withColumn("prompt", P.rendered_or_dumped("Which type is {question}?\nAnswer: {answer}", F.col("input"))).withColumn("context", F.lit(4000))
    answered = I.offline_model(P.overflowing(prompts, "prompt", "context", 256).drop("error"), F.lit("m1"))
    scored = S.score_rows(answered.withColumnsRenamed({"answer": "output", "expected": "expected_raw"}), S.ScoringPlan("exact_match_ci"))
    results = scored.select(F.col("dataset_id").alias("experiment_id"), "row_idx", "score", "error", "latency_ms", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.lit(0.0).alias("cost"))
    return summaries.run_summary(results).select("experiment_id", "rows_seen", "rows_scored", "accuracy", "total_tokens")


def d4_split_without_contract(s, d):
    rows = view(s, d, "dataset_rows").select(F.col("row_idx").alias("idx"), F.when(F.col("row_idx") % 3 == 0, F.to_json(F.struct("question", F.struct("answer").alias("expected")))).when(F.col("row_idx") % 3 == 1, F.to_json(F.struct("question", "answer"))).otherwise(F.to_json(F.struct("question"))).alias("input"))
    return D.split_roles(rows)


def d11_suggested_contract(s, d):
    names = [r["name"] for r in D.column_order(_rows(s, d)).orderBy("position").collect()]
    found = D.suggested_contract(_rows(s, d).withColumnRenamed("idx", "idx"), names)
    out = [(role, c) for role in ("answer_candidates", "sensitive_candidates") for c in found[role]] + [("task_type", found["task_type"]), ("structured_chat", str(found["structured_chat"])), ("multi_answer", str(found["multi_answer"]))]
    return s.createDataFrame(out, "role string, value string").withColumn("n_rows", F.lit(_rows(s, d).count()))


def d13_replaced_version(s, d):
    rows = view(s, d, "dataset_rows").select("dataset_id", F.col("row_idx").alias("idx"), "question")
    return D.replaced_version(rows, "dataset_id", rows.where("dataset_id IN (1, 2) AND idx % 5 = 1")).groupBy("dataset_id").agg(F.count("*").alias("n"))


def d15_file_hashes(s, d):
    found = D.content_hashes(s, f"{d}/nation.parquet").unionByName(D.content_hashes(s, f"{d}/region.parquet"))
    rows = raw(s, d, "orders").groupBy((F.col("o_orderkey") % 2).alias("k")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(found.agg(F.countDistinct("content_hash").alias("files"), F.min(F.length("content_hash")).alias("digits"))))


def d17_signal_rows(s, d):
    cleaned = S.score_rows(view(s, d, "answer_pairs"), S.ScoringPlan("exact_match")).withColumn("error", F.when(F.col("row_idx") % 50 == 7, "lost"))
    return D.row_signals(cleaned, 5).select("code", "n_rows", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("shown"))


def g4_repointed(s, d):
    models = raw(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("provider"), (F.col("s_suppkey") % 7).alias("model_id"), (1000 - F.col("s_suppkey")).alias("created_at"))
    used = raw(s, d, "lineitem").where("l_suppkey % 11 = 0").select(F.col("l_suppkey").alias("model"))
    runs = raw(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("model_id"))
    return G.repointed(runs, G.model_survivors(models, used)).groupBy("model_id").agg(F.count("*").alias("n"))


def g6_bound_versions(s, d):
    runs = view(s, d, "models").select("experiment_id", "dataset_id", F.when(F.col("experiment_id") % 3 != 0, F.col("dataset_version")).alias("dataset_version"))
    now = view(s, d, "models").groupBy("dataset_id").agg(F.max("dataset_version").alias("version"))
    return G.bound_versions(runs, now).groupBy("dataset_id", "dataset_version").agg(F.count("*").alias("n"))


def g7_invalid_status(s, d):
    rows = view(s, d, "result_stream").select(F.when(F.col("event_id") % 10 == 0, F.col("status")).when(F.col("event_id") % 10 == 1, None).otherwise("done").alias("status"))
    return G.invalid_values(rows, "status", G.ALLOWED["status"])


def g8_nested_redaction(s, d):
    rows = view(s, d, "dataset_rows").select("row_idx", F.to_json(F.struct("category", F.struct(F.concat(F.lit("call 13912345678 or a@b.org, "), F.col("category")).alias("note"), F.array(F.struct("answer")).alias("list")).alias("more"), "size")).alias("input"))
    return rows.select("row_idx", redacted_json(F.col("input"), frozenset(["answer"])).alias("shown"))


def _platform(s, d):
    """The platform's tables over the driver's: some parents are left out, half of the experiments have snapshots."""
    project = (F.col("s_suppkey") % 25).alias("project_id")
    e = raw(s, d, "supplier").select(F.col("s_suppkey").alias("id"), project, (F.col("s_suppkey") % 40).alias("dataset_id"), (F.col("s_suppkey") % 7).alias("benchmark_id"), (F.col("s_suppkey") % 5).alias("prompt_id"), (F.col("s_suppkey") % 30).alias("model_id"), F.when(F.col("s_suppkey") % 2 == 0, F.format_string('{"model_id": "qwen/m%d", "name": "M"}', F.col("s_suppkey") % 30)).alias("model_snapshot"))
    numbers = lambda n: raw(s, d, "part").select((F.col("p_partkey") % n).alias("id")).distinct()
    owned = lambda n: numbers(n).withColumn("project_id", F.col("id") % 25)
    models = numbers(30).where("id % 4 <> 1").select("id", F.concat(F.lit("M"), F.col("id")).alias("name"), F.lit("openrouter").alias("provider"), F.concat(F.lit("qwen/m"), F.when(F.col("id") == 2, 5).otherwise(F.col("id"))).alias("model_id"), F.lit("{}").alias("pricing"))
    return {
        "projects": raw(s, d, "nation").where("n_nationkey % 6 <> 1").select(F.col("n_nationkey").alias("id")), "experiments": e, "models": models,
        "datasets": owned(40), "benchmarks": owned(7), "prompts": owned(5), "reports": owned(60),
        "dataset_rows": raw(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 44).alias("dataset_id")),
        "experiment_results": raw(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") * 2).alias("experiment_id")),
        "evaluation_tasks": raw(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("experiment_id"), F.when(F.col("event_id") % 10 == 0, F.col("ts")).alias("experiment_deleted_at")),
    }


def g1_all_counters(s, d):
    return R.missing_parents(_platform(s, d))


def g5_repair_report(s, d):
    return R.repaired(_platform(s, d), F.lit("2024-01-01").cast("timestamp_ntz"))[1]


def g5_after_repair(s, d):
    """What is still missing after a repair: only benchmarks and prompts, which go last."""
    return R.missing_parents(R.repaired(_platform(s, d), F.lit("2024-01-01").cast("timestamp_ntz"))[0])


PLATFORM = {
    "projects": "SELECT n_nationkey AS id FROM nation WHERE n_nationkey%6<>1",
    "e": "SELECT s_suppkey AS id, s_suppkey%25 AS project_id, s_suppkey%40 AS dataset_id, s_suppkey%7 AS benchmark_id, s_suppkey%5 AS prompt_id, s_suppkey%30 AS model_id, s_suppkey%2=0 AS snap FROM supplier",
    "models_": "SELECT DISTINCT p_partkey%30 AS id, 'qwen/m' || CASE WHEN p_partkey%30=2 THEN 5 ELSE p_partkey%30 END AS model_id FROM part WHERE p_partkey%30%4<>1",
    "datasets_": "SELECT DISTINCT p_partkey%40 AS id, p_partkey%40%25 AS project_id FROM part", "benchmarks_": "SELECT DISTINCT p_partkey%7 AS id, p_partkey%7 AS project_id FROM part", "prompts_": "SELECT DISTINCT p_partkey%5 AS id, p_partkey%5 AS project_id FROM part", "reports_": "SELECT DISTINCT p_partkey%60 AS id, p_partkey%60%25 AS project_id FROM part",
    "rows_": "SELECT p_partkey%44 AS dataset_id FROM part", "results_": "SELECT l_suppkey*2 AS experiment_id FROM lineitem", "tasks_": "SELECT user_id AS experiment_id FROM events WHERE event_id%10<>0",
    "lost": "SELECT DISTINCT model_id AS id, 'qwen/m' || model_id AS mid FROM e WHERE snap AND model_id NOT IN (SELECT id FROM models_)",
    "back": "SELECT * FROM lost WHERE mid NOT IN (SELECT model_id FROM models_)",
    "moved": "SELECT id FROM lost WHERE id NOT IN (SELECT id FROM back)",
    "datasets2": "SELECT * FROM datasets_ WHERE project_id IN (SELECT id FROM projects)",
    "e2": "SELECT * FROM e WHERE project_id IN (SELECT id FROM projects) AND dataset_id IN (SELECT id FROM datasets2) AND benchmark_id IN (SELECT id FROM benchmarks_) AND prompt_id IN (SELECT id FROM prompts_) AND model_id IN (SELECT id FROM models_ UNION SELECT id FROM lost)",
}


def _platform_sql(sql: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in PLATFORM.items()) + " " + sql


def _counts(rows: dict[str, str], name: str) -> str:
    return _platform_sql(" UNION ALL ".join(f"SELECT '{k}' AS \"{name}\", COUNT(*) AS n FROM {v}" for k, v in rows.items()))


NOT = lambda table, column, parent: f"{table} WHERE {column} NOT IN (SELECT id FROM {parent})"
CHECKS = {
    "experiments_missing_project": NOT("e", "project_id", "projects"), "experiments_missing_dataset": NOT("e", "dataset_id", "datasets_"), "experiments_missing_benchmark": NOT("e", "benchmark_id", "benchmarks_"), "experiments_missing_prompt": NOT("e", "prompt_id", "prompts_"), "experiments_missing_model": NOT("e", "model_id", "models_"),
    "datasets_missing_project": NOT("datasets_", "project_id", "projects"), "benchmarks_missing_project": NOT("benchmarks_", "project_id", "projects"), "prompts_missing_project": NOT("prompts_", "project_id", "projects"), "reports_missing_project": NOT("reports_", "project_id", "projects"),
    "dataset_rows_missing_dataset": NOT("rows_", "dataset_id", "datasets_"), "experiment_results_missing_experiment": NOT("results_", "experiment_id", "e"), "evaluation_tasks_missing_experiment": NOT("tasks_", "experiment_id", "e"),
}
STEPS = {
    "models_restored": "back", "models_repointed": "e WHERE model_id IN (SELECT id FROM moved)", "datasets_deleted": NOT("datasets_", "project_id", "projects"), "dataset_rows_deleted": NOT("rows_", "dataset_id", "datasets2"),
    "experiments_deleted": NOT("e", "id", "e2"), "experiment_results_deleted": NOT("results_", "experiment_id", "e2"), "benchmarks_deleted": NOT("benchmarks_", "project_id", "projects"), "prompts_deleted": NOT("prompts_", "project_id", "projects"), "reports_deleted": NOT("reports_", "project_id", "projects"), "tasks_marked": NOT("tasks_", "experiment_id", "e2"),
}
LAST = ["experiments_missing_benchmark", "experiments_missing_prompt"]
ANSWER = "CASE row_idx%6 WHEN 0 THEN answer WHEN 1 THEN answer WHEN 2 THEN answer WHEN 3 THEN CAST(size AS VARCHAR) WHEN 4 THEN category ELSE '' END"
POINTS = "SELECT row_idx, row_idx%5 AS k, row_idx%6 AS a, row_idx%4 AS b FROM dataset_rows"
JUDGE = "Decide whether the prediction means the same as the expected answer. Wording and layout do not matter.\n\nExpected: \nPrediction: \n\nAnswer MATCH or NO_MATCH and nothing else."
RUBRIC = "Expected: \nPrediction: \n\nGive each dimension 1 to 5 points, 5 for no fault:\n- correctness: correctness\n- completeness: completeness\n- quality: quality\n\nAnswer with JSON only: {\"scores\": {\"correctness\": 1-5, \"completeness\": 1-5, \"quality\": 1-5}}"
def _asked(text: str) -> str:
    """A judge's question in SQL, with the answer and the first 2,000 characters of the prediction in their places."""
    head, middle, tail = re.split(r"(?<=Expected: )|(?<=Prediction: )", text)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"{quote(head)} || answer || {quote(middle)} || SUBSTR(question || REPEAT('x', 2500), 1, 2000) || {quote(tail)}"


SURVIVORS = "SELECT id, COALESCE(MIN(id) FILTER (used) OVER w, FIRST_VALUE(id) OVER (PARTITION BY provider, model_id ORDER BY created_at, id)) AS survivor FROM (SELECT s_suppkey AS id, s_suppkey%3 AS provider, s_suppkey%7 AS model_id, 1000-s_suppkey AS created_at, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey%11=0) AS used FROM supplier) WINDOW w AS (PARTITION BY provider, model_id)"
PROMPT = "CASE row_idx%4 WHEN 0 THEN 'What is ' || size || ' * ' || row_idx || '?' WHEN 1 THEN 'The capital of France?' WHEN 2 THEN 'Say:' || CHR(10) || REPEAT(question, 9) || CHR(10) || ' ' || CHR(10) ELSE '7 / ' || size%2 || ' ?' END"
OFFLINE = "CASE row_idx%4 WHEN 0 THEN CAST(size*row_idx AS VARCHAR) WHEN 1 THEN 'Paris' WHEN 2 THEN LEFT(REPEAT(question, 9), 120) ELSE CASE WHEN size%2=0 THEN '0' ELSE '7' END END"
ORACLE = {
    "m1_canonical_expected": oracle(f"SELECT row_idx, {ANSWER} AS answer FROM dataset_rows"),
    "m15_tool_call": oracle("SELECT row_idx, CASE row_idx%5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS score FROM dataset_rows"),
    "m18_judged_once": oracle("SELECT row_idx, CASE WHEN row_idx%3=0 OR category='Brand#11' THEN 1.0 ELSE 0.0 END AS judge_score FROM dataset_rows"),
    "m19_rubric_scores": oracle(f"SELECT row_idx, c AS correctness, f AS coverage, CASE WHEN k<>3 THEN {r6('(c+3*f)/4')} END AS total FROM (SELECT row_idx, k, CASE WHEN k IN (0,2) THEN LEAST(a/5.0, 1) WHEN k=4 THEN 1.0 ELSE 0.0 END AS c, CASE WHEN k IN (0,1,2) THEN b/5.0 ELSE 0.0 END AS f FROM points)", points=POINTS),
    "p3_missing_paths": oracle("SELECT row_idx, CASE WHEN row_idx%2=0 THEN question || '/' || size ELSE '{question}/{more.size}{none}' || CHR(10) || CHR(10) || 'question: ' || question END AS prompt FROM dataset_rows"),
    "p6_structured_chains": oracle("SELECT row_idx, CASE WHEN row_idx%9=0 THEN NULL ELSE 2 END AS n, CASE WHEN row_idx%9<>0 THEN CASE WHEN row_idx%2=0 THEN 'Q: ' || answer || CHR(10) || 'A: ' || size || CHR(10) || CHR(10) ELSE '' END || 'Q: ' || question END AS last, row_idx%9=0 AS refused FROM dataset_rows"),
    "p9_offline_model": oracle(f"SELECT row_idx, answer, GREATEST(1, LENGTH(prompt)//4) AS prompt_tokens, GREATEST(1, LENGTH(answer)//4) AS completion_tokens, 50 + CAST('0x' || SUBSTRING(SHA256('m1:' || prompt), 1, 6) AS BIGINT) % 300 AS latency_ms FROM (SELECT row_idx, {PROMPT} AS prompt, {OFFLINE} AS answer FROM dataset_rows)"),
    "p9_completed": oracle("SELECT row_idx, UPPER(question) AS answer, LENGTH(question) AS prompt_tokens, TRUE AS fine FROM dataset_rows"),
    "w1_evaluation_run": oracle(f"SELECT dataset_id AS experiment_id, COUNT(*) AS rows_seen, COUNT(*) AS rows_scored, {r6(f'AVG(CASE WHEN {ANSWER}=answer THEN 1.0 ELSE 0.0 END)')} AS accuracy, CAST(SUM(GREATEST(1, LENGTH('Which type is ' || question || '?' || CHR(10) || 'Answer: ' || answer)//4) + GREATEST(1, LENGTH('Answer: ' || answer)//4)) AS BIGINT) AS total_tokens FROM dataset_rows GROUP BY 1"),
    "d4_split_without_contract": oracle("SELECT row_idx AS idx, '{\"question\":\"' || question || '\"}' AS input, CASE WHEN row_idx%3<2 THEN '{\"answer\":\"' || answer || '\"}' END AS expected FROM dataset_rows"),
    "d11_suggested_contract": oracle("SELECT role, value, (SELECT COUNT(*) FROM src) AS n_rows FROM (VALUES ('answer_candidates','answer'),('task_type','qa'),('structured_chat','False'),('multi_answer','False')) t(role, value)", src=ROWS),
    "d13_replaced_version": oracle("SELECT dataset_id, COUNT(*) AS n FROM dataset_rows WHERE dataset_id NOT IN (1,2) OR row_idx%5=1 GROUP BY 1"),
    "d15_file_hashes": "SELECT o_orderkey%2 AS k, COUNT(*) AS n, CAST(2 AS BIGINT) AS files, 64 AS digits FROM orders GROUP BY 1",
    "d17_signal_rows": oracle("SELECT code, COUNT(*) AS n_rows, STRING_AGG(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx) FILTER (place<=5) AS shown FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY row_idx) AS place FROM (SELECT 'empty_output' AS code, row_idx FROM answer_pairs WHERE TRIM(output)='' UNION ALL SELECT 'row_error', row_idx FROM answer_pairs WHERE row_idx%50=7)) GROUP BY 1"),
    "g4_repointed": f"SELECT COALESCE(survivor, m) AS model_id, COUNT(*) AS n FROM (SELECT o_custkey%200 AS m FROM orders) LEFT JOIN ({SURVIVORS}) ON id=m GROUP BY 1",
    "g6_bound_versions": oracle("SELECT dataset_id, CASE WHEN experiment_id%3<>0 THEN dataset_version ELSE v END AS dataset_version, COUNT(*) AS n FROM models JOIN (SELECT dataset_id, MAX(dataset_version) AS v FROM models GROUP BY 1) USING (dataset_id) GROUP BY 1, 2"),
    "g7_invalid_status": oracle("SELECT value, COUNT(*) AS n FROM (SELECT CASE WHEN event_id%10=0 THEN status WHEN event_id%10=1 THEN NULL ELSE 'done' END AS value FROM result_stream) WHERE value IS NULL OR value IN ('done','scored') GROUP BY 1"),
    "g8_nested_redaction": oracle("SELECT row_idx, '{\"category\":\"' || category || '\",\"more\":{\"note\":\"call [REDACTED] or [REDACTED], ' || category || '\",\"list\":[{\"answer\":\"[REDACTED]\"}]},\"size\":' || size || '}' AS shown FROM dataset_rows"),
    "g1_all_counters": _counts(CHECKS, "check"),
    "g5_repair_report": _counts(STEPS, "step"),
    "g5_after_repair": _counts({k: f"e2 WHERE {k.split('_')[-1]}_id NOT IN (SELECT id FROM {k.split('_')[-1]}s_ WHERE project_id IN (SELECT id FROM projects))" if k in LAST else "projects WHERE FALSE" for k in CHECKS}, "check"),
    "m20_judge_prompts": oracle(f"SELECT row_idx, {_asked(JUDGE)} AS judge, {_asked(RUBRIC)} AS rubric FROM dataset_rows"),
}
