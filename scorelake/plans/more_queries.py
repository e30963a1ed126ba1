"""Queries D7, D9, D16, D18, D20, D22, P5, P11 and G6, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.numbers import rounded
from scorelake.operators import datasets as D
from scorelake.operators import governance as G
from scorelake.operators import prompts as P
from scorelake.operators import scoring as S
from scorelake.sources.fixtures import oracle, raw, view


def d7_chat_errors(s, d):
    role = F.when(F.col("turn") % 5 == 4, "robot").otherwise(F.col("role"))
    chats = view(s, d, "chat_turns").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.to_json(F.struct(F.array(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("messages"))).alias("input"))
    return D.chat_errors(chats)


def d9_version_issues(s, d):
    rows = view(s, d, "dataset_rows").select("dataset_id", F.col("row_idx").alias("idx"), F.to_json(F.struct("question", F.when(F.col("row_idx") % 7 == 0, " ").otherwise(F.col("category")).alias("category"))).alias("input"), F.when(F.col("row_idx") % 11 > 0, F.to_json(F.struct(F.when(F.col("row_idx") % 11 == 1, "").otherwise(F.col("answer")).alias("answer")))).alias("expected"))
    declared = rows.groupBy("dataset_id").agg((F.count("*") + F.when(F.col("dataset_id") == 1, 1).otherwise(0)).alias("row_count"))
    return D.version_issues(rows, declared, ["question", "context", "topic"], ["category"], ["question", "context"], ["answer", "expected"])


def d20_joined_choices(s, d):
    q = raw(s, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.create_map(F.lit("B"), F.col("p_brand"), F.lit("A"), F.col("p_type")).alias("options"))
    a = raw(s, d, "part").where("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "b,a").otherwise("b").alias("answer"))
    return D.joined_choices(q, a, "p_partkey")


def d16_flat_rows(s, d):
    rows = view(s, d, "dataset_rows").select(F.col("row_idx").alias("idx"), F.to_json(F.struct("question", F.struct("category").alias("_metadata"))).alias("input"), F.to_json(F.struct("answer")).alias("expected"))
    return D.flat_rows(rows).select("idx", F.col("row")["question"].alias("question"), F.col("row")["category"].alias("category"), F.col("row")["answer"].alias("answer"), F.size("row").alias("n_keys"))


def d18_dry_run_summary(s, d):
    scored = S.score_rows(view(s, d, "answer_pairs"), S.ScoringPlan("exact_match_ci"))
    out = D.dry_run_summary(scored, 100)
    return out.withColumn("avg_score", rounded(F.col("avg_score")))


def d22_preview(s, d):
    rows = raw(s, d, "documents").select(F.col("doc_id").alias("idx"), "lang", "n_chars")
    return D.preview(rows, ["lang", "n_chars"], 10, 20, G.redacted)


def p5_few_shot(s, d):
    examples = F.concat(F.lit("["), F.to_json(F.struct("question", "answer")), F.lit(', "plain"]'))
    return view(s, d, "dataset_rows").select("row_idx", P.few_shot(examples).alias("shots"))


def p11_cost_unknown(s, d):
    models = raw(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4 == 0).alias("free"), F.when(F.col("s_suppkey") % 3 == 0, F.lit('{"input_per_1k": 0.1}')).otherwise(F.lit("{}")).alias("pricing"))
    return P.cost_unknown(models).select("s_suppkey", "cost_unknown")


def g6_backfilled_versions(s, d):
    versions = view(s, d, "models").where("dataset_id <> 2").select("dataset_id", F.col("dataset_version").cast("int").alias("version")).distinct()
    return D.backfilled_versions(view(s, d, "models").select("dataset_id"), versions)


CLEANED = "REGEXP_REPLACE(CASE row_idx % 6 WHEN 0 THEN expected WHEN 1 THEN UPPER(expected) WHEN 2 THEN expected WHEN 3 THEN expected || CHR(34) WHEN 4 THEN output ELSE '' END, '\\s+', '', 'g')"
ORACLE = {
    "d9_version_issues": oracle("SELECT dataset_id, 'row_count_drift' AS code, '' AS field, COUNT(*) AS n FROM dataset_rows WHERE dataset_id=1 GROUP BY 1 UNION ALL SELECT dataset_id, 'missing_variable', 'context', COUNT(*) FROM dataset_rows GROUP BY 1 UNION ALL SELECT dataset_id, 'missing_required', 'category', COUNT(*) FROM dataset_rows WHERE row_idx%7=0 GROUP BY 1 UNION ALL SELECT dataset_id, 'unmapped_variable', 'topic', 1 FROM dataset_rows GROUP BY 1 UNION ALL SELECT dataset_id, 'missing_expected', 'answer', COUNT(*) FROM dataset_rows WHERE row_idx%11<2 GROUP BY 1 UNION ALL SELECT dataset_id, 'missing_expected', 'expected', COUNT(*) FROM dataset_rows WHERE row_idx%11=0 GROUP BY 1"),
    "d20_joined_choices": "SELECT p_partkey, p_name || CHR(10) || 'A. ' || p_type || CHR(10) || 'B. ' || p_brand AS question, CASE WHEN p_partkey%3=0 THEN 'AB' ELSE 'B' END AS answer, CASE WHEN p_partkey%3=0 THEN 'multiple' ELSE 'single' END AS kind FROM part WHERE p_partkey%4<>0",
    "d7_chat_errors": oracle("SELECT conv_id*1000+turn AS idx, 'messages' AS field, 'chat' AS code FROM chat_turns WHERE turn%5=4 OR role NOT IN ('system','user','assistant')"),
    "d16_flat_rows": oracle("SELECT row_idx AS idx, question, category, answer, 3 AS n_keys FROM dataset_rows"),
    "d18_dry_run_summary": oracle(f"SELECT COUNT(*) AS n_rows, FLOOR(AVG(score)*1000000+0.5)/1000000 AS avg_score, COUNT(*) FILTER (score>=1) AS n_full, COUNT(*) FILTER (score<=0) AS n_zero, CAST(0 AS BIGINT) AS n_error FROM (SELECT CASE WHEN LOWER({CLEANED})=LOWER(REGEXP_REPLACE(expected,'\\s+','','g')) THEN 1.0 ELSE 0.0 END AS score FROM answer_pairs ORDER BY row_idx LIMIT 100)"),
    "d22_preview": "SELECT doc_id AS idx, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10",
    "p5_few_shot": oracle("SELECT row_idx, 'Q: ' || question || CHR(10) || 'A: ' || answer || CHR(10) || CHR(10) || 'plain' AS shots FROM dataset_rows"),
    "p11_cost_unknown": "SELECT s_suppkey, s_suppkey%4<>0 AND s_suppkey%3<>0 AS cost_unknown FROM supplier",
    "g6_backfilled_versions": oracle("SELECT DISTINCT dataset_id, CAST(dataset_version AS INT) AS version FROM models WHERE dataset_id<>2 UNION ALL SELECT 2, 1"),
}
