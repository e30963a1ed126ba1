"""Queries S1-S3, S6-S8, M11, M14 and A32, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorelake.functions.numbers import exact_mean, rounded
from scorelake.functions.vectorized import semantic_similarity
from scorelake.operators import analytics as A
from scorelake.operators import metrics as M
from scorelake.operators import summaries
from scorelake.plans.analytics_queries import r6
from scorelake.sources import files
from scorelake.sources.fixtures import oracle, raw, view
from scorelake.sources.storage import spread, work_dir


def s1_read_jsonl(s, d):
    path = work_dir(s)
    rows = view(s, d, "dataset_rows").select(F.when(F.col("row_idx") % 10 == 3, F.lit("[1]")).when(F.col("row_idx") % 10 == 4, F.lit("{bad")).otherwise(F.to_json(F.struct("row_idx", "question"))).alias("value"))
    rows.write.text(path)
    return files.read_jsonl(s, path).groupBy("error").agg(F.count("*").alias("n"), F.sum(F.get_json_object("input", "$.row_idx").cast("long")).alias("sum_idx"))


def s2_read_json(s, d):
    path = work_dir(s)
    one = view(s, d, "dataset_rows").groupBy("dataset_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("row_idx", "category"))).alias("rows"))).alias("value"))
    one.write.partitionBy("dataset_id").text(path)
    return files.read_json(s, path).agg(F.count("*").alias("n"), F.sum(F.get_json_object("input", "$.row_idx").cast("long")).alias("sum_idx"))


def s2_json_errors(s, d):
    """Files of four kinds of roots and some broken ones: rows and errors of each kind."""
    path = work_dir(s)
    rows = view(s, d, "dataset_rows").groupBy((F.col("row_idx") % 6).alias("kind"), F.floor(F.col("row_idx") / 1200).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("row_idx", "category")))), ", ").alias("body"))
    made = [F.concat(F.lit("["), "body", F.lit(", 7]")), F.concat(F.lit('{"rows": ['), "body", F.lit("]}")), F.concat(F.lit('{"data": 3, "rows": ['), "body", F.lit("]}")), F.lit('{"other": 1}'), F.lit("{nojson"), F.lit('"text"')]
    one = rows.select("kind", F.element_at(F.array(*made), (F.col("kind") + 1).cast("int")).alias("value"))
    one.write.option("maxRecordsPerFile", 1).partitionBy("kind").text(path)
    kind = F.regexp_extract("path", "kind=([0-9]+)", 1).cast("int")
    return files.read_json(s, path).groupBy(kind.alias("kind"), "error").agg(F.count("*").alias("n"), F.sum(F.get_json_object("input", "$.row_idx").cast("long")).alias("sum_idx"))


def s3_read_csv(s, d):
    path = work_dir(s)
    view(s, d, "dataset_rows").select("row_idx", F.concat(F.col("question"), F.lit(', "x"\ny')).alias("question")).write.csv(path, header=True, quoteAll=True, escape='"')
    return files.read_delimited(s, path).select(F.col("row_idx").cast("long").alias("row_idx"), F.length("question").cast("long").alias("n_chars"))


def s6_write_results(s, d):
    """Every experiment written, one of them replaced, and read by row numbers from a bucketed table."""
    path, name = work_dir(s), "results_" + uuid.uuid4().hex
    results = view(s, d, "eval_results").select("experiment_id", "row_idx", "score")
    files.write_results(results, path)
    files.write_results(results.where("experiment_id = 3").withColumn("score", F.lit(0.5)), path)
    files.write_bucketed(s.read.parquet(path).select(F.col("experiment_id").cast("long").alias("experiment_id"), "row_idx", "score"), name)
    return s.table(name).groupBy("row_idx").agg(F.count("*").alias("n"), rounded(F.sum("score"), 3).alias("total"))


def s6_write_all_results(s, d):
    path = work_dir(s)
    results = view(s, d, "eval_results").select("experiment_id", "row_idx", "score")
    files.write_results(results, path)
    files.write_results(results.where("experiment_id = 3").withColumn("score", F.lit(0.5)), path)
    return s.read.parquet(path).groupBy(F.col("experiment_id").cast("long").alias("experiment_id")).agg(F.count("*").alias("n"), rounded(exact_mean(F.col("score"))).alias("mean"))


def s7_read_page(s, d):
    path = work_dir(s)
    view(s, d, "dataset_rows").write.partitionBy("dataset_id").parquet(path)
    return files.read_page(s, path, "dataset_id = 2", "row_idx", 20, 10).select("row_idx", "question")


def s8_reconcile(s, d):
    results = view(s, d, "eval_results")
    return files.reconciled(results, results.where("experiment_id % 9 <> 0 OR row_idx % 2 = 0"), "experiment_id").drop("same_rows")


def s8_copy(s, d):
    """A table copied and found whole, and one that lost rows and had one changed on the way."""
    results = view(s, d, "eval_results").select("experiment_id", "row_idx", "score")
    good = files.copied(results, work_dir(s), "experiment_id").agg(F.lit("copied").alias("what"), F.count("*").alias("differing"), F.lit(0).cast("long").alias("changed_only"))
    hurt = results.where("experiment_id % 9 <> 0 OR row_idx % 2 = 0").withColumn("score", F.when(F.col("experiment_id") == 5, F.col("score") + 1).otherwise(F.col("score")))
    bad = files.reconciled(results, hurt, "experiment_id").agg(F.lit("damaged").alias("what"), F.count("*").alias("differing"), F.count_if(F.col("n_source") == F.col("n_target")).alias("changed_only"))
    return good.union(bad)


def m11_f1_token(s, d):
    return spread(view(s, d, "answer_pairs")).select("row_idx", rounded(M.f1_token(F.concat("output", F.lit(" and more")), F.concat("expected", F.lit(" more")))).alias("score"))


def m14_semantic_similarity(s, d):
    return spread(view(s, d, "answer_pairs")).select("row_idx", rounded(semantic_similarity(F.col("output"), F.col("expected"))).alias("score"))


def s4_encodings(s, d):
    """The same rows written in three encodings, each read back by trying UTF-8, then GBK, then UTF-16."""
    rows = view(s, d, "dataset_rows").select("row_idx", F.concat(F.col("question"), F.lit(" 答案")).alias("question"))
    out = None
    for number, encoding in enumerate(["UTF-8", "GBK", "UTF-16"]):
        path = work_dir(s)
        files.write_encoded(rows.select(F.to_json(F.struct("row_idx", "question")).alias("value")), path, encoding)
        lines = files.read_lines(s, path)[0].select(F.lit(number).alias("encoding"), F.get_json_object("value", "$.row_idx").cast("long").alias("row_idx"), F.get_json_object("value", "$.question").alias("question"))
        out = lines if out is None else out.union(lines)
    return out


def s5_formats(s, d):
    path = F.concat(F.lit("data/"), F.col("p_partkey"), F.element_at(F.array(*map(F.lit, [".CSV", ".tsv", ".jsonl", ".ndjson", ".json", ".bin", ""])), (F.col("p_partkey") % 7 + 1).cast("int")))
    given = F.when(F.col("p_partkey") % 5 == 0, "csv")
    return raw(s, d, "part").select("p_partkey", files.format_of(path, given).alias("format"))


def a32_markdown_report(s, d):
    results = view(s, d, "eval_results")
    board = summaries.run_summary(results)
    names = view(s, d, "models").select("experiment_id", F.col("experiment_name").alias("name"), F.col("model_id").cast("string").alias("model"))
    facts = A.report_facts(results, board).join(board.drop("accuracy", "total_cost", "rows_total"), "experiment_id").join(names, "experiment_id")
    return A.markdown_report(facts).select("section", "title", "body")


def a31_report_totals(s, d):
    results = view(s, d, "eval_results")
    board = summaries.run_summary(results)
    names = view(s, d, "models").select("experiment_id", F.col("experiment_name").alias("name"), F.col("model_id").cast("string").alias("model"))
    one = A.report_totals(A.report_facts(results, board).join(board.select("experiment_id", "total_tokens"), "experiment_id").join(names, "experiment_id"))
    return one.select("n", "cost", "tokens", "failures", F.col("best.experiment_id").alias("best"), F.col("cheapest.experiment_id").alias("cheapest"), F.col("most_failing.experiment_id").alias("most_failing"))


def a32_markdown_facts(s, d):
    board = A.report_facts(view(s, d, "eval_results"), summaries.run_summary(view(s, d, "eval_results")))
    line = F.concat(F.lit("| "), F.col("experiment_id").cast("string"), F.lit(" | "), F.col("rows_total").cast("string"), F.lit(" | "), F.col("failure_count").cast("string"), F.lit(" |"))
    return board.select("experiment_id", line.alias("line"))


TOKENS = "REGEXP_EXTRACT_ALL(LOWER({}), '[a-z0-9]+(?:[''’][a-z0-9]+)?')"
WRONG = "(COALESCE(error,'')<>'' OR score < 1.0)"
ORACLE = {
    "s4_encodings": oracle("SELECT e.encoding, row_idx, question || ' 答案' AS question FROM dataset_rows, (VALUES (0),(1),(2)) e(encoding)"),
    "s5_formats": "SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN 'csv' ELSE ['csv','tsv','jsonl','jsonl','json','json','json'][p_partkey%7+1] END AS format FROM part",
    "a31_report_totals": oracle(f"SELECT COUNT(*) AS n, {r6('SUM(total_cost)')} AS cost, CAST(SUM(total_tokens) AS BIGINT) AS tokens, CAST(SUM(failures) AS BIGINT) AS failures, ARG_MIN(experiment_id, (-accuracy, experiment_id)) AS best, ARG_MIN(experiment_id, (total_cost, experiment_id)) AS cheapest, ARG_MIN(experiment_id, (-failures, experiment_id)) AS most_failing FROM runs", runs=f"SELECT experiment_id, {r6('SUM(cost)')} AS total_cost, SUM(tokens) AS total_tokens, COUNT(*) FILTER ({WRONG}) AS failures, {r6("AVG(CASE WHEN COALESCE(error,'')='' THEN score END)")} AS accuracy FROM eval_results JOIN models USING (experiment_id) GROUP BY 1"),
    "m11_f1_token": oracle("SELECT row_idx, CASE WHEN common>0 THEN FLOOR(2.0*common/(LEN(g)+LEN(e))*1000000+0.5)/1000000 ELSE 0.0 END AS score FROM (SELECT row_idx, g, e, COALESCE(LIST_SUM(LIST_TRANSFORM(LIST_DISTINCT(g), lambda t: LEAST(LEN(LIST_FILTER(g, lambda x: x=t)), LEN(LIST_FILTER(e, lambda x: x=t))))), 0) AS common FROM (SELECT row_idx, " + TOKENS.format("output || ' and more'") + " AS g, " + TOKENS.format("expected || ' more'") + " AS e FROM answer_pairs))"),
    "s1_read_jsonl": oracle("SELECT CASE WHEN row_idx%10 IN (3,4) THEN 'not a JSON object' END AS error, COUNT(*) AS n, CAST(SUM(CASE WHEN row_idx%10 NOT IN (3,4) THEN row_idx END) AS BIGINT) AS sum_idx FROM dataset_rows GROUP BY 1"),
    "s2_read_json": oracle("SELECT COUNT(*) AS n, CAST(SUM(row_idx) AS BIGINT) AS sum_idx FROM dataset_rows"),
    "s2_json_errors": oracle("SELECT CAST(k AS INT) AS kind, CASE WHEN k=4 THEN 'invalid JSON' WHEN k IN (3,5) THEN 'no list of objects' END AS error, CASE WHEN k<3 THEN COUNT(*) ELSE COUNT(DISTINCT part) END AS n, CASE WHEN k<3 THEN CAST(SUM(row_idx) AS BIGINT) END AS sum_idx FROM (SELECT row_idx, row_idx%6 AS k, row_idx//1200 AS part FROM dataset_rows) GROUP BY k UNION ALL SELECT 0, 'not a JSON object', COUNT(DISTINCT row_idx//1200), NULL FROM dataset_rows WHERE row_idx%6=0"),
    "s8_copy": oracle("SELECT 'copied' AS what, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS changed_only UNION ALL SELECT 'damaged', COUNT(*) FILTER (lost>0 OR experiment_id=5), COUNT(*) FILTER (lost=0 AND experiment_id=5) FROM (SELECT experiment_id, COUNT(*) FILTER (experiment_id%9=0 AND row_idx%2<>0) AS lost FROM eval_results GROUP BY 1)"),
    "s3_read_csv": oracle("SELECT row_idx, LENGTH(question)+7 AS n_chars FROM dataset_rows"),
    "s6_write_results": oracle(f"SELECT row_idx, COUNT(*) AS n, {r6('SUM(CASE WHEN experiment_id=3 THEN 0.5 ELSE score END)', 3)} AS total FROM eval_results GROUP BY 1"),
    "s6_write_all_results": oracle(f"SELECT experiment_id, COUNT(*) AS n, {r6('AVG(CASE WHEN experiment_id=3 THEN 0.5 ELSE score END)')} AS mean FROM eval_results GROUP BY 1"),
    "s7_read_page": oracle("SELECT row_idx, question FROM dataset_rows WHERE dataset_id=2 ORDER BY row_idx LIMIT 10 OFFSET 20"),
    "s8_reconcile": oracle("SELECT experiment_id, n_source, n_target FROM (SELECT experiment_id, COUNT(*) AS n_source, NULLIF(COUNT(*) FILTER (experiment_id%9<>0 OR row_idx%2=0), 0) AS n_target FROM eval_results GROUP BY 1) WHERE n_target IS DISTINCT FROM n_source"),
    "a32_markdown_facts": oracle(f"SELECT experiment_id, '| ' || experiment_id || ' | ' || COUNT(*) || ' | ' || COUNT(*) FILTER {'(' + WRONG + ')'} || ' |' AS line FROM eval_results GROUP BY 1"),
}
