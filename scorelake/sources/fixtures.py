"""Views that give the driver's tables the roles of evaluation data.

Each view is one SELECT that Spark and DuckDB read alike; the queries run it in Spark and the oracle SQL inlines it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "eval_results": """
SELECT l_suppkey AS experiment_id, l_partkey AS row_idx,
 MAX(CASE WHEN l_returnflag='N' THEN CAST(1 AS DOUBLE) WHEN l_returnflag='R' THEN FLOOR(l_discount*100 + 0.5) / CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS score,
 CASE WHEN MAX(l_tax) >= 0.08 THEN 'rate limited: 429' WHEN MAX(l_quantity) >= 49 THEN 'metric_error[metric]: bad score' END AS error,
 CAST(FLOOR(MAX(l_quantity)*100) AS BIGINT) AS latency_ms,
 CAST(FLOOR(MAX(l_extendedprice)/100) AS BIGINT) AS tokens,
 FLOOR(MAX(l_extendedprice)) / CAST(1000000 AS DOUBLE) AS cost,
 MAX(l_shipdate) AS created_at
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "dataset_rows": """
SELECT p_partkey AS row_idx, p_partkey % 4 AS dataset_id, p_name AS question, p_type AS answer, p_brand AS category, p_size AS size FROM part""",
    "models": """
SELECT s_suppkey AS experiment_id, s_suppkey % 25 AS model_id, s_name AS experiment_name, n_name AS provider, r_regionkey AS organization_id, r_name AS organization_name,
 s_nationkey % 3 AS dataset_id, 1 + s_suppkey % 2 AS dataset_version, s_suppkey % 2 AS benchmark_id
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "answer_pairs": """
SELECT p_partkey AS row_idx, p_type AS expected,
 CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN CONCAT('Answer: ', UPPER(p_type)) WHEN 2 THEN CONCAT('thinking', CHR(10), 'Final Answer: ', p_type, '.')
 WHEN 3 THEN CONCAT('"', p_type, '" (note)') WHEN 4 THEN p_name ELSE '' END AS output FROM part""",
    "answer_sheets": """
SELECT p_partkey AS row_idx, p_partkey % 5 AS experiment_id, p_name AS expected, p_brand AS brand, p_type AS kind,
 CONCAT('{"answer": ["', p_name, '", "', p_brand, '"], "aliases": ["', p_type, '"]}') AS expected_raw,
 CASE p_partkey % 7 WHEN 0 THEN CONCAT('It is, of course, ', p_name, '.') WHEN 1 THEN CONCAT('Answer: ', UPPER(p_name)) WHEN 2 THEN CONCAT('thinking', CHR(10), 'Final Answer: ', p_name, ', ', p_brand)
 WHEN 3 THEN CONCAT(p_brand, ', ', p_name, '!') WHEN 4 THEN CONCAT('Answer: ', p_type) WHEN 5 THEN CONCAT('no ', p_brand, ' here') ELSE '' END AS output FROM part""",
    "judge_labels": """
SELECT doc_id, quality AS gold, 1 - toxic AS judge_a, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS judge_b FROM labels""",
    "chat_turns": """
SELECT conv_id, turn, role, text FROM conversations""",
    "result_stream": """
SELECT event_id, ts, user_id AS experiment_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'scored' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value, props FROM events""",
}
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A fixture view over the tables in sf_dir; given: tables to take in their place, such as streams of them."""
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in RAW if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: given[t] if t in given else raw(spark, sf_dir, t) for t in used})


def oracle(sql: str, **more: str) -> str:
    """sql for DuckDB with the views that it names put before it; more: further named subqueries, in order."""
    text = sql + " ".join(more.values())
    parts = [f"{name} AS ({body})" for name, body in VIEWS.items() if re.search(rf"\b{name}\b", text)]
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql
