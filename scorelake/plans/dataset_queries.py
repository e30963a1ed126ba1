"""Queries S, D, P, G and T over the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.numbers import rounded
from scorelake.operators import datasets as D
from scorelake.operators import governance as G
from scorelake.operators import prompts as P
from scorelake.operators import versions as V
from scorelake.sources.fixtures import oracle, raw, view
from scorelake.sources.storage import work_dir

JSON = "to_json(named_struct('question', question, 'answer', answer, 'category', CASE WHEN row_idx % 7 = 0 THEN ' ' ELSE category END, 'size', size))"


def _rows(s, d):
    return view(s, d, "dataset_rows").selectExpr("row_idx AS idx", "dataset_id", f"{JSON} AS input")


def d1_column_order(s, d):
    return D.column_order(_rows(s, d))


def d2_profile(s, d):
    return D.profile(_rows(s, d), ["question", "answer", "category", "size", "absent"])


def d3_inferred_contract(s, d):
    names = [r["name"] for r in D.column_order(_rows(s, d)).orderBy("position").collect()]
    found = D.infer_contract(names)
    return s.createDataFrame([(role, c) for role in ("input", "expected") for c in found[role]], "role string, name string").join(D.profile(_rows(s, d), names), "name")


def d4_split_roles(s, d):
    return D.split_roles(_rows(s, d), {"input": ["question", "size"], "expected": ["answer"], "metadata": []})


def d5_missing_required(s, d):
    return D.missing_required(_rows(s, d), ["question", "category"])


def d6_type_errors(s, d):
    return D.type_errors(_rows(s, d), {"size": "integer", "answer": "number"})


def d8_import_errors(s, d):
    return D.import_errors(_rows(s, d), {"required": ["category"], "types": {"answer": "number"}}, 150)


def d10_empty_rows(s, d):
    return D.empty_rows(_rows(s, d), ["category"])


def d12_dense_index(s, d):
    orders = raw(s, d, "orders")
    return D.with_dense_index(orders, "o_orderkey", "o_custkey", "o_totalprice").withColumn("idx", F.col("idx").cast("long"))


def d13_appended_version(s, d):
    rows = view(s, d, "dataset_rows").select("dataset_id", (F.floor(F.col("row_idx") / 4)).cast("long").alias("idx"), "question")
    new = rows.where("idx < 10")
    return D.appended_version(rows, "dataset_id", new).groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def _versions(s, d):
    """Versions kept as manifests: all rows, then more of some datasets, then other rows for one, then one rolled back."""
    folder = work_dir(s)
    rows = view(s, d, "dataset_rows").select("dataset_id", (F.floor(F.col("row_idx") / 4)).cast("long").alias("idx"), "question")
    V.write_version(rows, folder, 1, "replace")
    V.write_version(rows.where("dataset_id > 0 AND idx < 10"), folder, 2)
    V.write_version(rows.where("dataset_id > 1 AND idx < 20"), folder, 3)
    V.write_version(rows.where("dataset_id = 1 AND idx < 5"), folder, 4, "replace")
    V.activate(s.createDataFrame([(3, 2)], "dataset_id long, version int"), folder, 5)
    return folder, rows.schema


def d13_manifest_versions(s, d):
    folder, schema = _versions(s, d)
    every = V.manifest(s, folder).select("dataset_id", "version").distinct()
    return V.read_version(s, folder, schema, every).groupBy("dataset_id", "version").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"), F.countDistinct("idx").alias("n_idx"))


def d14_rolled_back(s, d):
    folder, schema = _versions(s, d)
    return V.read_version(s, folder, schema).select("dataset_id", "version", "idx", "question")


def d14_active_version(s, d):
    versions = view(s, d, "models").select("dataset_id", F.col("dataset_version").alias("version"))
    chosen = versions.where("dataset_id = 1").groupBy("dataset_id").agg(F.min("version").alias("chosen"))
    return D.active_version(versions, chosen)


def d15_content_hash(s, d):
    done = raw(s, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("import_id"), (F.col("doc_id") % 2).alias("project_id"), F.col("source").alias("idempotency_key"), F.sha2("text", 256).alias("content_hash"))
    wanted = raw(s, d, "documents").select((F.col("doc_id") % 2).alias("project_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("k"), F.col("doc_id"))).otherwise(F.col("source")).alias("idempotency_key"), F.sha2("text", 256).alias("content_hash"))
    return D.new_imports(wanted, done)


def d17_row_signals(s, d):
    from scorelake.functions.cleaning import clean_prediction

    return D.row_signals(view(s, d, "answer_pairs").withColumn("cleaned", clean_prediction(F.col("output"))).withColumn("error", F.lit(""))).select("code", "n_rows", "first_row")


def d19_stratified_sample(s, d):
    return D.stratified_sample(raw(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


def d21_deduplicated(s, d):
    return D.deduplicated(raw(s, d, "documents"), "text", "doc_id").select("doc_id", "lang")


def p1_template_variables(s, d):
    t = raw(s, d, "part").select("p_partkey", F.concat(F.lit("Q: {"), F.col("p_brand").substr(1, 5), F.lit("} {{x}} {a.b} {a.b} {items.0}")).alias("template"))
    return P.template_variables(t).select("p_partkey", F.array_join("variables", ",").alias("vars"))


def p2_rendered(s, d):
    return _rows(s, d).select("idx", P.rendered("Q: {question} [{size}] {{keep}} {absent}", F.col("input")).alias("prompt"))


def p4_missing_variables(s, d):
    return _rows(s, d).select("idx", F.array_join(P.missing_variables("{question} {absent} {answer.x}", F.col("input")), ",").alias("missing"))


def p6_message_chains(s, d):
    return P.message_chains(view(s, d, "chat_turns")).select("conv_id", "n_turns", "valid", F.element_at("messages", 1)["role"].alias("first_role"), F.length(F.element_at("messages", -1)["content"]).cast("long").alias("last_length"))


def p7_estimated_tokens(s, d):
    return raw(s, d, "documents").select("doc_id", P.estimated_tokens(F.col("text")).alias("est_tokens"))


def p8_context_overflow(s, d):
    docs = raw(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, 400).otherwise(2000).alias("context"))
    return P.overflowing(docs, "text", "context", 100).select("doc_id", "needed", F.col("error").isNotNull().alias("overflow"))


def p10_row_cost(s, d):
    return raw(s, d, "lineitem").groupBy("l_suppkey").agg(rounded(F.sum(P.row_cost(F.floor("l_quantity"), F.floor("l_quantity") * 2, F.lit(0.5), F.when(F.col("l_suppkey") % 2 == 0, F.lit(1.5)))), 4).alias("cost"))


def p12_price_catalog(s, d):
    price = lambda k: ((F.col("s_suppkey") % k) / 1e6).cast("string")
    models = raw(s, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 10 == 0, ":free").otherwise("")).alias("model_id"), F.col("s_name").alias("name"), price(100).alias("prompt_price"), price(7).alias("completion_price"))
    return P.price_catalog(models, ["m7"])


def p13_fan_out(s, d):
    m = view(s, d, "models").select("model_id").distinct()
    plan = view(s, d, "models").select("dataset_id", "benchmark_id").distinct()
    return P.fan_out(m, plan)


def g1_integrity_report(s, d):
    results, models, rows = view(s, d, "eval_results"), view(s, d, "models"), view(s, d, "dataset_rows")
    return G.integrity_report([
        (results, "experiment_id", models.where("experiment_id % 10 <> 3"), "experiment_id", "results_without_experiment"),
        (results, "row_idx", rows.where("row_idx % 7 <> 1"), "row_idx", "results_without_row"),
        (models, "dataset_id", rows.where("dataset_id > 0"), "dataset_id", "experiments_without_dataset"),
    ])


def g2_metric_drift(s, d):
    runs = raw(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") / 1000).alias("accuracy"), F.format_string('{"accuracy": %s}', ((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)) / 1000).cast("string")).alias("metrics"))
    return G.metric_drift(runs, "accuracy", "metrics").select("s_suppkey", "accuracy", "stored")


def g3_backfilled(s, d):
    runs = raw(s, d, "supplier").select("s_suppkey", F.lit(0.0).alias("accuracy"), F.when(F.col("s_suppkey") % 2 == 0, F.format_string('{"accuracy": 0.%03d}', F.col("s_suppkey") % 1000)).alias("metrics"))
    return G.backfilled(runs, ["accuracy"], "metrics").select("s_suppkey", "accuracy")


def g4_model_survivors(s, d):
    models = raw(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("provider"), (F.col("s_suppkey") % 7).alias("model_id"), (1000 - F.col("s_suppkey")).alias("created_at"))
    used = raw(s, d, "lineitem").where("l_suppkey % 11 = 0").select(F.col("l_suppkey").alias("model"))
    return G.model_survivors(models, used)


def g7_duplicates(s, d):
    return G.duplicates(raw(s, d, "lineitem"), ["l_suppkey", "l_partkey"])


def g8_redaction(s, d):
    red = G.redacted(F.col("text"))
    return raw(s, d, "documents").select("doc_id", F.regexp_count(red, F.lit(r"\[REDACTED\]")).cast("long").alias("n_marks")).where("n_marks > 0")


def g9_reference_counts(s, d):
    return G.reference_counts(view(s, d, "models"), ["dataset_id", "benchmark_id", "model_id"])


def g10_history(s, d):
    events = raw(s, d, "events").select("event_id", F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("ts").alias("created_at"))
    first = events.groupBy().agg(F.min("entity_id").alias("m")).first()["m"]
    return G.history(events, "view", first, 20).select("event_id", "entity_id")


def g11_tenant_scope(s, d):
    return G.scoped(view(s, d, "models"), 1).select("experiment_id", "organization_id")


def g12_seed_defaults(s, d):
    have = view(s, d, "models").where("model_id < 10").select("provider", "model_id").distinct()
    defaults = view(s, d, "models").select("provider", "model_id").distinct()
    return G.seeded(have, defaults, ["provider", "model_id"])


def g13_provider_names(s, d):
    models = view(s, d, "models").select("experiment_id", F.lower("provider").alias("provider"))
    return G.renamed_providers(models, {"china": "east", "japan": "east"}).groupBy("provider").agg(F.count("*").alias("n"))


def g14_due_schedules(s, d):
    rows = raw(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "daily").when(F.col("o_orderkey") % 3 == 1, "weekly").otherwise("monthly").alias("schedule"), (F.col("o_orderkey") % 2 == 0).alias("active"), F.col("o_orderdate").cast("date").alias("next_run_at"))
    return G.due_schedules(rows, F.lit("1996-01-01").cast("date")).select("o_orderkey", "following_run")


def g15_notifications(s, d):
    events = view(s, d, "result_stream").select("event_id", (F.col("experiment_id") % 4).alias("project_id"), "status")
    subs = raw(s, d, "nation").select(F.col("n_nationkey").alias("sub_id"), (F.col("n_nationkey") % 4).alias("project_id"), (F.col("n_nationkey") % 5 != 0).alias("active"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("completed"), F.lit("failed"))).otherwise(F.array(F.lit("failed"))).alias("events"))
    return G.notifications(events, subs).groupBy("sub_id", "status").agg(F.count("*").alias("n"))


def g16_bounded_errors(s, d):
    return raw(s, d, "documents").select("doc_id", G.bounded_error(F.col("text")).alias("kept"))


def t8_rate_limit_streaks(s, d):
    return G.longest_streaks(view(s, d, "eval_results"), F.coalesce(F.col("error").startswith("rate limited"), F.lit(False)), 3)


ROWS = "SELECT row_idx AS idx, question, answer, CASE WHEN row_idx%7=0 THEN ' ' ELSE category END AS category, size FROM dataset_rows"
TOKENS = "CAST(FLOOR((LENGTH(text)+3)/4) AS BIGINT)"
BASE = "SELECT dataset_id, CAST(FLOOR(row_idx/4.0) AS BIGINT) AS idx, question FROM dataset_rows"
SIZE = "(SELECT COUNT(*) FROM b AS c WHERE c.dataset_id=b.dataset_id)"
SECOND = f"SELECT dataset_id, {{}} AS version, idx, question FROM b WHERE dataset_id>{{}} UNION ALL SELECT dataset_id, {{}}, {SIZE}+idx, question FROM b WHERE dataset_id>{{}} AND idx<10"
VERSIONS = f"SELECT dataset_id, 1 AS version, idx, question FROM b UNION ALL {SECOND.format(2, 0, 2, 0)} UNION ALL {SECOND.format(3, 1, 3, 1)} UNION ALL SELECT dataset_id, 3, {SIZE}+10+idx, question FROM b WHERE dataset_id>1 AND idx<20 UNION ALL SELECT dataset_id, 3, idx, question FROM b WHERE dataset_id=1 AND idx<5"
ORACLE = {
    "d1_column_order": "SELECT * FROM (VALUES ('question',0),('answer',1),('category',2),('size',3)) t(name, position)",
    "d2_profile": oracle("SELECT name, (SELECT COUNT(*) FROM src) AS n_rows, CASE name WHEN 'category' THEN (SELECT COUNT(*) FROM src WHERE TRIM(category)='') WHEN 'absent' THEN (SELECT COUNT(*) FROM src) ELSE CAST(0 AS BIGINT) END AS n_blank FROM (VALUES ('question'),('answer'),('category'),('size'),('absent')) t(name)", src=ROWS),
    "d3_inferred_contract": oracle("SELECT name, role, (SELECT COUNT(*) FROM src) AS n_rows, CASE name WHEN 'category' THEN (SELECT COUNT(*) FROM src WHERE TRIM(category)='') ELSE CAST(0 AS BIGINT) END AS n_blank FROM (VALUES ('question','input'),('answer','expected'),('category','input'),('size','input')) t(name, role)", src=ROWS),
    "d4_split_roles": oracle("SELECT row_idx AS idx, '{\"question\":\"' || question || '\",\"size\":\"' || size || '\"}' AS input, '{\"answer\":\"' || answer || '\"}' AS expected FROM dataset_rows"),
    "d5_missing_required": oracle("SELECT idx, 'category' AS field, 'required' AS code FROM src WHERE TRIM(category)=''", src=ROWS),
    "d6_type_errors": oracle("SELECT idx, 'answer' AS field, 'type' AS code FROM src WHERE TRY_CAST(answer AS DOUBLE) IS NULL", src=ROWS),
    "d8_import_errors": oracle("SELECT field, idx, code, turn FROM (SELECT idx, 'category' AS field, 'required' AS code, 0 AS turn FROM src WHERE TRIM(category)='' UNION ALL SELECT idx, 'answer', 'type', 1 FROM src) ORDER BY turn, idx, field LIMIT 150", src=ROWS),
    "d10_empty_rows": oracle("SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (TRIM(question)='' AND TRIM(answer)='') AS n_empty, COUNT(*) FILTER (TRIM(category)='') AS n_missing FROM src", src=ROWS),
    "d12_dense_index": "SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice)-1 AS idx FROM orders",
    "d13_appended_version": oracle("SELECT dataset_id, COUNT(*)+COUNT(*) FILTER (idx<10) AS n, MAX(idx)+1+MAX(idx) FILTER (idx<10) AS last_idx FROM (SELECT dataset_id, CAST(FLOOR(row_idx/4.0) AS BIGINT) AS idx FROM dataset_rows) GROUP BY 1"),
    "d13_manifest_versions": oracle("SELECT dataset_id, CAST(version AS INT) AS version, COUNT(*) AS n, MAX(idx) AS last_idx, COUNT(DISTINCT idx) AS n_idx FROM v GROUP BY 1, 2", b=BASE, v=VERSIONS),
    "d14_rolled_back": oracle("SELECT dataset_id, CAST(version AS INT) AS version, idx, question FROM v WHERE version=CASE dataset_id WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 2 END", b=BASE, v=VERSIONS),
    "d14_active_version": oracle("SELECT dataset_id, CASE WHEN dataset_id=1 THEN MIN(dataset_version) ELSE MAX(dataset_version) END AS version FROM models GROUP BY 1"),
    "d15_content_hash": "SELECT w.project_id, w.content_hash, w.idempotency_key, s.same_as FROM (SELECT doc_id%2 AS project_id, 'k' || doc_id AS idempotency_key, SHA256(text) AS content_hash FROM documents WHERE doc_id%3=0) w LEFT JOIN (SELECT doc_id%2 AS project_id, SHA256(text) AS content_hash, MIN(doc_id) AS same_as FROM documents WHERE doc_id%3<>0 GROUP BY 1, 2) s USING (project_id, content_hash)",
    "d17_row_signals": oracle("SELECT 'empty_output' AS code, COUNT(*) AS n_rows, MIN(row_idx) AS first_row FROM answer_pairs WHERE TRIM(output)='' GROUP BY 1"),
    "d19_stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY MD5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r<=20",
    "d21_deduplicated": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT MIN(doc_id) FROM documents WHERE REGEXP_MATCHES(text,'\\S') GROUP BY LOWER(TRIM(REGEXP_REPLACE(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))))",
    "p1_template_variables": "SELECT p_partkey, SUBSTRING(p_brand,1,5) || ',a.b,items.0' AS vars FROM part",
    "p2_rendered": oracle("SELECT idx, 'Q: ' || question || ' [' || size || '] {keep} ' AS prompt FROM src", src=ROWS),
    "p4_missing_variables": oracle("SELECT idx, 'absent' AS missing FROM src", src=ROWS),
    "p6_message_chains": oracle("SELECT conv_id, CAST(COUNT(*) AS INT) AS n_turns, BOOL_AND(role IN ('system','user','assistant')) AS valid, ARG_MIN(role, turn) AS first_role, LENGTH(ARG_MAX(text, turn)) AS last_length FROM chat_turns GROUP BY 1"),
    "p7_estimated_tokens": f"SELECT doc_id, {TOKENS} AS est_tokens FROM documents",
    "p8_context_overflow": f"SELECT doc_id, {TOKENS}+100 AS needed, {TOKENS}+100 > CASE WHEN doc_id%2=0 THEN 400 ELSE 2000 END AS overflow FROM documents",
    "p10_row_cost": "SELECT l_suppkey, FLOOR(SUM(FLOOR((FLOOR(l_quantity)/1000*0.5 + FLOOR(l_quantity)*2/1000*CASE WHEN l_suppkey%2=0 THEN 1.5 ELSE 0 END)*1000000+0.5)/1000000)*10000+0.5)/10000 AS cost FROM lineitem GROUP BY 1",
    "p12_price_catalog": "SELECT 'm' || s_suppkey || CASE WHEN s_suppkey%10=0 THEN ':free' ELSE '' END AS model_id, s_name AS name, FLOOR((s_suppkey%100)/1e6*1000*1e9+0.5)/1e9 AS input_per_1k, FLOOR((s_suppkey%7)/1e6*1000*1e9+0.5)/1e9 AS output_per_1k, s_suppkey%10=0 OR s_suppkey=7 AS free FROM supplier",
    "p13_fan_out": oracle("SELECT * FROM (SELECT DISTINCT model_id FROM models) CROSS JOIN (SELECT DISTINCT dataset_id, benchmark_id FROM models)"),
    "g1_integrity_report": oracle("SELECT 'results_without_experiment' AS \"check\", COUNT(*) AS n FROM eval_results WHERE experiment_id NOT IN (SELECT experiment_id FROM models WHERE experiment_id%10<>3) UNION ALL SELECT 'results_without_row', COUNT(*) FROM eval_results WHERE row_idx NOT IN (SELECT row_idx FROM dataset_rows WHERE row_idx%7<>1) UNION ALL SELECT 'experiments_without_dataset', COUNT(*) FROM models WHERE dataset_id NOT IN (SELECT dataset_id FROM dataset_rows WHERE dataset_id>0)"),
    "g2_metric_drift": "SELECT s_suppkey, s_suppkey/1000.0 AS accuracy, (s_suppkey+1)/1000.0 AS stored FROM supplier WHERE s_suppkey%5=0",
    "g3_backfilled": "SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN (s_suppkey%1000)/1000.0 ELSE 0.0 END AS accuracy FROM supplier",
    "g4_model_survivors": "SELECT id, COALESCE(MIN(id) FILTER (used) OVER w, FIRST_VALUE(id) OVER (PARTITION BY provider, model_id ORDER BY created_at, id)) AS survivor FROM (SELECT s_suppkey AS id, s_suppkey%3 AS provider, s_suppkey%7 AS model_id, 1000-s_suppkey AS created_at, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey%11=0) AS used FROM supplier) WINDOW w AS (PARTITION BY provider, model_id)",
    "g7_duplicates": "SELECT l_suppkey, l_partkey, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*)>1",
    "g8_redaction": "SELECT doc_id, n_marks FROM (SELECT doc_id, LEN(REGEXP_EXTRACT_ALL(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) + LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(REGEXP_REPLACE(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '', 'g'), '[0-9]+'), lambda x: REGEXP_FULL_MATCH(x, '1[3-9][0-9]{9}'))) AS n_marks FROM documents) WHERE n_marks>0",
    "g9_reference_counts": oracle("SELECT 'dataset_id' AS component, CAST(dataset_id AS BIGINT) AS id, COUNT(*) AS n FROM models GROUP BY 2 UNION ALL SELECT 'benchmark_id', CAST(benchmark_id AS BIGINT), COUNT(*) FROM models GROUP BY 2 UNION ALL SELECT 'model_id', CAST(model_id AS BIGINT), COUNT(*) FROM models GROUP BY 2"),
    "g10_history": "SELECT event_id, user_id AS entity_id FROM events WHERE event_type='view' AND user_id=(SELECT MIN(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 20",
    "g11_tenant_scope": oracle("SELECT experiment_id, organization_id FROM models WHERE organization_id=1"),
    "g12_seed_defaults": oracle("SELECT DISTINCT provider, model_id FROM models"),
    "g13_provider_names": "SELECT CASE WHEN n_name IN ('CHINA','JAPAN') THEN 'east' ELSE LOWER(n_name) END AS provider, COUNT(*) AS n FROM nation JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1",
    "g14_due_schedules": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey%3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS INT) AS DATE) AS following_run FROM orders WHERE o_orderkey%2=0 AND CAST(o_orderdate AS DATE)<=DATE '1996-01-01'",
    "g15_notifications": oracle("SELECT sub_id, status, COUNT(*) AS n FROM (SELECT experiment_id%4 AS project_id, status FROM result_stream) JOIN (SELECT n_nationkey AS sub_id, n_nationkey%4 AS project_id, n_nationkey%2=0 AS even FROM nation WHERE n_nationkey%5<>0) USING (project_id) WHERE status='failed' OR (even AND status='completed') GROUP BY 1, 2"),
    "g16_bounded_errors": "SELECT doc_id, SUBSTR(text, 1, 500) AS kept FROM documents",
    "t8_rate_limit_streaks": oracle("SELECT experiment_id, MAX(run) AS longest, MAX(run)>=3 AS tripped FROM (SELECT experiment_id, island, COUNT(*) AS run FROM (SELECT experiment_id, f, SUM(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY experiment_id ORDER BY row_idx) AS island FROM (SELECT experiment_id, row_idx, COALESCE(error LIKE 'rate limited%', FALSE) AS f FROM eval_results)) WHERE f GROUP BY 1, 2) GROUP BY 1"),
}
