"""Encodings, JSON roots, copies and layouts of files."""

import os
import tempfile

from pyspark.sql import functions as F

from scorelake.functions.vectorized import redacted_json
from scorelake.operators import analytics, datasets
from scorelake.sources import files


def folder_of(contents):
    folder = tempfile.mkdtemp(prefix="scorelake-test-")
    for name, content in contents.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    return folder


def test_encodings_of_whole_files(spark):
    text = "第一行\r\nsecond ü\n\n最后\n"
    late = ("plain\n" * 5000 + "退款\n").encode("gbk")
    folder = folder_of({"a.txt": text.encode(), "b.txt": text.encode("utf-8-sig"), "c.txt": text.replace("ü", "u").encode("gbk"), "d.txt": text.encode("utf-16"), "e.txt": b"\xff\xff\xff\n", "f.txt": late, "g.txt": b""})
    found = {os.path.basename(r["path"]): r["encoding"] for r in files.file_encodings(spark, folder).collect()}
    assert {k: v for k, v in found.items() if k != "g.txt"} == {"a.txt": "UTF-8", "b.txt": "UTF-8", "c.txt": "GBK", "d.txt": "UTF-16", "e.txt": None, "f.txt": "GBK"}
    lines, errors = files.read_lines(spark, folder)
    got = {}
    for r in lines.collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r["value"])
    want = ["第一行", "second ü", "最后"]
    assert got["a.txt"] == got["b.txt"] == got["d.txt"] == want and got["c.txt"] == [want[0], "second u", want[2]]
    assert len(got["f.txt"]) == 5001 and got["f.txt"][-1] == "退款" and "e.txt" not in got
    assert [os.path.basename(r["path"]) for r in errors.collect()] == ["e.txt"]


def test_json_roots(spark):
    folder = folder_of({"a.json": b'[{"x": 1}, 3, {"y": {"z": [1, 2]}}]', "b.json": b'{"data": [{"x": 2}]}', "c.json": b'{"data": "[1]", "rows": [{"x": 3}]}', "d.json": b'{"other": 1}', "e.json": b"{nojson", "f.json": b'"text"', "g.json": b"[]"})
    got = {}
    for r in files.read_json(spark, folder).collect():
        got.setdefault(os.path.basename(r["path"])[0], []).append((r["idx"], r["input"], r["error"]))
    assert sorted(got["a"]) == [(0, '{"x":1}', None), (1, None, "not a JSON object"), (2, '{"y":{"z":[1,2]}}', None)]
    assert got["b"] == [(0, '{"x":2}', None)] and got["c"] == [(0, '{"x":3}', None)]
    assert got["d"] == got["f"] == [(None, None, "no list of objects")] and got["e"] == [(None, None, "invalid JSON")] and "g" not in got


def test_copies_are_compared_by_content(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    assert files.copied(rows, tempfile.mkdtemp() + "/copy", "k").count() == 0
    other = rows.where("v <> 7").withColumn("v", F.when(F.col("v") == 9, F.lit(-1)).otherwise(F.col("v")))
    assert sorted(map(tuple, files.reconciled(rows, other, "k").collect())) == [(2, 20, 19, False), (4, 20, 20, False)]


def test_results_of_many_experiments_make_few_files(spark):
    path = tempfile.mkdtemp() + "/results"
    rows = spark.range(20_000).select((F.col("id") % 40).alias("experiment_id"), F.col("id").alias("row_idx"), F.lit(1.0).alias("score")).repartition(16)
    files.write_results(rows, path)
    written = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(written) <= 2 * 40


def test_folders_do_not_grow_with_experiments_and_replace_only_theirs(spark, monkeypatch):
    monkeypatch.setattr(files, "PARTS", 4)
    path = tempfile.mkdtemp() + "/results"
    rows = spark.range(400).select((F.col("id") % 50).alias("experiment_id"), F.col("id").alias("row_idx"), F.lit(1.0).alias("score"))
    files.write_results(rows, path)
    files.write_results(rows.where("experiment_id = 3 AND row_idx < 100").withColumn("score", F.lit(0.5)), path)
    assert len([x for x in os.listdir(path) if "=" in x]) == 4
    got = {r["experiment_id"]: (r["n"], r["total"]) for r in spark.read.parquet(path).groupBy("experiment_id").agg(F.count("*").alias("n"), F.sum("score").alias("total")).collect()}
    assert got == {e: (2, 1.0) if e == 3 else (8, 8.0) for e in range(50)}


def test_bucketed_results_join_on_rows_without_an_exchange(spark):
    rows = spark.range(4000).select((F.col("id") % 4).alias("experiment_id"), F.floor(F.col("id") / 4).alias("row_idx"), F.rand(1).alias("score"))
    name = "bucketed_results_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    files.write_bucketed(rows, name, 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        a, b = (spark.table(name).where(F.col("experiment_id") == e).select("row_idx", F.col("score").alias(f"s{e}")) for e in (0, 1))
        joined = a.join(b, "row_idx")
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_redaction_is_off_where_nothing_is_declared(spark):
    df = spark.createDataFrame([('{"question": "电话 13800138000", "answer": "ok"}',)], "j string")
    assert df.select(redacted_json(F.col("j"), frozenset())).first()[0] == '{"question": "电话 13800138000", "answer": "ok"}'
    assert df.select(redacted_json(F.col("j"), frozenset(["x"]))).first()[0] == '{"question":"电话 [REDACTED]","answer":"ok"}'


def test_leaderboard_filters_by_status_and_falls_back_to_the_blob(spark):
    runs = spark.createDataFrame([(1, 0.0, "completed", '{"accuracy": 0.7}'), (2, 0.5, "running", "{}"), (3, None, "partial", "{}"), (4, 0.9, "failed", "{}")], "experiment_id long, accuracy double, status string, metrics string")
    for c in ("avg_latency_ms", "total_cost", "total_tokens", "coverage", "failure_rate"):
        runs = runs.withColumn(c, F.lit(1.0))
    names = spark.createDataFrame([(i, f"run {i}", 1, "p", 0, 1, 0) for i in range(1, 5)], "experiment_id long, experiment_name string, model_id long, provider string, dataset_id long, dataset_version long, benchmark_id long")
    assert [(r["experiment_id"], r["accuracy"]) for r in analytics.leaderboard(runs, names, 10).collect()] == [(1, 0.7), (3, 0.0)]


def test_routing_puts_unknown_costs_behind(spark):
    rows = [(1, 1, 0.82, 0.01, False), (2, 2, 0.95, 5.0, False), (3, 3, 0.6, 0.001, False), (4, 4, 0.99, 0.0, True)]
    board = spark.createDataFrame([(*r, 10, 0, 1, 0) for r in rows], "model_id long, experiment_id long, accuracy double, total_cost double, cost_unknown boolean, rows_total long, dataset_id long, dataset_version long, benchmark_id long")
    got = analytics.model_routing(board, 0.8).orderBy("route_rank").collect()
    assert [r["model_id"] for r in got] == [1, 2, 4, 3] and [r["recommended"] for r in got] == [True, False, False, False]


def test_version_issues_of_expected_answers(spark):
    rows = spark.createDataFrame([(1, 0, '{"q": "a", "_metadata": {"need": "x"}}', '{"answer": "y"}'), (1, 1, '{"q": "", "need": " "}', None), (1, 2, '{"q": "b"}', "{}")], "dataset_id long, idx long, input string, expected string")
    declared = spark.createDataFrame([(1, 3)], "dataset_id long, row_count long")
    found = lambda *a: sorted((r["code"], r["field"], r["n"]) for r in datasets.version_issues(rows, declared, *a).collect())
    assert found(["q", "z"], ["need"], ["q"], ["answer", "expected"]) == [("missing_expected", "answer", 2), ("missing_expected", "expected", 2), ("missing_required", "need", 2), ("missing_variable", "q", 1), ("unmapped_variable", "z", 1)]
    assert found([], [], [], []) == [("no_expected", "", 2)]
