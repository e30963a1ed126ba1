"""Exact cases for the scoring columns and statistics, and the oracle comparison of the relational operators."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import cleaning
from scorelake.operators import datasets, metrics, prompts, scoring, stats

from tests.oracle_check import differences

CLEANED = {
    "答案：40平方厘米": "40",
    "答案：碳（C）": "碳",
    "答案：40，13": "40",
    "面积=40平方米": "40",
    "答案：18 世纪": "18世纪",
    "(A)": "A",
    "{4}": "{4}",
    "thinking it over\nAnswer: Paris\nthat is all": "Paris",
    "Final answer: 1,234": "1,234",
    '"Rome" (the city)': 'Rome"',
    "31元": "31",
    "": "",
}


def one(spark, rows, schema, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clean_prediction(spark):
    got = one(spark, [(k,) for k in CLEANED], "t string", cleaning.clean_prediction(F.col("t")))
    assert dict(zip(CLEANED, got, strict=True)) == CLEANED


@pytest.mark.parametrize(("prediction", "expected", "score"), [("concatenate", "cat", 0.0), ("a cat sat", "cat", 1.0), ("北京大学", "北京", 0.0), ("在 北京 玩", "北京", 1.0), ("x+y=(2)", "(2)", 1.0), ("anything", " ", 0.0)])
def test_contains(spark, prediction, expected, score):
    assert one(spark, [(prediction, expected)], "p string, e string", metrics.contains(F.col("p"), F.col("e"))) == [score]


@pytest.mark.parametrize(("prediction", "expected", "score"), [("选项 B", "B", 1.0), ("B超", "B", 0.0), ("正确答案是 B", "b", 1.0), ("ＡＢＣ", "abc", 1.0), ("C", "B", 0.0)])
def test_option_letters(spark, prediction, expected, score):
    assert one(spark, [(prediction, expected)], "p string, e string", metrics.exact_match_ci(F.col("p"), F.col("e"))) == [score]


@pytest.mark.parametrize(("prediction", "expected", "score"), [("2.5万", "25000", 1.0), ("2.5万", "2.5", 0.0), ("about 1,234 m", "1234", 1.0), ("1e3", "1000", 1.0), ("none", "3", 0.0)])
def test_numeric_match(spark, prediction, expected, score):
    assert one(spark, [(prediction, expected)], "p string, e string", metrics.numeric_match(F.col("p"), F.col("e"))) == [score]


ALL, SET = {"multi_answer": "all"}, {"multi_answer": "set"}
HALF = {"partial_credit": True}
CAPITAL = {"aliases": {"巴黎": ["Paris", "paris"]}}
ANSWERS = [
    ("exact_match_ci", "A", "A", '{"answer": ["A", "B"]}', ALL | HALF, 0.5), ("exact_match_ci", "A, B", "A", '{"answer": ["A", "B"]}', ALL | HALF, 1.0),
    ("exact_match_ci", "B", "A", '{"answer": ["A", "B"]}', SET | HALF, 0.5), ("exact_match_ci", "A", "A", '{"answer": ["A", "B"]}', ALL, 0.0),
    ("exact_match_ci", "BA", "A", '["A", "B"]', SET, 1.0), ("exact_match_ci", "ABC", "A", '["A", "B"]', SET | {"reject_extra": True}, 0.0),
    ("exact_match_ci", "A,B", "A,B", None, SET, 0.0), ("exact_match_ci", "x", "x", '{"answer": [" "]}', SET, 0.0),
    ("exact_match_ci", "asia", "亚洲", '{"answer": "亚洲", "aliases": ["Asia", "亚细亚洲"]}', None, 1.0), ("exact_match_ci", "PARIS", "巴黎", '{"answer": "巴黎"}', CAPITAL, 1.0),
    ("exact_match_ci", "巴黎", "Paris", '{"answer": "Paris"}', {"aliases": ["巴黎"]}, 1.0), ("exact_match_ci", "Paris", "巴黎", '{"answer": "巴黎"}', SET | CAPITAL, 1.0),
    ("exact_match_ci", "东京", "巴黎", '{"answer": "巴黎"}', SET | CAPITAL, 0.0), ("exact_match_ci", "Paris", "巴黎", '{"answer": ["巴黎", "伦敦"]}', ALL | HALF | CAPITAL, 0.5),
    ("exact_match_ci", "热带雨林", "热带", None, None, 0.0), ("exact_match_ci", "two", "one", '{"answer": {"text": ["one", "two"], "n": 3}}', None, 1.0),
    ("exact_match_ci", "True", "x", '{"answer": {"value": true}}', None, 1.0), ("exact_match_ci", "3", "x", '{"other": 3, "label": [[3], null]}', None, 1.0),
    ("contains", "北京", "北京", '{"answer": ["北京", "上海"]}', ALL | HALF, 0.5), ("contains", "北京、上海", "北京", '{"answer": ["北京", "上海"]}', ALL | HALF, 1.0),
    ("contains", "A", "A", '{"answer": ["A", "B"]}', ALL, 0.0), ("contains", "only B here", "A", '{"answer": ["A", "B"]}', None, 1.0), ("contains", "A", "A", '{"answer": ["A"]}', ALL, 1.0),
    ("f1_token", "Lutetia", "Paris", None, {"aliases": ["Lutetia"]}, 1.0), ("f1_token", "A", "A", '{"answer": ["A", "B"]}', ALL, 2 / 3), ("f1_token", "Paris Paris!", "Paris Paris", None, None, 1.0),
    ("numeric_match", "1", "1", '{"answer": ["1", "2"]}', ALL | HALF, 0.5), ("numeric_match", "2, 1", "1", '{"answer": ["1", "2"]}', ALL | HALF, 1.0), ("numeric_match", "1", "1", '{"answer": [1, 2]}', ALL, 0.0), ("numeric_match", "2", "1", "[1, 2]", None, 1.0),
    ("fuzzy_match", "P aris", "paris", None, None, 1.0), ("fuzzy_match", "Pariss", "x", '["Paris"]', None, 1.0), ("fuzzy_match", " ", "", None, None, 0.0), ("fuzzy_match_ci", "London", "Paris", None, None, 0.0),
    ("exact_match", "a", "a", '["b"]', None, 1.0), ("exact_match", "b", "a", '["b"]', None, 0.0), ("exact_match_ci", "x", "x", "{broken", None, 1.0), ("exact_match_ci", "b", "x", '{"answer": "a", "answer": "b"}', None, 1.0),
]


@pytest.mark.parametrize(("metric", "prediction", "expected", "raw", "policy", "score"), ANSWERS)
def test_answer_sets(spark, metric, prediction, expected, raw, policy, score):
    got = metrics.METRICS[metric](F.col("p"), F.col("e"), policy, F.col("r"))
    assert one(spark, [(prediction, expected, raw)], "p string, e string, r string", got) == [pytest.approx(score)]


def test_suite_is_checked():
    for bad in ([{"name": "nope"}], [{"name": "contains"}, {"name": "contains"}], [{"name": "contains", "weight": 0}], [{"name": "contains", "weight": -1}, {"name": "f1_token", "weight": 2}], [{"name": "contains", "weight": "x"}], [{"name": "contains", "config": [1]}], [{"weight": 1}], [{"name": "contains", "weight": float("inf")}]):
        with pytest.raises(ValueError):
            scoring.check_suite(bad)
    assert [w for _, w, _ in scoring.check_suite([{"name": "contains", "weight": 0}, {"name": "f1_token"}])] == [0.0, 1.0]


def test_outputs_are_cleaned_by_metric_type_policy_and_mode(spark):
    text = "Answer: a red apple, a green  pear and 40 kg"
    plan = lambda metric, **more: scoring.ScoringPlan(metric, **more)
    cases = [(plan("exact_match_ci"), "a red apple"), (plan("numeric_match"), "a red apple"), (plan("f1_token"), "a red apple, a green pear and 40"), (plan("contains", policy={"strip_units": False}), "a red apple, a green pear and 40 kg"),
             (plan("exact_match_ci", policy=SET), "a red apple, a green pear and 40"), (plan("f1_token", mode="recompute"), "a red apple"), (plan("f1_token", mode="recompute", policy=ALL), "a red apple, a green pear and 40"), (plan("contains", benchmark_type="coding"), text), (plan("contains", benchmark_type="coding", mode="recompute"), "a red apple")]
    assert one(spark, [(text,)], "t string", *[p.cleaned(F.col("t")) for p, _ in cases]) == [tuple(c for _, c in cases)]
    with pytest.raises(ValueError):
        plan("contains", mode="again")


def test_sentences_are_scored_whole(spark):
    rows = [(1, "The capital is Paris of course", "Paris", None), (2, "A red apple, a green pear and a plum", "green pear", None), (3, "城市发布人才引进政策，最高200万安家补贴。", "城市发布人才引进政策，最高200万安家补贴。", None), (4, "x", "x", "lost")]
    df = spark.createDataFrame(rows, "row_idx long, output string, expected string, error string")
    suite = [{"name": "contains"}, {"name": "f1_token"}, {"name": "fuzzy_match", "weight": 0, "config": {"threshold": 0.1, "unknown": 1}}]
    got = {r["row_idx"]: r for r in scoring.score_rows(df, scoring.ScoringPlan("f1_token", suite, benchmark_type="generation")).collect()}
    assert got[1]["cleaned"] == "The capital is Paris of course" and got[1]["score_contains"] == 1.0 and got[1]["score_f1_token"] == pytest.approx(2 / 7)
    assert got[1]["score"] == pytest.approx((1 + 2 / 7) / 2) and got[1]["score_fuzzy_match"] == 1.0
    assert got[2]["score_contains"] == 1.0 and got[3]["cleaned"] == rows[2][1][:-1] and got[3]["score_f1_token"] == pytest.approx(1.0, abs=0.05)
    assert (got[4]["score"], got[4]["error_kind"]) == (0.0, "provider")


def test_own_metrics_and_their_failures(spark):
    @metrics.register_metric("half_or_wrong")
    def half_or_wrong(prediction, expected, policy=None, raw=None, wrong=2.0):
        return F.when(prediction == "a", 0.5).otherwise(F.lit(wrong))

    try:
        df = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.0), (1, 2, "a", None)], "experiment_id long, row_idx long, output string, score double").withColumn("expected_raw", F.lit('{"answer": "a"}'))
        rescored = scoring.recomputed(df, scoring.ScoringPlan("half_or_wrong", mode="recompute", config={"wrong": 7.0}))
        assert [r["error_kind"] for r in rescored.orderBy("row_idx").collect()] == [None, "metric", None]
        report = scoring.recompute_report(rescored, spark.createDataFrame([(1, 0.25, 4)], "experiment_id long, stored_accuracy double, dataset_rows_total long")).first()
        assert (report["rows_scored"], report["rows_failed"], report["metric_errors"], report["rows_unprocessed"], report["coverage"], report["failure_rate"]) == (2, 1, 1, 1, 0.5, 0.25)
        assert (report["stored_accuracy"], report["recomputed_accuracy"], report["changed_rows"]) == (0.25, 0.5, 1)
        shown = scoring.differences(rescored).collect()
        assert [(r["row_idx"], r["stored_score"], r["recomputed_score"]) for r in shown] == [(2, 0.0, 0.5)]
    finally:
        metrics.METRICS.pop("half_or_wrong")


def test_f1_of_long_texts_is_linear(spark):
    import time
    from collections import Counter

    a, b = " ".join(f"w{i * 7 % 5000}" for i in range(20000)), " ".join(["the"] * 9000 + [f"w{i % 700}" for i in range(11000)])
    df = spark.createDataFrame([(a, b)], "p string, e string").cache()
    df.count()
    score = lambda: one(spark, [(a, b)], "p string, e string", metrics.f1_token(F.col("p"), F.col("e")))[0]
    common = (Counter(a.split()) & Counter(b.split())).total()
    assert score() == pytest.approx(2 * common / 40000)
    began = time.time()
    df.select(metrics.f1_token(F.col("p"), F.col("e"))).collect()
    assert time.time() - began < 3


def test_published_statistics(spark):
    rows = spark.createDataFrame([(12, 2), (9, 3), (0, 3), (8, 18), (24, 5), (0, 0)], "only_a long, only_b long")
    corrected = [r["p_value"] for r in stats.mcnemar_corrected(rows).collect()]
    exact = [r["p_value"] for r in stats.mcnemar_exact(rows).collect()]
    assert corrected[:3] == pytest.approx([0.0162, 0.1489, 0.2482], abs=1e-4) and corrected[5] == exact[5] == 1.0
    assert exact[3:5] == pytest.approx([0.0755, 0.000546], abs=1e-4)
    wilson = stats.wilson(spark.createDataFrame([(243, 280), (98, 169)], "passed long, n long")).collect()
    assert [(r["low"], r["high"]) for r in wilson] == [pytest.approx((0.8232, 0.9026), abs=1e-4), pytest.approx((0.5045, 0.6517), abs=1e-4)]


def test_bootstrap_bounds(spark):
    rows = spark.createDataFrame([(1, float(i % 5 < 3)) for i in range(100)] + [(2, 1.0)] * 5, "experiment_id long, score double")
    got = {r["experiment_id"]: r for r in stats.bootstrap_means(rows).collect()}
    assert got[1]["mean"] == pytest.approx(0.6) and 0.48 < got[1]["ci_low"] < 0.55 < 0.65 < got[1]["ci_high"] < 0.72
    assert got[2]["ci_low"] == got[2]["ci_high"] == 1.0


def test_paired_bootstrap(spark):
    rows = spark.createDataFrame([(1, 2, i, 1.0, 0.0) for i in range(8)] + [(1, 3, i, 1.0, 1.0) for i in range(8)], "a long, b long, row_idx long, score_a double, score_b double")
    got = {r["b"]: r for r in stats.paired_bootstrap(stats.pair_counts(rows)).collect()}
    assert got[2]["diff"] == 1.0 and got[3]["p_value"] == 1.0


def test_significance_report(spark):
    counts = spark.createDataFrame([(1, 2, 1.0, 0.0, 10)] + [(1, 3, 1.0, 1.0, 6), (1, 3, 0.5, 1.0, 2), (1, 3, 1.0, 0.5, 2)], "a long, b long, score_a double, score_b double, n long")
    got = {r["b"]: r for r in stats.significance(counts).collect()}
    assert (got[2]["n"], got[2]["a_mean"], got[2]["a_low"], got[2]["b_mean"], got[2]["diff"]) == (10, 1.0, 1.0, 0.0, 1.0)
    assert got[2]["significant"] and got[2]["mcnemar_significant"] and got[2]["verdict"] == "a better" and got[2]["p_value"] < 0.05
    assert got[3]["diff"] == 0 and not got[3]["significant"] and not got[3]["mcnemar_significant"] and got[3]["verdict"] == "no difference"
    assert got[3]["a_low"] < 0.9 <= got[3]["a_high"] <= 1.0


def test_bootstrap_of_many_distinct_scores(spark):
    import math

    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("experiment_id"), F.rand(5).alias("score")).union(spark.range(50).select(F.lit(2).cast("long"), (F.col("id") / 50)))
    got = {r["experiment_id"]: r for r in stats.bootstrap_means(rows, resamples=400).collect()}
    error = math.sqrt(1 / 12 / 1_000_000)
    assert got[1]["n"] == 1_000_000 and got[1]["mean"] == pytest.approx(0.5, abs=5 * error)
    assert (got[1]["ci_high"] - got[1]["ci_low"]) / (2 * 1.96 * error) == pytest.approx(1.0, abs=0.15) and got[2]["n"] == 50


def test_poisson_draws_agree_with_multinomial_ones(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("experiment_id"), F.round(F.rand(3), 3).alias("score"))
    whole = {r["experiment_id"]: r for r in stats.bootstrap_means(rows).collect()}
    cells = {r["experiment_id"]: r for r in stats.bootstrap_means(rows, cell=100).collect()}
    again = {r["experiment_id"]: r for r in stats.bootstrap_means(rows.repartition(7), cell=100).collect()}
    for e in (0, 1):
        width = whole[e]["ci_high"] - whole[e]["ci_low"]
        assert cells[e]["ci_low"] == pytest.approx(again[e]["ci_low"], abs=1e-12) and cells[e]["mean"] == pytest.approx(whole[e]["mean"])
        assert abs(cells[e]["ci_low"] - whole[e]["ci_low"]) < 0.15 * width and abs(cells[e]["ci_high"] - whole[e]["ci_high"]) < 0.15 * width
    counts = spark.range(2000).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.round(F.rand(1), 4).alias("score_a"), F.round(F.rand(2) * 0.9, 4).alias("score_b"), F.lit(1).alias("n")).groupBy("a", "b", "score_a", "score_b").agg(F.count("*").alias("n"))
    one_, many = (stats.pair_intervals(counts, cell=c).first() for c in (1 << 14, 150))
    for c in ("a_low", "a_high", "b_low", "b_high", "ci_low", "ci_high"):
        assert abs(one_[c] - many[c]) < 0.004 and one_["diff"] == pytest.approx(many["diff"])


def test_pairs_by_bitmaps_equal_a_plain_join(spark, monkeypatch):
    import random
    from collections import Counter

    from scorelake.operators import pairs

    rng = random.Random(6)
    rows = [(e, r, rng.choice([0.0, 0.5, 1.0])) for e in range(12) for r in rng.sample(range(100_000), 60) + list(range(0, 99_000, 3000))]
    rows = list({r[:2]: r for r in rows}.values())
    where = {e: (e % 2, 1, None if e == 11 else 0) for e in range(12)}
    df = spark.createDataFrame(rows, "experiment_id long, row_idx long, score double")
    runs = spark.createDataFrame([(e, *c) for e, c in where.items()], "experiment_id long, dataset_id long, dataset_version long, benchmark_id long")
    of = {(e, r): s for e, r, s in rows}
    want = Counter((a, b, of[a, r], of[b, r]) for a in range(11) for b in range(a + 1, 11) if where[a] == where[b] for r in {r for e, r, _ in rows if e == a} & {r for e, r, _ in rows if e == b})
    for tile, levels in ((256, 64), (2, 64), (256, 2)):
        monkeypatch.setattr(pairs, "TILE", tile)
        assert {tuple(r)[:4]: r["n"] for r in pairs.score_pairs(df, runs, levels=levels).collect()} == want
    wanted = spark.createDataFrame([(0, 2), (1, 3), (0, 1)], "a long, b long")
    got = {(r["a"], r["b"]) for r in pairs.score_pairs(df, runs, wanted).collect()}
    assert got == {(0, 2), (1, 3)}
    plan = pairs.score_pairs(df, runs)._jdf.queryExecution().executedPlan().toString()
    assert "row_idx" not in "".join(line for line in plan.split("\n") if "Join" in line)


def test_runs_of_different_blocks_never_meet(spark, monkeypatch):
    """Records stay short and are sent once where a block has few runs, however many its cohort has."""
    import numpy as np
    import pandas as pd

    from scorelake.operators import pairs

    monkeypatch.setattr(pairs, "TILE", 2)
    made = spark.range(60).selectExpr("1 AS dataset_id", "1 AS dataset_version", "0 AS benchmark_id", "id AS experiment_id", "floor(id / 2) AS block", "explode(array(0.0D, 1.0D)) AS level")
    assert pairs._sides(made).count() == made.count() == 120
    places = [np.array([0, 5, 32767]), np.arange(0, 32768, 3)]
    packed = next(pairs._packed(iter([pd.DataFrame({"places": places})])))["places"]
    assert [len(x) for x in packed] == [6, 4096]
    assert all((pairs._places(x) == y).all() for x, y in zip(packed, places, strict=True))


def test_first_pairs_are_those_of_all_pairs(spark):
    from scorelake.operators import analytics

    runs = spark.range(40).selectExpr("id * 7 % 41 AS experiment_id", "id % 3 AS dataset_id", "1 AS dataset_version", "IF(id = 0, NULL, id % 2) AS benchmark_id").union(spark.sql("SELECT 99L, 9L, 1, 0L"))
    every = analytics.cohort_pairs(runs).groupBy(*analytics.COHORT).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
    first = analytics.first_pairs(runs)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, every.collect())) and first.count() == 6


def test_equally_few_rows_share_their_draws(spark):
    counts = spark.createDataFrame([(a, 100, s, 1.0 - s, 6) for a in range(50) for s in (0.0, 1.0)], "a long, b long, score_a double, score_b double, n long")
    got = {tuple(r)[2:] for r in stats.pair_intervals(counts, resamples=400).collect()}
    assert len(got) == 1 and next(iter(got))[:2] == (12, 0.5)
    draws = stats.shared_draws(12, 400, 42)
    assert draws.shape == (400, 12) and (draws.sum(axis=1) == 12).all() and 3 < draws.max() < 12


def test_rows_of_one_file_are_scored_by_many_tasks(spark):
    from scorelake.plans import evaluation_queries, scoring_queries, source_queries

    names = [(scoring_queries, n) for n in "m9_multi_answer m10_multi_contains m11_multi_f1 m12_multi_numeric m21_weighted_suite m25_coding_rows m25_generation_rows m25_recomputed_rows m25_score_rows m8_exact_match_ci m12_numeric_match m13_fuzzy_match".split()] + [(source_queries, "m11_f1_token")]
    for module, name in names:
        assert getattr(module, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
    plan = evaluation_queries.w1_evaluation_run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_recomputed_scores_are_computed_once(spark):
    rows = spark.createDataFrame([(1, 0, "so red", 0.0, "red"), (1, 1, "blue", 1.0, "red"), (1, 2, "red", 1.0, "red")], "experiment_id long, row_idx long, output string, score double, expected string")
    changed = scoring.differences(scoring.recomputed(rows, scoring.ScoringPlan("contains", mode="recompute")))
    assert "regexp_replace" not in changed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["row_idx"], r["recomputed_score"]) for r in changed.orderBy("row_idx").collect()] == [(0, 1.0), (1, 0.0)]


def test_accuracy_does_not_depend_on_the_order_of_rows(spark):
    from scorelake.functions.numbers import exact_mean
    from scorelake.operators import summaries

    scores = [0.1] * 33 + [0.7] * 18 + [0.3] * 13
    means = set()
    for order in (sorted(scores), sorted(scores, reverse=True), scores[::3] + scores[1::3] + scores[2::3]):
        rows = spark.createDataFrame([(1, s) for s in order], "experiment_id long, score double").coalesce(1).withColumns({"error": F.lit(None).cast("string"), "latency_ms": F.lit(1), "cost": F.lit(0.0), "tokens": F.lit(1)})
        means.add((summaries.run_summary(rows).first()["accuracy"], rows.agg(exact_mean(F.col("score"))).first()[0]))
    assert len(means) == 1 and next(iter(means))[1] == sum(round(10 * s) for s in scores) / 10 / 64
    odd = spark.createDataFrame([(float("nan"),), (1.0,)], "score double").agg(exact_mean(F.col("score")).alias("m"))
    assert odd.where("isnan(m)").count() == 1


def test_contract_and_types(spark):
    assert datasets.infer_contract(["question", "Answer", "domain"])["expected"] == ["Answer"]
    with pytest.raises(ValueError):
        datasets.infer_contract(["q", "answer"], {"expected": ["answer"], "metadata": ["answer"]})
    rows = spark.createDataFrame([(0, '{"score": "abc"}'), (1, '{"score": 42}'), (2, '{"score": true}'), (3, '{"score": " "}'), (4, '{"score": "3.0"}')], "idx long, input string")
    assert sorted(r["idx"] for r in datasets.type_errors(rows, {"score": "number"}).collect()) == [0, 2]
    assert sorted(r["idx"] for r in datasets.type_errors(rows, {"score": "integer"}).collect()) == [0, 2]


def test_templates(spark):
    assert prompts.variables("{a} {b.c} {{no}} {a} {items.0}") == ["a", "b.c", "items.0"]
    got = one(spark, [('{"a": "x", "b": {"c": [1, 2]}, "items": ["p"]}',)], "j string", prompts.rendered("{a}-{b.c}-{items.0}-{{q}}-{z}!", F.col("j")))
    assert got == ["x-[1,2]-p-{q}-!"]


def test_oracles(spark):
    bad = {name: what for name, what in differences(spark, "/root/testdata/sf0.001").items() if what}
    assert not bad


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_all_results_are_written(spark, monkeypatch):
    from scorelake.plans import source_queries
    from scorelake.sources import files

    written = []
    write = files.write_results
    monkeypatch.setattr(files, "write_results", lambda rows, path: (written.append(rows.select("experiment_id").distinct().count()), write(rows, path)))
    sf_dir = "/root/testdata/sf0.01"
    every = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert sum(r["n"] for r in source_queries.s6_write_results(spark, sf_dir).collect()) > every
    assert written == [every, 1] and every > 11


def test_dense_index_of_many_columns(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"x{i}", i / 3, i % 5) for i in range(1000)], "k long, name string, v double, g int").repartition(6)
    for _ in range(2):
        got = datasets.with_dense_index(rows, "k").select("k", "name", "idx").collect()
        assert [r["idx"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1000))
    assert datasets.with_dense_index(rows.limit(0), "k").count() == 0


def test_cleaning_plan_stays_small(spark):
    frame = spark.createDataFrame([("a",)], "t string").select(cleaning.clean_prediction(F.col("t")).alias("c"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 60


def test_case_folds(spark):
    assert one(spark, [("Straße", "ΣΟΦΟΣ", "ﬁn ſo")], "a string, b string, c string", *[cleaning.case_folded(F.col(c)) for c in "abc"]) == [tuple(x.casefold() for x in ("Straße", "ΣΟΦΟΣ", "ﬁn ſo"))]


CANONICAL = {
    '{"answer": "北京"}': "北京", '{"answer": ["", "北京市"]}': "北京市", '{"answer": {"confidence": 0.9, "text": "x"}}': "x", '{"answer": 42}': "42", '{"result": " b "}': "b",
    '{"answer": "", "label": "c"}': "c", '{"answer": null, "other": [null, {"k": true}]}': "", '{"other": [null, {"k": true}]}': "True", "{}": "", '{"a": "", "b": "later"}': "",
}


def test_canonical_expected(spark):
    got = one(spark, [(k,) for k in CANONICAL], "e string", metrics.canonical_expected(F.col("e")))
    assert dict(zip(CANONICAL, got, strict=True)) == CANONICAL


@pytest.mark.parametrize(("said", "tool", "expected", "score"), [
    ('{"name": "search", "arguments": {"q": 1}}', "search", '{"arguments": {"q": "x"}}', 1.0), ('{"tool": "search", "input": "{\\"p\\": 1}"}', "search", '{"arguments": {"q": "x"}}', 0.5),
    ('[{"name": "other"}, {"function": {"name": "search"}}]', "search", "{}", 1.0), ("text ```json\n{\"name\": \"search\"}\n``` more", "search", None, 1.0), ('say {"tool_name": "search", "n": {"a": 1}} so', "search", None, 1.0),
    ('then {"name": "search", "arguments": {"q": {"deep": [1, {"x": 2}]}}} done', "search", '{"arguments": {"q": 1}}', 1.0), ('{"calls": [{"name": "search", "arguments": {}}]}', "search", None, 1.0), ('a } { "x {" } {"name": "search", "note": "}"}', "search", None, 1.0),
    ("search it", "search", None, 0.0), ('{"name": "search"}', "", None, 0.0), (None, "search", None, 0.0), ('{"name": "find"}', "search", None, 0.0),
])
def test_tool_call(spark, said, tool, expected, score):
    assert one(spark, [(said, tool, expected)], "p string, t string, e string", metrics.tool_call(F.col("p"), F.col("t"), raw=F.col("e"))) == [score]


def test_rubrics(spark):
    from scorelake.operators import judges

    dims = judges.rubric([{"name": "Correctness", "weight": 2}, {"name": "Style", "weight": 1}])
    said = ['{"scores": {"correctness": 5, "style": 2}}', "```json\n{\"correctness\": 9}\n```", "correctness: 4\nstyle：1", "nothing", None, '{"scores": {"style": "x"}} correctness = 5']
    got = [None if r is None else round(r, 6) for r in one(spark, [(x,) for x in said], "t string", judges.rubric_scores(F.col("t"), dims, 5)["total"])]
    assert got == [0.8, 0.666667, 0.6, None, None, 0.666667]
    for bad in ([{"name": " "}], [{"name": "a"}, {"name": "A"}], [{"name": "a", "weight": 0}], [{"name": "a", "weight": -1}], [{"name": "?!"}]):
        with pytest.raises(ValueError):
            judges.rubric(bad)
    assert [d["key"] for d in judges.rubric(None, "unknown")] == ["correctness", "completeness"]


def test_similarity_and_nested_redaction(spark):
    from difflib import SequenceMatcher

    from scorelake.functions import vectorized

    assert vectorized.similar("Paris", "paris!", 0.9) == pytest.approx(1.0) and vectorized.similar("", "x", 0.9) == 0.0
    want = 0.9 * SequenceMatcher(None, "abcd", "abxd").ratio()
    assert vectorized.similar("ab cd", "ab xd", 0.9) == pytest.approx(want + 0.1 * 0.5)
    text = '{"phone": 1, "a": ["me@x.org", {"phone": "z", "n": 5}], "t": "13912345678 and 139123456789"}'
    got = one(spark, [(text,)], "j string", vectorized.redacted_json(F.col("j"), frozenset(["phone"])))
    assert got == ['{"phone":"[REDACTED]","a":["[REDACTED]",{"phone":"[REDACTED]","n":5}],"t":"[REDACTED] and 139123456789"}']


def test_f1_of_repeated_tokens(spark):
    cases = [("a a b", "a b b", 2 * 2 / 6), ("北京大学", "北京", 2 * 3 / (7 + 3)), ("", "x", 0.0), ("x", "x", 1.0)]
    for p, e, score in cases:
        assert one(spark, [(p, e)], "p string, e string", metrics.f1_token(F.col("p"), F.col("e")))[0] == pytest.approx(score)


def test_streaks_over_blocks(spark):
    import random

    from scorelake.operators import governance

    rng, rows, want = random.Random(3), [], {}
    for exp in range(8):
        flags, best, run = [rng.random() < (0.9 if exp % 2 else 0.4) for _ in range(60)], 0, 0
        for i, f in enumerate(flags):
            rows.append((exp, 3 * i, f))
            run = run + 1 if f else 0
            best = max(best, run)
        want[exp] = best
    df = spark.createDataFrame(rows, "experiment_id long, row_idx long, f boolean")
    for block in (7, 20, 1 << 20):
        assert {r["experiment_id"]: r["longest"] for r in governance.longest_streaks(df, F.col("f"), 3, block).collect()} == want


def test_change_feed_equals_plain_loop(spark):
    from scorelake.streaming import jobs

    sf_dir = "/root/testdata/sf0.001"
    got = {(r["experiment_id"], r["event_id"]) for r in jobs.settle(jobs.change_feed(jobs.event_stream(spark, sf_dir)), "append").collect()}
    status = {"signup": "queued", "view": "running", "click": "scored", "purchase": "completed"}
    want, last = set(), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        now, seen, ended = last.get(r["user_id"], (None, -1.0, False))
        s, v = status.get(r["event_type"], "failed"), r["value"] or 0.0
        if ended:
            continue
        if s != now or abs(v - seen) > 0.5:
            want.add((r["user_id"], r["event_id"]))
            now, seen = s, v
        last[r["user_id"]] = now, seen, s in ("completed", "failed")
    assert got == want and want


def test_report_has_its_sections_and_leads(spark):
    from scorelake.operators import analytics
    from scorelake.plans import source_queries

    sections = source_queries.a32_markdown_report(spark, "/root/testdata/sf0.001")
    rows = {r["title"]: r["body"] for r in sections.collect()}
    assert list(rows) == ["Summary", "Performance", "Cost", "Failures", "Recommendations", "Next steps"] and all(rows.values())
    runs = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert rows["Summary"].startswith(f"{runs} runs.") and rows["Performance"].count("\n") == runs + 1 and "Best accuracy:" in rows["Summary"]
    assert analytics.report_markdown(sections).first()["markdown"].count("\n## ") == 6


def test_wide_fan_out_and_failing_models(spark, monkeypatch):
    from scorelake.operators import inference

    monkeypatch.setattr(prompts, "FEW", 2)
    models, plan = spark.range(5).withColumnRenamed("id", "model_id"), spark.range(3).withColumnRenamed("id", "dataset_id")
    assert len({tuple(r) for r in prompts.fan_out(models, plan).collect()}) == 15

    def fails(asked):
        raise OSError("no model")

    out = inference.completed(spark.createDataFrame([(1, "p")], "row_idx long, prompt string"), fails).collect()
    assert [(r["answer"], r["error"]) for r in out] == [(None, "no model")]


def test_shared_folder_is_needed_off_a_local_master():
    from scorelake.sources import storage

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_score_reasons(spark):
    rows = [("it's", 'say "it"'), ("a\\b\nc", "x"), ("", "x")]
    got = one(spark, rows, "c string, e string", metrics.score_reason("exact_match", F.lit(0.0), F.col("c"), F.col("e"), finish=F.lit("length")))
    want = [f"exact_match: did not match; cleaned prediction {c!r} vs expected {e!r}" for c, e in rows]
    assert got == [want[0], want[1], want[2] + "; empty_prediction finish_reason=length"]
    parts = metrics.score_reason("suite", F.lit(1.0), F.col("c"), F.col("e"), {"contains": F.lit(1.0), "f1_token": F.lit(0.5)})
    assert one(spark, rows[:1], "c string, e string", parts) == ["suite: matched; weighted metric components: contains=1.0000, f1_token=0.5000"]


def test_few_shot_blocks(spark):
    shots = '["plain", {"question": "q", "context": "c", "label": 2}, {"a": "x", "b": "y"}]'
    assert one(spark, [(shots,)], "j string", prompts.few_shot(F.col("j"))) == ["plain\n\nQ: q\nQ: c\nA: 2\n\nQ: x\nQ: y"]


def test_common_questions_are_judged_once_and_told_by_broadcast(spark):
    """Two questions of most rows, one without a verdict, among rare ones, with and without a cache: each is asked once."""
    from scorelake.operators import judges

    pairs = [("yes", "yes")] * 400 + [("perhaps", "no")] * 300 + [(f"p{i}", f"e{i}") for i in range(40)] + [(None, "x")] * 3
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_idx long, prediction string, expected string").repartition(6)
    asked = spark.sparkContext.accumulator(0)

    def call(prompts):
        def answered(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(answer=["YES" if "yes" in p else "hm" if "perhaps" in p else "NO" for p in batch["prompt"].str.split("PREDICTION|Prediction", regex=True).str[-1]])[["judge_key", "answer"]]

        return prompts.mapInPandas(answered, "judge_key string, answer string")

    out, cache = judges.judged_once(rows, call, "m", "p")
    got = {r["row_idx"]: r["judge_score"] for r in out.collect()}
    assert len(got) == len(pairs) == out.count() and asked.value == 43
    assert {got[i] for i in range(400)} == {1.0} and {got[i] for i in range(400, 700)} == {None} and {got[i] for i in range(700, 743)} == {0.0}
    again, _ = judges.judged_once(rows, call, "m", "p", cache=cache)
    assert {r["row_idx"]: r["judge_score"] for r in again.collect()} == got and asked.value == 44  # only what had no verdict
    rare = rows.where("row_idx >= 700 AND row_idx < 740")
    assert {r["judge_score"] for r in judges.judged_once(rare, call, "m", "p", cache=cache)[0].collect()} == {0.0}
    none = rows.where("row_idx < 0")
    assert judges.judged_once(none, call, "m", "p")[0].columns == out.columns and judges.judged_once(none, call, "m", "p")[0].count() == 0


def test_many_runs_of_few_rows_are_one_tile(spark, monkeypatch):
    """Runs of a block that have few rows each meet in one task, their records are sent once, and the counts are those of a
    plain loop, whether a row is counted in the matrix or written out, in one tile or in several."""
    import random
    from collections import Counter
    from itertools import combinations

    from scorelake.operators import pairs

    rng = random.Random(8)
    rows = {(e, r): rng.choice([0.0, 0.5, 1.0]) for e in range(40) for r in rng.sample(range(1, 70_000, 70), 40) + [0, 40_000]}
    df = spark.createDataFrame([(*k, s) for k, s in rows.items()], "experiment_id long, row_idx long, score double")
    runs = spark.range(40).selectExpr("id AS experiment_id", "id % 2 AS dataset_id", "1 AS dataset_version", "0L AS benchmark_id")
    by_row = {}
    for (e, r), s in rows.items():
        by_row.setdefault((e % 2, r), []).append((e, s))
    want = Counter((*sorted((a, b)), *(s for _, s in sorted([(a, x), (b, y)]))) for found in by_row.values() for (a, x), (b, y) in combinations(found, 2))
    monkeypatch.setattr(pairs, "TILE", 4)
    made = spark.range(40).selectExpr("0 AS dataset_id", "1 AS dataset_version", "0 AS benchmark_id", "id AS experiment_id", "0 AS block", "1.0D AS level", "20 AS n")
    assert pairs._sides(made).count() == 40
    for rows_, hot, shared in ((1 << 19, 16, 1 << 21), (1 << 19, 0, 7), (100, 3, 50), (100, 1 << 20, 1 << 21), (5, 16, 1 << 21)):
        for name, value in (("ROWS", rows_), ("HOT", hot), ("SHARED", shared)):
            monkeypatch.setattr(pairs, name, value)
        assert {tuple(r)[:4]: r["n"] for r in pairs.score_pairs(df, runs).collect()} == want, (rows_, hot, shared)


def test_report_of_pairs_brings_their_counts_together_once(spark):
    """Counts of few scores are neither stored nor joined again, and a result is made once for all pairs with the same rows."""
    from scorelake.operators import pairs

    df = spark.range(3000).selectExpr("id % 30 AS experiment_id", "id DIV 30 AS row_idx", "CAST(id % 3 AS DOUBLE) / 2 AS score")
    runs = spark.range(30).selectExpr("id AS experiment_id", "0 AS dataset_id", "1 AS dataset_version", "0L AS benchmark_id")
    counts, most = pairs.bounded_score_pairs(df, runs)
    assert most == 9
    report = stats.significance(counts, most=most, resamples=200)
    plan = report._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("FlatMapGroups")]
    assert after.count("Exchange") == 1 and "Join" not in after
    plain = {tuple(r)[:2]: tuple(r) for r in stats.significance(counts, resamples=200).collect()}
    assert {tuple(r)[:2]: tuple(r) for r in report.collect()} == plain and len(plain) == 435
    made = []
    finish = lambda drawn, mean: made.append(1) or (mean[0],)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3], "cells": [1, 1, 1], "bucket": [0, 0, 0], "v0": [[0.0, 1.0], [0.0, 1.0], [1.0]], "counts": [[2, 2], [2, 2], [4]]})
    got = next(stats._drawn(["a"], 1, finish, ["mean"], [], 20, 42)(iter([batch[:0], batch[1:], batch]))).to_pylist()
    assert [(r["a"], r["n"], r["mean"]) for r in got] == [(2, 4, 0.5), (3, 4, 1.0)] and len(made) == 2
