"""Queries M1-M25 and A23 over the answer pairs, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import cleaning
from scorelake.functions.numbers import rounded
from scorelake.operators import metrics as M
from scorelake.operators import scoring as S
from scorelake.operators.answers import answer_set
from scorelake.sources.fixtures import oracle, raw, view
from scorelake.sources.storage import spread

def _pairs(s, d):
    return spread(view(s, d, "answer_pairs"))


def _cleaned(s, d):
    return _pairs(s, d).withColumn("cleaned", cleaning.clean_prediction(F.col("output")))


def m2_clean_prediction(s, d):
    return _cleaned(s, d).select("row_idx", "cleaned")


def m3_extract_code(s, d):
    fence = "```"
    text = F.concat(F.lit("see\n" + fence + "python\n"), F.col("p_name"), F.lit("\n" + fence + "\nand\n" + fence + "\n"), F.col("p_type"), F.lit("\n" + fence))
    return raw(s, d, "part").select("p_partkey", cleaning.extract_code(F.when(F.col("p_partkey") % 2 == 0, text).otherwise(F.col("p_name"))).alias("code"))


def m4_match_text(s, d):
    return _pairs(s, d).select("row_idx", cleaning.match_text(F.col("output")).alias("norm"))


POLICY = {"aliases": {"x": ["alpha", "beta"]}, "accepted_answers": ["gamma"]}
MANY = {"multi_answer": "set", "partial_credit": True, "aliases": {"red widget": ["ECONOMY", "SMALL"]}}


def _sheets(s, d):
    return spread(view(s, d, "answer_sheets"))


def _raws(s, d):
    """Answer sheets with raw answers as flat objects, nested objects, lists and texts."""
    nested = F.to_json(F.struct(F.struct(F.col("kind").alias("text"), F.lit(1.5).alias("share")).alias("answer"), F.array(F.array("brand")).alias("aliases")))
    listed = F.to_json(F.array("brand", "kind"))
    shapes = F.when(F.col("row_idx") % 4 == 0, F.col("expected_raw")).when(F.col("row_idx") % 4 == 1, nested).when(F.col("row_idx") % 4 == 2, listed).otherwise(F.to_json(F.struct(F.col("kind").alias("label"))))
    return _sheets(s, d).withColumn("expected_raw", shapes)


def m5_answer_candidates(s, d):
    return _raws(s, d).select("row_idx", F.array_join(answer_set(F.col("expected"), POLICY, F.col("expected_raw")).candidates, "|").alias("accepted"))


def m6_required_answers(s, d):
    return _raws(s, d).select("row_idx", F.array_join(answer_set(F.col("expected"), None, F.col("expected_raw")).required, "|").alias("required"))


def m6_split_answers(s, d):
    return raw(s, d, "part").select("p_partkey", F.array_join(M.split_answers(F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(","))), "|").alias("parts"))


def m7_exact_match(s, d):
    return _cleaned(s, d).select("row_idx", M.exact_match(F.col("output"), F.col("expected")).alias("score"))


def m8_exact_match_ci(s, d):
    return _cleaned(s, d).select("row_idx", M.exact_match_ci(F.col("cleaned"), F.col("expected")).alias("score"))


def _uncut(s, d):
    return _sheets(s, d).withColumn("cleaned", cleaning.clean_prediction(F.col("output"), split_commas=False, normalize_whitespace=False))


def m9_multi_answer(s, d):
    """Two required answers, one with aliases: their share, and strictly all of them and nothing else."""
    score = lambda policy: M.exact_match_ci(F.col("cleaned"), F.col("expected"), policy, F.col("expected_raw"))
    return _uncut(s, d).select("row_idx", score(MANY).alias("share"), score({"multi_answer": "all", "reject_extra": True}).alias("strict"))


def m10_multi_contains(s, d):
    score = lambda policy: M.contains(F.col("cleaned"), F.col("expected"), policy, F.col("expected_raw"))
    return _uncut(s, d).select("row_idx", score(None).alias("any"), score(MANY).alias("share"), score({"multi_answer": "all"}).alias("all"))


def m11_multi_f1(s, d):
    score = lambda policy: rounded(M.f1_token(F.col("cleaned"), F.col("expected"), policy, F.col("expected_raw")))
    return _uncut(s, d).select("row_idx", score(None).alias("best"), score(MANY).alias("joined"))


def m12_multi_numeric(s, d):
    """Two numbers are asked for; the output has both, one, or one with a unit and thousands."""
    raw_ = F.concat(F.lit('{"answer": ['), F.col("p_size"), F.lit(', "'), F.format_number(F.col("p_partkey") + 1000, 0), F.lit('"]}'))
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("from "), F.col("p_size"), F.lit(" to "), F.col("p_partkey") + 1000)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("about "), F.format_number(F.col("p_partkey") + 1000, 0), F.lit(" km"))).otherwise("none")
    score = lambda policy: M.numeric_match(said, F.col("p_size").cast("string"), policy, raw_)
    return spread(raw(s, d, "part")).select("p_partkey", score(None).alias("any"), score({"multi_answer": "all", "partial_credit": True}).alias("share"), score({"multi_answer": "all"}).alias("all"))


def m10_contains(s, d):
    return _pairs(s, d).select("row_idx", M.contains(F.col("output"), F.col("expected")).alias("score"))


def m12_numeric_match(s, d):
    text = F.concat(F.lit("about "), F.format_number((F.col("o_orderkey") * 997) % 2000000, 0), F.lit(" units"))
    return spread(raw(s, d, "orders")).select("o_orderkey", M.numeric_match(text, ((F.col("o_orderkey") * 997) % 2000000 + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string")).alias("score"))


def m13_fuzzy_match(s, d):
    return spread(raw(s, d, "part")).select("p_partkey", M.fuzzy_match(F.concat("p_brand", F.lit("x")), F.col("p_brand"), threshold=0.8).alias("near"), M.fuzzy_match(F.col("p_name"), F.col("p_type"), threshold=0.5).alias("far"))


def m16_test_pass_rate(s, d):
    outcomes = raw(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "N").alias("passed"))
    return M.test_pass_rate(raw(s, d, "orders").select("o_orderkey"), outcomes, ["o_orderkey"])


def m17_judge_verdict(s, d):
    said = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ["yes", "NO", "maybe", "Correct"])), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "))
    return raw(s, d, "labels").select("doc_id", M.judge_verdict(said, ["YES", "CORRECT"], ["NO", "INCORRECT"]).alias("verdict"))


def m18_judge_dedup(s, d):
    key = M.judge_key(F.lower(F.col("category")), F.col("answer"), F.lit("m"), F.lit("p"), F.lit("qa"))
    return view(s, d, "dataset_rows").groupBy(key.alias("judge_key")).agg(F.count("*").alias("calls_saved_for"), F.min("row_idx").alias("first_row"))


def m21_weighted_suite(s, d):
    """Weights, one of them zero, and a setting of one metric's own."""
    suite = [{"name": "contains", "weight": 2}, {"name": "f1_token", "weight": 1}, {"name": "fuzzy_match", "weight": 1, "config": {"threshold": 0.5}}, {"name": "exact_match_ci", "weight": 0}]
    scored = S.score_rows(_sheets(s, d), S.ScoringPlan("contains", suite))
    return scored.select("row_idx", "score_contains", rounded(F.col("score_f1_token")).alias("score_f1_token"), "score_fuzzy_match", "score_exact_match_ci", rounded(F.col("score")).alias("score"))


def m22_score_guard(s, d):
    return raw(s, d, "events").select("event_id", M.guarded(F.col("value") / 100).isNotNull().alias("valid"))


def m23_default_metric(s, d):
    kinds = F.create_map(*[F.lit(x) for kv in M.DEFAULT_METRIC.items() for x in kv])
    task = F.element_at(F.array(*map(F.lit, M.DEFAULT_METRIC)), (F.col("row_idx") % 5 + 1).cast("int"))
    return view(s, d, "dataset_rows").groupBy(F.element_at(kinds, task).alias("metric")).agg(F.count("*").alias("n"))


def m24_score_reason(s, d):
    c = F.col("cleaned")
    return _cleaned(s, d).select("row_idx", M.score_reason("exact_match", M.exact_match(c, F.col("expected")), c, F.col("expected")).alias("reason"))


def _lost(sheets):
    return sheets.withColumn("error", F.when(F.col("row_idx") % 10 == 0, "rate limited"))


def m25_score_rows(s, d):
    scored = S.score_rows(_lost(_sheets(s, d)), S.ScoringPlan("exact_match_ci"))
    return scored.select("row_idx", "cleaned", "score", "error_kind")


def m25_generation_rows(s, d):
    """A generation benchmark: outputs keep their commas."""
    scored = S.score_rows(_lost(_sheets(s, d)), S.ScoringPlan("f1_token", benchmark_type="generation"))
    return scored.select("row_idx", "cleaned", rounded(F.col("score")).alias("score"), "error_kind")


def m25_recomputed_rows(s, d):
    """The same benchmark scored again: outputs are cut at the first comma."""
    scored = S.score_rows(_lost(_sheets(s, d)), S.ScoringPlan("f1_token", benchmark_type="generation", mode="recompute"))
    return scored.select("row_idx", "cleaned", rounded(F.col("score")).alias("score"), "error_kind")


def m25_coding_rows(s, d):
    """A coding benchmark: the fenced code is what counts."""
    fence = "```"
    coded = _sheets(s, d).withColumn("output", F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit(f"so, this:\n{fence}python\n"), F.col("expected"), F.lit(f", 1\n{fence}\n"))).otherwise(F.col("output")))
    scored = S.score_rows(coded, S.ScoringPlan("contains", benchmark_type="coding"))
    return scored.select("row_idx", "cleaned", "score")


def _rescored(s, d):
    return S.recomputed(_lost(_sheets(s, d)).withColumn("score", (F.col("row_idx") % 2).cast("double")), S.ScoringPlan("contains", mode="recompute"))


def a23_recompute(s, d):
    known = view(s, d, "answer_sheets").groupBy("experiment_id").agg(F.count("*").alias("n")).select("experiment_id", F.when(F.col("experiment_id") < 2, F.lit(0.25)).alias("stored_accuracy"), F.when(F.col("experiment_id") < 4, F.col("n") + 3 * F.col("experiment_id")).alias("dataset_rows_total"))
    return S.recompute_report(_rescored(s, d), known, 20)


def a23_differences(s, d):
    return S.differences(_rescored(s, d), 20)


# what the fixture's outputs are by construction
SQUEEZED = "REGEXP_REPLACE(CASE row_idx % 6 WHEN 0 THEN expected WHEN 1 THEN UPPER(expected) WHEN 2 THEN expected WHEN 3 THEN expected || CHR(34) WHEN 4 THEN output ELSE '' END, '\\s+', '', 'g')"
NORM = "LOWER(REGEXP_REPLACE(REGEXP_REPLACE(TRIM(output), '[.,!?;:]+$', ''), '\\s+', '', 'g'))"
CI = f"CASE WHEN LOWER({SQUEEZED})=LOWER(REGEXP_REPLACE(expected,'\\s+','','g')) THEN 1.0 ELSE 0.0 END"
UNCUT = "REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_EXTRACT(output, '[^\n]*$'), '^(Final )?Answer: ', ''), '[.!]+$', '')"
CUT = f"REGEXP_REPLACE(TRIM(SPLIT_PART({UNCUT}, ',', 1)), '[.!]+$', '')"
WORDS = "(REGEXP_MATCHES(LOWER(c), '(^|[^a-z0-9])' || LOWER({}) || '($|[^a-z0-9])'))"
HAS_NAME, HAS_KIND, HAS_BRAND = WORDS.format("expected"), WORDS.format("kind"), "(POSITION(LOWER(brand) IN LOWER(c)) > 0)"
ANY = f"CASE WHEN {HAS_NAME} OR {HAS_KIND} OR {HAS_BRAND} THEN 1.0 ELSE 0.0 END"
SHEETS = f"(SELECT *, {UNCUT} AS c, {CUT} AS cut FROM answer_sheets)"
EXACT = "CASE WHEN LOWER(REPLACE({}, ' ', '')) IN (LOWER(REPLACE(expected, ' ', '')), LOWER(brand), LOWER(kind)) THEN 1.0 ELSE 0.0 END"
TOKENS = "REGEXP_EXTRACT_ALL(LOWER({}), '[a-z0-9]+')"


def _f1(got: str, aim: str) -> str:
    """Multiset F1 of two texts in SQL: of each distinct token the lesser count."""
    g, e = TOKENS.format(got), TOKENS.format(aim)
    common = f"COALESCE(LIST_SUM(LIST_TRANSFORM(LIST_DISTINCT({g}), lambda t: LEAST(LEN(LIST_FILTER({g}, lambda x: x=t)), LEN(LIST_FILTER({e}, lambda x: x=t))))), 0)"
    return f"CASE WHEN {common}>0 THEN 2.0*{common}/(LEN({g})+LEN({e})) ELSE 0.0 END"


def _best(got: str) -> str:
    return f"GREATEST({', '.join(_f1(got, x) for x in ('expected', 'brand', 'kind'))})"


def _near(x: str) -> str:
    a, b = "LOWER(REPLACE(c, ' ', ''))", f"LOWER(REPLACE({x}, ' ', ''))"
    return f"(c<>'' AND 1-LEVENSHTEIN({a}, {b})/CAST(GREATEST(LENGTH({a}), LENGTH({b})) AS DOUBLE)>=0.5)"


def _r6(x: str) -> str:
    return f"FLOOR(({x})*1000000+0.5)/1000000"


FUZZY = f"CASE WHEN {_near('expected')} OR {_near('brand')} OR {_near('kind')} THEN 1.0 ELSE 0.0 END"
PARTS = "LIST_TRANSFORM(STRING_SPLIT(c, ','), lambda x: LOWER(REPLACE(x, ' ', '')))"
GIVEN_NAME = f"(LIST_CONTAINS({PARTS}, LOWER(REPLACE(expected, ' ', ''))))"
GIVEN_ALIAS = f"({GIVEN_NAME} OR (expected='red widget' AND (LIST_CONTAINS({PARTS}, 'economy') OR LIST_CONTAINS({PARTS}, 'small'))))"
GIVEN_BRAND = f"(LIST_CONTAINS({PARTS}, LOWER(brand)))"
KIND_OF_ERROR = "CASE WHEN row_idx%10=0 THEN 'provider' END"
RAW_KIND = "CASE row_idx%4 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} ELSE {} END"
RESCORED = f"SELECT experiment_id, row_idx, row_idx%10=0 AS lost, row_idx%2 AS stored, expected, cut, {ANY.replace('(c)', '(cut)')} AS score FROM {SHEETS}"
CONT = "CASE WHEN REGEXP_MATCHES(LOWER(output), '(^|[^a-z0-9])' || LOWER(expected) || '($|[^a-z0-9])') THEN 1.0 ELSE 0.0 END"
ORACLE = {
    "m2_clean_prediction": oracle(f"SELECT row_idx, {SQUEEZED} AS cleaned FROM answer_pairs"),
    "m3_extract_code": "SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN p_name || CHR(10) || CHR(10) || 'and' || CHR(10) || CHR(10) || p_type ELSE p_name END AS code FROM part",
    "m4_match_text": oracle(f"SELECT row_idx, {NORM} AS norm FROM answer_pairs"),
    "m5_answer_candidates": oracle(f"SELECT row_idx, expected || '|' || {RAW_KIND.format("expected || '|' || brand || '|' || kind", "kind || '|' || brand", "brand || '|' || kind", "kind")} || '|alpha|beta|gamma' AS accepted FROM answer_sheets"),
    "m6_required_answers": oracle(f"SELECT row_idx, {RAW_KIND.format("expected || '|' || brand", "kind", "brand || '|' || kind", "expected")} AS required FROM answer_sheets"),
    "m6_split_answers": "SELECT p_partkey, p_brand || '|' || p_type AS parts FROM part",
    "m7_exact_match": oracle("SELECT row_idx, CASE WHEN output=expected THEN 1.0 ELSE 0.0 END AS score FROM answer_pairs"),
    "m8_exact_match_ci": oracle(f"SELECT row_idx, {CI} AS score FROM answer_pairs"),
    "m9_multi_answer": oracle(f"SELECT row_idx, (CAST({GIVEN_ALIAS} AS INT)+CAST({GIVEN_BRAND} AS INT))/2.0 AS share, CASE WHEN {GIVEN_NAME} AND {GIVEN_BRAND} AND LEN({PARTS})=2 THEN 1.0 ELSE 0.0 END AS strict FROM {SHEETS}"),
    "m10_multi_contains": oracle(f'SELECT row_idx, {ANY} AS "any", (CAST({HAS_NAME} AS INT)+CAST({HAS_BRAND} AS INT))/2.0 AS share, CASE WHEN {HAS_NAME} AND {HAS_BRAND} THEN 1.0 ELSE 0.0 END AS "all" FROM {SHEETS}'),
    "m11_multi_f1": oracle(f"SELECT row_idx, {_r6(_best('c'))} AS best, {_r6(_f1('c', "(expected || ' ' || brand)"))} AS joined FROM {SHEETS}"),
    "m12_multi_numeric": 'SELECT p_partkey, CASE WHEN p_partkey%3<2 THEN 1.0 ELSE 0.0 END AS "any", CASE WHEN p_partkey%3=0 THEN 1.0 WHEN p_partkey%3=1 THEN 0.5 ELSE 0.0 END AS share, CASE WHEN p_partkey%3=0 THEN 1.0 ELSE 0.0 END AS "all" FROM part',
    "m10_contains": oracle(f"SELECT row_idx, {CONT} AS score FROM answer_pairs"),
    "m12_numeric_match": "SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN 0.0 ELSE 1.0 END AS score FROM orders",
    "m13_fuzzy_match": "SELECT p_partkey, CASE WHEN 1-levenshtein(p_brand||'x',p_brand)/CAST(LENGTH(p_brand)+1 AS DOUBLE)>=0.8 THEN 1.0 ELSE 0.0 END AS near, CASE WHEN 1-levenshtein(LOWER(REPLACE(p_name,' ','')),LOWER(p_type))/CAST(GREATEST(LENGTH(REPLACE(p_name,' ','')),LENGTH(p_type)) AS DOUBLE)>=0.5 THEN 1.0 ELSE 0.0 END AS far FROM part",
    "m16_test_pass_rate": "SELECT o_orderkey, COALESCE(FLOOR(AVG(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_returnflag='N' THEN 1.0 ELSE 0.0 END)*1000000+0.5)/1000000, 0.0) AS pass_rate FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey GROUP BY o_orderkey",
    "m17_judge_verdict": "SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN 1.0 END AS verdict FROM labels",
    "m18_judge_dedup": oracle("SELECT SUBSTRING(SHA256(CONCAT_WS('|||', LOWER(category), answer, 'm', 'p', 'qa')), 1, 32) AS judge_key, COUNT(*) AS calls_saved_for, MIN(row_idx) AS first_row FROM dataset_rows GROUP BY 1"),
    "m21_weighted_suite": oracle(f"SELECT row_idx, a AS score_contains, {_r6('f')} AS score_f1_token, z AS score_fuzzy_match, e AS score_exact_match_ci, {_r6('(2*a+f+z)/4')} AS score FROM (SELECT row_idx, {ANY} AS a, {_best('c')} AS f, {FUZZY} AS z, {EXACT.format('c')} AS e FROM {SHEETS})"),
    "m22_score_guard": "SELECT event_id, COALESCE(NOT ISNAN(value) AND value/100 BETWEEN 0 AND 1, FALSE) AS valid FROM events",
    "m23_default_metric": oracle("SELECT CASE row_idx%5 WHEN 0 THEN 'exact_match_ci' WHEN 1 THEN 'exact_match_ci' WHEN 2 THEN 'contains' WHEN 3 THEN 'f1_token' ELSE 'contains' END AS metric, COUNT(*) AS n FROM dataset_rows GROUP BY 1"),
    "m24_score_reason": oracle(f"SELECT row_idx, 'exact_match: ' || CASE WHEN c=expected THEN 'matched; cleaned prediction equals expected canonical answer' ELSE 'did not match; cleaned prediction ''' || c || ''' vs expected ''' || expected || '''' END AS reason FROM (SELECT row_idx, expected, {SQUEEZED} AS c FROM answer_pairs)"),
    "m25_score_rows": oracle(f"SELECT row_idx, cut AS cleaned, CASE WHEN row_idx%10<>0 THEN {EXACT.format('cut')} ELSE 0.0 END AS score, {KIND_OF_ERROR} AS error_kind FROM {SHEETS}"),
    "m25_generation_rows": oracle(f"SELECT row_idx, c AS cleaned, CASE WHEN row_idx%10<>0 THEN {_r6(_best('c'))} ELSE 0.0 END AS score, {KIND_OF_ERROR} AS error_kind FROM {SHEETS}"),
    "m25_recomputed_rows": oracle(f"SELECT row_idx, cut AS cleaned, CASE WHEN row_idx%10<>0 THEN {_r6(_best('cut'))} ELSE 0.0 END AS score, {KIND_OF_ERROR} AS error_kind FROM {SHEETS}"),
    "m25_coding_rows": oracle(f"SELECT row_idx, c AS cleaned, {ANY} AS score FROM (SELECT row_idx, expected, brand, kind, CASE WHEN row_idx%2=0 THEN expected || ', 1' ELSE TRIM(output) END AS c FROM answer_sheets)"),
    "a23_recompute": oracle(f"SELECT experiment_id, rows_total, planned AS dataset_rows_total, rows_scored, rows_total-rows_scored AS rows_failed, planned-rows_total AS rows_unprocessed, {_r6('rows_scored/CAST(planned AS DOUBLE)')} AS coverage, {_r6('(rows_total-rows_scored)/CAST(planned AS DOUBLE)')} AS failure_rate, CAST(0 AS BIGINT) AS metric_errors, CASE WHEN experiment_id<2 THEN 0.25 ELSE 0.0 END AS stored_accuracy, {_r6('accuracy')} AS recomputed_accuracy, changed_rows, LEAST(changed_rows, 20) AS changed_shown FROM (SELECT experiment_id, COUNT(*) AS rows_total, COUNT(*) + CASE WHEN experiment_id<4 THEN 3*experiment_id ELSE 0 END AS planned, COUNT(*) FILTER (NOT lost) AS rows_scored, AVG(score) FILTER (NOT lost) AS accuracy, COUNT(*) FILTER (NOT lost AND score<>stored) AS changed_rows FROM rescored GROUP BY 1)", rescored=RESCORED),
    "a23_differences": oracle("SELECT experiment_id, row_idx, CAST(stored AS DOUBLE) AS stored_score, score AS recomputed_score, cut AS cleaned_prediction, expected AS expected_canonical, 'contains: ' || CASE WHEN score>=1 THEN 'matched' ELSE 'did not match' END || '; expected substring matched as a standalone text span' AS score_reason FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY row_idx) AS place FROM rescored WHERE NOT lost AND score<>stored) WHERE place<=20", rescored=RESCORED),
}
