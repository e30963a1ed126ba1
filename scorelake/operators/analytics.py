"""Comparison of experiments: leaderboards, cohorts, failures, subgroups, routing, budgets and report facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.numbers import ratio, rounded
from scorelake.operators.summaries import is_clean

COHORT = ["dataset_id", "dataset_version", "benchmark_id"]
DIMENSIONS = ["accuracy", "avg_latency_ms", "total_cost", "total_tokens", "coverage", "failure_rate"]


#: The statuses of runs that are compared.
FINISHED = ["completed", "partial"]


def finished(summaries: DataFrame) -> DataFrame:
    return summaries.where(F.col("status").isin(FINISHED))


def with_stored_accuracy(summaries: DataFrame, blob: str = "metrics") -> DataFrame:
    """accuracy from its column unless that is null or 0, else from the metrics blob, else 0."""
    stored = F.get_json_object(blob, "$.accuracy").try_cast("double")
    return summaries.withColumn("accuracy", F.coalesce(F.nullif("accuracy", F.lit(0.0)), stored, F.lit(0.0)))


def leaderboard(summaries: DataFrame, experiments: DataFrame, limit: int | None = None) -> DataFrame:
    """Summaries with their dimensions, best accuracy first and cheapest of equals within a cohort. Of summaries that have
    them, a status filters and a metrics blob stands in for an accuracy that is missing."""
    if "status" in summaries.columns:
        summaries = finished(summaries)
    if "metrics" in summaries.columns:
        summaries = with_stored_accuracy(summaries)
    board = summaries.join(experiments, "experiment_id", "left").withColumn("name", F.coalesce("experiment_name", F.col("experiment_id").cast("string")))
    board = board.select("experiment_id", "name", "model_id", "provider", *COHORT, *DIMENSIONS)
    if limit is None:
        return board
    return board.orderBy(*COHORT, F.desc("accuracy"), "total_cost", "experiment_id").limit(limit)


def ranked(board: DataFrame) -> DataFrame:
    """Rank within the cohort; equals in accuracy and cost share it."""
    order = Window.partitionBy(*COHORT).orderBy(F.desc_nulls_last("accuracy"), F.asc("total_cost"))
    return board.withColumn("rank_in_cohort", F.rank().over(order))


def mismatched_fields(pairs: DataFrame) -> DataFrame:
    """pairs: columns a_X and b_X for each cohort field X; the fields in which they differ, and whether none does."""
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in COHORT]))
    return pairs.withColumn("mismatched", F.array_join(differ, ",")).withColumn("comparable", F.size(differ) == 0)


def cohort_pairs(experiments: DataFrame) -> DataFrame:
    """Pairs a < b of experiments of one cohort, by an equi-join on the cohort."""
    a = experiments.select(*COHORT, F.col("experiment_id").alias("a"))
    b = experiments.select(*COHORT, F.col("experiment_id").alias("b"))
    return a.join(b, COHORT).where("a < b")


def first_pairs(experiments: DataFrame) -> DataFrame:
    """(a, b): the least pair a < b of each cohort, which is of its two smallest experiments; no pairs are made for it."""
    own = experiments.dropna(subset=COHORT)
    least = own.groupBy(*COHORT).agg(F.min("experiment_id").alias("a"))
    return own.join(least, COHORT).where(F.col("experiment_id") > F.col("a")).groupBy(*COHORT, "a").agg(F.min("experiment_id").alias("b")).select("a", "b")


def compared(board: DataFrame) -> DataFrame:
    """Long form of a comparison: one row per experiment and dimension."""
    return board.select("experiment_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in DIMENSIONS])).alias("d")).select("experiment_id", "d.dimension", "d.value")


def compared_wide(board: DataFrame) -> DataFrame:
    """Wide form: one row per dimension with the compared experiments and their values as lists in order of id."""
    pairs = F.array_sort(F.collect_list(F.struct("experiment_id", "value")))
    wide = compared(board).groupBy("dimension").agg(pairs.alias("p"))
    return wide.select("dimension", F.transform("p", lambda x: x["experiment_id"]).alias("experiments"), F.transform("p", lambda x: x["value"]).alias("values"))


def is_failure() -> Column:
    return ~is_clean() | (F.col("score") < 1.0)


def failure_cases(results: DataFrame, top: int, per: str | None = "experiment_id") -> DataFrame:
    """The lowest scored or failed rows, first by score and then by row, per experiment or over all."""
    bad = results.where(is_failure())
    order = [F.asc_nulls_first("score"), F.asc("row_idx")]
    if per is None:
        return bad.orderBy(*order).limit(top)
    return bad.withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("place") <= top)


def redacted_cases(cases: DataFrame, sensitive: list[str]) -> DataFrame:
    """Failure cases as they may be shown: declared fields of input and expected masked, and personal data in the output."""
    from scorelake.functions.vectorized import redacted_json
    from scorelake.operators.governance import redacted

    fields = frozenset(sensitive)
    return cases.withColumns({"input": redacted_json(F.col("input"), fields), "expected": redacted_json(F.col("expected"), fields), "output": redacted(F.coalesce("output", F.lit("")))})


def trend(board: DataFrame, when: str = "created_at") -> DataFrame:
    """Runs in time order within their model, with the change of accuracy from the run before."""
    order = Window.partitionBy("model_id").orderBy(when, "experiment_id")
    return board.withColumn("accuracy_delta", rounded(F.col("accuracy") - F.lag("accuracy").over(order)))


def project_summary(summaries: DataFrame, group: str) -> DataFrame:
    """Counts, means, totals, pooled rates and the best run of each project."""
    return summaries.groupBy(group).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("rows_failed") == 0).alias("clean_runs"),
        rounded(F.avg("accuracy")).alias("avg_accuracy"),
        rounded(F.sum("total_cost")).alias("sum_cost"),
        F.sum("total_tokens").alias("sum_tokens"),
        rounded(ratio(F.sum("rows_scored"), F.sum("rows_total"))).alias("pooled_coverage"),
        rounded(ratio(F.sum("rows_failed"), F.sum("rows_total"))).alias("pooled_failure_rate"),
        F.max_by("experiment_id", F.struct(F.col("accuracy"), -F.col("experiment_id"))).alias("best_experiment"),
    )


def subgroups(results: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """Scores by a field of the inputs; rows without it fall under (unlabelled)."""
    joined = results.join(rows.select("row_idx", F.col(field).cast("string").alias("label")), "row_idx", "left")
    label = F.when(F.trim(F.coalesce("label", F.lit(""))) == "", "(unlabelled)").otherwise(F.col("label"))
    clean = is_clean()
    return joined.groupBy(label.alias("subgroup")).agg(
        F.count("*").alias("n_rows"),
        rounded(F.avg(F.when(clean, F.col("score")))).alias("avg_score"),
        F.count_if(clean & (F.col("score") >= 1.0)).alias("n_pass"),
        F.count_if(clean & (F.col("score") < 1.0)).alias("n_fail"),
        F.count_if(~clean).alias("n_error"),
    )


def cohort_joined(results: DataFrame, experiments: DataFrame, *values: str) -> DataFrame:
    """(a, b, row_idx, V_a, V_b) for the rows that two experiments a < b of one cohort share: each result takes its
    cohort along, and one equi-join on (cohort, row_idx) makes all pairs at once."""
    own = results.select("experiment_id", "row_idx", *values).join(experiments.select("experiment_id", *COHORT), "experiment_id")
    side = lambda n: own.select(*COHORT, "row_idx", F.col("experiment_id").alias(n), *[F.col(v).alias(f"{v}_{n}") for v in values])
    return side("a").join(side("b"), [*COHORT, "row_idx"]).where("a < b").drop(*COHORT)


def model_routing(board: DataFrame, floor: float, limit: int | None = None) -> DataFrame:
    """Best run of each model in the dominant cohort: models above the floor by known cost and cost per row, then the weak by
    accuracy. A board with cost_unknown puts models of unknown cost behind the others. One row for each model is ranked."""
    if "status" in board.columns:
        board = finished(board)
    unknown = F.coalesce("cost_unknown", F.lit(False)) if "cost_unknown" in board.columns else F.lit(False)
    sizes = board.groupBy(*COHORT).agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), *COHORT).limit(1)
    best = board.join(F.broadcast(largest.drop("n")), COHORT).withColumn("r", F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("accuracy"), "experiment_id"))).where("r = 1")
    scored = best.withColumns({"cost_per_row": rounded(ratio(F.col("total_cost"), F.col("rows_total")), 9), "qualified": F.col("accuracy") >= floor, "cost_unknown": unknown})
    order = [F.desc("qualified"), F.when(F.col("qualified"), F.col("cost_unknown")), F.when(F.col("qualified"), F.col("cost_per_row")), F.desc("accuracy"), "model_id"]
    if limit is not None:
        scored = scored.orderBy(*order).limit(limit)
    ranked = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return scored.select("model_id", "experiment_id", "accuracy", "cost_per_row", "cost_unknown", "qualified", ranked.alias("route_rank")).withColumn("recommended", F.col("qualified") & (F.col("route_rank") == 1))


def by_provider(board: DataFrame) -> DataFrame:
    return board.groupBy("provider").agg(F.count("*").alias("runs"), F.countDistinct("model_id").alias("models"), rounded(F.avg("accuracy")).alias("avg_accuracy"), rounded(F.sum("total_cost")).alias("sum_cost"))


def top_models(board: DataFrame, top: int) -> DataFrame:
    best = board.groupBy("model_id").agg(F.max("accuracy").alias("best_accuracy"))
    return best.orderBy(F.desc("best_accuracy"), "model_id").limit(top)


def accuracy_series(board: DataFrame, when: str = "created_at") -> DataFrame:
    """(when, experiment_id, accuracy, running_accuracy) of all runs in time order within their model."""
    so_far = Window.partitionBy("model_id").orderBy(when, "experiment_id")
    return board.select("model_id", when, "experiment_id", "accuracy", rounded(F.avg("accuracy").over(so_far)).alias("running_accuracy"))


def running_spend(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(organization_id, day, day_cost, spent, budget, exhausted): what has been spent in the month up to each day."""
    day = F.col("created_at").cast("date")
    daily = costs.groupBy("organization_id", day.alias("day")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("day_cost"))
    so_far = Window.partitionBy("organization_id", F.trunc("day", "month")).orderBy("day")
    out = daily.join(budgets, "organization_id", "left").withColumn("spent", rounded(F.sum("day_cost").over(so_far)))
    return out.withColumns({"day_cost": rounded(F.col("day_cost")), "exhausted": F.coalesce(F.col("spent") >= F.col("budget"), F.lit(False))})


def monthly_budget(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Month-to-date cost of each organization against its budget; null costs are counted as unknown.

    A budget is exhausted by cost, or when some cost is unknown.
    """
    monthly = costs.groupBy("organization_id", F.date_trunc("month", F.col("created_at")).cast("date").alias("month")).agg(rounded(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("month_cost"), F.count_if(F.col("cost").isNull()).alias("unknown_costs"))
    return monthly.join(budgets, "organization_id", "left").withColumn("exhausted", F.col("budget").isNotNull() & ((F.col("month_cost") >= F.col("budget")) | (F.col("unknown_costs") > 0)))


def regressions(board: DataFrame, baseline: DataFrame, threshold: float) -> DataFrame:
    """Runs whose accuracy is below their model's baseline by more than the threshold."""
    return board.join(baseline, "model_id").where(F.col("accuracy") < F.col("baseline") - threshold)


def report_facts(results: DataFrame, summaries: DataFrame, first: int = 5) -> DataFrame:
    """Per experiment its metrics, failure count, and first failures by row order."""
    bad = results.where(is_failure())
    head = bad.withColumn("place", F.row_number().over(Window.partitionBy("experiment_id").orderBy("row_idx"))).where(F.col("place") <= first)
    shown = head.groupBy("experiment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_idx")), lambda x: x.cast("string")), ",").alias("first_failures"))
    counts = bad.groupBy("experiment_id").agg(F.count("*").alias("failure_count"))
    return summaries.select("experiment_id", "accuracy", "total_cost", "rows_total").join(counts, "experiment_id", "left").join(shown, "experiment_id", "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))


def report_totals(facts: DataFrame) -> DataFrame:
    """One row over report facts: counts, totals, and the best, cheapest and most failing runs; ties go to the first id.
    facts: report_facts with name, total_tokens and runtime_ms."""
    lead = lambda order: F.min_by(F.struct("experiment_id", "name", "model", "accuracy", "total_cost", "failure_count"), F.struct(*order, "experiment_id"))
    rated, priced = F.col("accuracy").isNotNull(), F.col("total_cost").isNotNull()
    return facts.agg(
        F.count("*").alias("n"), rounded(F.sum("total_cost")).alias("cost"), F.sum("total_tokens").alias("tokens"), F.sum("failure_count").alias("failures"),
        F.min_by(F.when(rated, F.struct("experiment_id", "name", "model", "accuracy")), F.struct((~rated).alias("x"), -F.col("accuracy"), "experiment_id")).alias("best"),
        F.min_by(F.when(priced, F.struct("experiment_id", "name", "model", "total_cost")), F.struct((~priced).alias("x"), "total_cost", "experiment_id")).alias("cheapest"),
        lead([-F.col("failure_count")]).alias("most_failing"),
    )


def markdown_report(facts: DataFrame) -> DataFrame:
    """(section, title, body) of a report in six sections. One line per run is sorted and joined: a report is read by
    people, and its runs are as many as they want to read; rows of results never come here."""
    number = lambda c, digits=2: F.format_number(c, digits)
    percent = lambda c: F.concat(number(c * 100, 1), F.lit(" %"))
    joined = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("experiment_id", line.alias("t")))), lambda x: x["t"]), "\n")
    named = F.concat(F.col("name"), F.lit(" ("), F.col("model"), F.lit(")"))
    table = F.concat(F.lit("| "), F.concat_ws(" | ", "name", "model", percent(F.col("accuracy")), percent(F.col("coverage")), percent(F.col("failure_rate")), number(F.col("avg_latency_ms")), F.col("rows_scored").cast("string"), F.col("rows_failed").cast("string")), F.lit(" |"))
    price = F.concat(F.lit("- "), F.col("name"), F.lit(": $"), number(F.col("total_cost")), F.lit(", "), F.col("total_tokens").cast("string"), F.lit(" tokens"))
    failed = F.when(F.col("failure_count") > 0, F.concat(F.lit("- "), named, F.lit(": "), F.col("failure_count").cast("string"), F.lit(" rows, the first "), F.coalesce("first_failures", F.lit("unknown"))))
    lines = facts.agg(joined(table).alias("table"), joined(price).alias("prices"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed.isNotNull(), F.struct("experiment_id", failed.alias("t"))))), lambda x: x["t"]), "\n").alias("fails"))
    one = report_totals(facts).crossJoin(lines)  # one row each
    run = lambda c: F.concat(F.col(f"{c}.name"), F.lit(" ("), F.col(f"{c}.model"), F.lit(")"))
    head = "| run | model | accuracy | coverage | failures | latency ms | scored | failed |\n|---|---|---|---|---|---|---|---|\n"
    spent = F.concat(F.lit("Total cost $"), number(F.col("cost")), F.lit(", "), F.col("tokens").cast("string"), F.lit(" tokens."))
    best = F.when(F.col("best").isNotNull(), F.concat(F.lit("\nBest accuracy: "), run("best"), F.lit(", "), percent(F.col("best.accuracy")), F.lit(".")))
    cheap = F.when(F.col("cheapest").isNotNull(), F.concat(F.lit("\nCheapest: "), run("cheapest"), F.lit(", $"), number(F.col("cheapest.total_cost")), F.lit(".")))
    advice = F.concat_ws("\n", F.when(F.col("best").isNotNull(), F.concat(F.lit("Use "), run("best"), F.lit(" where accuracy counts."))), F.when(F.col("cheapest.experiment_id") != F.col("best.experiment_id"), F.concat(F.lit("Consider "), run("cheapest"), F.lit(" where cost counts."))), F.when(F.col("most_failing.failure_count") > 0, F.concat(F.lit("Look into "), run("most_failing"), F.lit(": it has the most failed rows."))))
    none = F.coalesce
    sections = [
        ("Summary", F.concat(F.col("n").cast("string"), F.lit(" runs. "), spent, none(best, F.lit("")), F.when(F.col("failures") > 0, F.concat(F.lit("\nFailed rows: "), F.col("failures").cast("string"), F.lit("."))).otherwise(""))),
        ("Performance", F.concat(F.lit(head), F.col("table"))),
        ("Cost", F.concat(spent, none(cheap, F.lit("")), F.lit("\n"), F.col("prices"))),
        ("Failures", F.when(F.col("fails") != "", F.col("fails")).otherwise("No failed rows were found.")),
        ("Recommendations", F.when(advice != "", advice).otherwise("Run again on a larger dataset.")),
        ("Next steps", F.lit("1. Read performance and failures run by run.\n2. Mend prompts or data of the runs that fail most.\n3. Build this report again.")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("section"), F.lit(title).alias("title"), body.alias("body")) for i, (title, body) in enumerate(sections)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def report_markdown(sections: DataFrame) -> DataFrame:
    """(markdown): the sections of one report as one text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section", "title", "body"))), lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"]))
    return sections.agg(F.concat(F.lit("# Evaluation report\n\n"), F.array_join(parts, "\n\n")).alias("markdown"))


def result_matrix(board: DataFrame, datasets: list[int]) -> DataFrame:
    """Best accuracy of each model on each dataset, one column per dataset."""
    wide = board.groupBy("model_id").pivot("dataset_id", datasets).agg(F.max("accuracy"))
    return wide.select("model_id", *[F.col(str(d)).alias(f"dataset_{d}") for d in datasets])


def filtered(board: DataFrame, equal: dict[str, object], search: str) -> DataFrame:
    """Rows with equality filters and a name search; blank ones do not filter."""
    for column, value in equal.items():
        if value not in (None, "", 0):
            board = board.where(F.col(column) == value)
    return board.where(F.col("experiment_name").ilike(f"%{search}%")) if search else board


def listed(board: DataFrame, equal: dict[str, object], search: str, offset: int, limit: int, when: str = "created_at") -> DataFrame:
    """A page of the filtered rows, newest first, with the total of all of them."""
    rows = filtered(board, equal, search)
    page = rows.orderBy(F.desc(when), F.desc("experiment_id")).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def missing_work(plan: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Planned pairs without a finished run."""
    return plan.join(done, on, "left_anti")
