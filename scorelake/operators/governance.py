"""Referential integrity, drift, redaction, schedules and subscriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Personal data, and what replaces it.
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MARK = "[REDACTED]"


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str, name: str, nulls: bool = False) -> DataFrame:
    """(check, n): child rows whose reference is set but has no parent; with nulls, also those where it is not set."""
    ids = parent.select(F.col(key).alias(column)).distinct()
    lost = (child if nulls else child.where(F.col(column).isNotNull())).select(column).join(ids, column, "left_anti")
    return lost.agg(F.lit(name).alias("check"), F.count("*").alias("n"))


def integrity_report(checks: list[tuple[DataFrame, str, DataFrame, str, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [dangling(*c) for c in checks])


def metric_drift(experiments: DataFrame, column: str, blob: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose typed column is off the JSON field of that name."""
    stored = F.get_json_object(blob, f"$.{column}").try_cast("double")
    return experiments.where(stored.isNotNull() & (F.col(column).isNull() | (F.abs(F.col(column) - stored) > tolerance))).withColumn("stored", stored)


def backfilled(experiments: DataFrame, columns: list[str], blob: str) -> DataFrame:
    """Typed columns from their JSON fields where those are set."""
    return experiments.withColumns({c: F.coalesce(F.get_json_object(blob, f"$.{c}").try_cast("double"), F.col(c)) for c in columns})


def model_survivors(models: DataFrame, used: DataFrame) -> DataFrame:
    """(id, survivor): of models with equal (provider, model_id) the referenced ones stay, the smallest id of several;
    else the earliest. One window per pair; the flag comes from a join on distinct referenced ids."""
    flagged = models.join(used.select(F.col("model").alias("id")).distinct().withColumn("used", F.lit(1)), "id", "left")
    order = Window.partitionBy("provider", "model_id").orderBy(F.desc_nulls_last("used"), F.when(F.col("used").isNull(), F.col("created_at")), "id")
    return flagged.select("id", F.first("id").over(order).alias("survivor"))


def repointed(experiments: DataFrame, survivors: DataFrame) -> DataFrame:
    """Experiments whose model_id is the survivor of its model; ids without one stay."""
    moved = experiments.join(survivors.select(F.col("id").alias("model_id"), "survivor"), "model_id", "left")
    return moved.withColumn("model_id", F.coalesce("survivor", "model_id")).select(*experiments.columns)


def bound_versions(experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """Experiments without a dataset version take the current one of their dataset."""
    now = datasets.select("dataset_id", F.col("version").alias("_current"))
    return experiments.join(now, "dataset_id", "left").withColumn("dataset_version", F.coalesce("dataset_version", "_current")).select(*experiments.columns)


def renamed_providers(models: DataFrame, names: dict[str, str]) -> DataFrame:
    """Models with legacy provider names replaced."""
    return models.replace(names, subset=["provider"])


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


# What the status and format columns may hold.
ALLOWED = {"format": ["csv", "tsv", "json", "jsonl", "xlsx"], "status": ["draft", "queued", "running", "completed", "partial", "failed", "cancelled"], "task_status": ["queued", "running", "succeeded", "failed", "cancelled"]}


def invalid_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n) of what the column may not hold; nulls count as invalid."""
    return rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, MARK), PHONE, MARK)


def reference_counts(experiments: DataFrame, components: list[str]) -> DataFrame:
    """(component, id, n): how many experiments refer to each component."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("long").alias("id")) for c in components]))
    return experiments.select(parts.alias("p")).where("p.id IS NOT NULL").groupBy("p.component", "p.id").agg(F.count("*").alias("n"))


def history(events: DataFrame, entity: str, entity_id: int, limit: int) -> DataFrame:
    return events.where((F.col("entity_type") == entity) & (F.col("entity_id") == entity_id)).orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def scoped(rows: DataFrame, organization: int) -> DataFrame:
    """Rows of one organization only."""
    return rows.where(F.col("organization_id") == organization)


def seeded(have: DataFrame, defaults: DataFrame, key: list[str]) -> DataFrame:
    """have with those defaults whose key is missing."""
    return have.unionByName(defaults.join(have, key, "left_anti").select(*have.columns))


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Active schedules that are due, with their next run."""
    # Days of each schedule.
    days = F.when(F.col("schedule") == "daily", 1).when(F.col("schedule") == "weekly", 7).otherwise(30)
    return schedules.where(F.col("active") & (F.col("next_run_at") <= now)).withColumn("following_run", F.date_add(F.col("next_run_at"), days))


def notifications(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events with the active subscriptions of their project that list them."""
    return events.join(subscriptions.where("active"), "project_id").where(F.array_contains("events", F.col("status"))).drop("events", "active")


def bounded_error(text: Column, limit: int = 500) -> Column:
    return F.substring(text, 1, limit)


#: Row numbers of a block: no task orders more rows of one experiment.
BLOCK = 1 << 20


def longest_streaks(rows: DataFrame, flag: Column, limit: int = 10, block: int = BLOCK) -> DataFrame:
    """Longest run of flagged rows of each experiment, by gaps and islands within blocks of row numbers; islands that
    reach the edges of their blocks are put together over the blocks."""
    by = Window.partitionBy("experiment_id", "block").orderBy("row_idx")
    marked = rows.select("experiment_id", "row_idx", F.floor(F.col("row_idx") / block).alias("block"), flag.alias("f")).withColumn("island", F.sum(F.when(F.col("f"), 0).otherwise(1)).over(by))
    last = marked.groupBy("experiment_id", "block").agg(F.max("island").alias("last"))
    islands = marked.where("f").groupBy("experiment_id", "block", "island").agg(F.count("*").alias("run"))
    ends = islands.join(last, ["experiment_id", "block"], "right")
    # of each block: its first and last runs and whether it is one run; few rows per experiment
    edges = ends.groupBy("experiment_id", "block").agg(F.coalesce(F.max(F.when(F.col("island") == 0, F.col("run"))), F.lit(0)).alias("head"), F.coalesce(F.max(F.when(F.col("island") == F.col("last"), F.col("run"))), F.lit(0)).alias("tail"), (F.max("last") == 0).alias("whole"))
    order = Window.partitionBy("experiment_id").orderBy("block")
    grouped = edges.withColumn("group", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(order))
    # a chain: the tail of a broken block, the whole blocks after it, and the head of the next broken one
    tails = grouped.select("experiment_id", "group", F.when(F.col("whole"), F.col("head")).otherwise(F.col("tail")).alias("part"))
    heads = grouped.where("NOT whole").select("experiment_id", (F.col("group") - 1).alias("group"), F.col("head").alias("part"))
    chains = tails.unionByName(heads).groupBy("experiment_id", "group").agg(F.sum("part").alias("run"))
    runs = islands.select("experiment_id", "run").unionByName(chains.select("experiment_id", "run")).where("run > 0")
    return runs.groupBy("experiment_id").agg(F.max("run").alias("longest")).withColumn("tripped", F.col("longest") >= limit)
