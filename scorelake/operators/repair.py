"""Repair of dangling references: models come back from snapshots, orphans go in cascade, and a report counts each step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.sources.storage import stored

# The gateway of each vendor prefix of a model id.
GATEWAYS = {"openai": "openrouter", "anthropic": "openrouter", "google": "openrouter", "deepseek": "deepseek", "qwen": "openrouter", "zhipuai": "openrouter", "tencent": "openrouter", "moonshot": "openrouter", "qiniu": "qiniu"}
#: Child table, column, parent table: every reference there is.
REFERENCES = [
    ("experiments", "project_id", "projects"), ("experiments", "dataset_id", "datasets"), ("experiments", "benchmark_id", "benchmarks"), ("experiments", "prompt_id", "prompts"), ("experiments", "model_id", "models"),
    ("datasets", "project_id", "projects"), ("benchmarks", "project_id", "projects"), ("prompts", "project_id", "projects"), ("reports", "project_id", "projects"),
    ("dataset_rows", "dataset_id", "datasets"), ("experiment_results", "experiment_id", "experiments"), ("evaluation_tasks", "experiment_id", "experiments"),
]


def missing_parents(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n): the rows of each child table whose parent is not there; a null reference counts as dangling, and tasks
    that are marked as of a deleted experiment do not count.

    Each child table is read once. Its rows are first counted by their references, so that what meets the parents is one row
    for each combination; a mask with a bit for each missing parent is then counted for all of them together.
    """
    return reduce(DataFrame.unionByName, [_missing(child, tables) for child in dict.fromkeys(c for c, _, _ in REFERENCES)])


def missing_mask(rows: DataFrame, references: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with mask: bit k is set where the reference of the k-th (column, parents) is null or has no parent (id)."""
    mask = F.lit(0)
    for k, (column, parents) in enumerate(references):
        ids = parents.select(F.col("id").alias(f"_id{k}")).distinct()
        rows = rows.join(ids, F.col(column) == F.col(f"_id{k}"), "left")
        mask = mask.bitwiseOR(F.when(F.col(f"_id{k}").isNull(), 1 << k).otherwise(0))
    return rows.withColumn("mask", mask).drop(*(f"_id{k}" for k in range(len(references))))


def _missing(child: str, tables: dict[str, DataFrame]) -> DataFrame:
    of = [(column, parent) for c, column, parent in REFERENCES if c == child]
    rows = tables[child].where("experiment_deleted_at IS NULL") if child == "evaluation_tasks" else tables[child]
    counted = rows.groupBy(*(column for column, _ in of)).agg(F.count("*").alias("n"))
    masked = missing_mask(counted, [(column, tables[parent]) for column, parent in of])
    sums = masked.agg(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(of))))
    names = [f"{child}_missing_{parent.removesuffix('s')}" for _, parent in of]
    return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"n{k}").alias("n")) for k, name in enumerate(names)))).alias("c")).select("c.*")


def gateway(model: Column) -> Column:
    """The provider of a model id by its vendor prefix; other prefixes stand for themselves."""
    prefix = F.split(F.coalesce(model, F.lit("")), "/")[0]
    known = F.create_map(*[F.lit(x) for pair in GATEWAYS.items() for x in pair])
    return F.coalesce(known[prefix], F.nullif(prefix, F.lit("")), F.lit("unknown"))


def restored_models(experiments: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New model rows (id, name, provider, model_id, pricing) from the snapshots of experiments whose model is gone, and
    (model_id, target) of references that an equal model takes over. Of several lost ids of one model the least comes back."""
    snap = lambda k: F.get_json_object("model_snapshot", f"$.{k}")
    lost = experiments.where(snap("model_id").isNotNull() & F.col("model_id").isNotNull()).join(models.select(F.col("id").alias("model_id")), "model_id", "left_anti")
    lost = lost.groupBy(F.col("model_id").alias("id")).agg(F.min(F.struct(snap("model_id").alias("model_id"), snap("name").alias("name"), snap("pricing").alias("pricing"))).alias("s"))
    lost = lost.select("id", F.coalesce("s.name", "s.model_id").alias("name"), gateway(F.col("s.model_id")).alias("provider"), "s.model_id", F.coalesce("s.pricing", F.lit("{}")).alias("pricing"))
    free = lost.join(models.select("provider", "model_id"), ["provider", "model_id"], "left_anti")
    least = free.groupBy("provider", "model_id").agg(F.min(F.struct("id", "name", "pricing")).alias("m"))
    back = least.select("m.id", "m.name", "provider", "model_id", "m.pricing")
    every = models.select("id", "provider", "model_id").unionByName(back.select("id", "provider", "model_id"))
    equal = every.groupBy("model_id").agg(F.min(F.struct("provider", "id")).alias("t")).select("model_id", F.col("t.id").alias("target"))
    return back, lost.join(back.select("id"), "id", "left_anti").join(equal, "model_id").select(F.col("id").alias("model_id"), "target")


def repaired(tables: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without dangling references, and (step, n) of what was done.

    Models come first, then datasets, experiments and results, then the rest. Each table is read once, with a mark of
    whether each row stays, and written to the shared folder: the count of a step and the steps after it read that.
    """
    out, counts = dict(tables), []

    def told(step: str, n: Column, rows: DataFrame) -> None:
        counts.append(rows.agg(F.lit(step).alias("step"), n.alias("n")))

    def swept(child: str, references: list[tuple[str, str]], step: str) -> None:
        marked = stored(missing_mask(out[child], [(column, out[parent].select("id")) for column, parent in references]))
        told(step, F.count_if(F.col("mask") != 0), marked)
        out[child] = marked.where("mask = 0").select(*tables[child].columns)

    back, moved = restored_models(tables["experiments"], tables["models"])
    back, moved = stored(back), stored(moved)
    told("models_restored", F.count("*"), back)
    out["models"] = tables["models"].unionByName(back, allowMissingColumns=True)
    pointed = stored(tables["experiments"].join(F.broadcast(moved), "model_id", "left"))
    told("models_repointed", F.count("target"), pointed)
    out["experiments"] = pointed.withColumn("model_id", F.coalesce("target", "model_id")).select(*tables["experiments"].columns)
    swept("datasets", [("project_id", "projects")], "datasets_deleted")
    swept("dataset_rows", [("dataset_id", "datasets")], "dataset_rows_deleted")
    swept("experiments", [(column, parent) for child, column, parent in REFERENCES if child == "experiments"], "experiments_deleted")
    swept("experiment_results", [("experiment_id", "experiments")], "experiment_results_deleted")
    for child in ("benchmarks", "prompts", "reports"):
        swept(child, [("project_id", "projects")], f"{child}_deleted")
    tasks = stored(missing_mask(tables["evaluation_tasks"], [("experiment_id", out["experiments"].select("id"))]))
    mark = F.col("experiment_deleted_at").isNull() & (F.col("mask") != 0)
    told("tasks_marked", F.count_if(mark), tasks)
    out["evaluation_tasks"] = tasks.withColumn("experiment_deleted_at", F.when(mark, now).otherwise(F.col("experiment_deleted_at"))).select(*tables["evaluation_tasks"].columns)
    return out, reduce(DataFrame.unionByName, counts)
