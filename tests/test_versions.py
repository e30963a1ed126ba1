"""Dataset versions as manifests, and integrity checks that read each table once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import repair, versions
from scorelake.sources.storage import work_dir

SCHEMA = "dataset_id long, idx long, text string"


def local(folder):
    return folder.removeprefix("file://")


def size_of(folder):
    return sum(os.path.getsize(f"{root}/{n}") for root, _, names in os.walk(local(folder)) for n in names if n.endswith(".parquet"))


def test_versions_against_plain_lists(spark):
    rng, folder = random.Random(1), work_dir(spark)
    kept, active = {}, {}
    for change in range(1, 9):
        if change == 6:
            spec = {1: 1, 2: 2}
            versions.activate(spark.createDataFrame(list(spec.items()), "dataset_id long, version int"), folder, change)
            active |= spec
            continue
        mode = "replace" if change in (1, 4) else "append"
        rows = {d: [f"{change}-{d}-{i}" for i in range(rng.randint(1, 6))] for d in rng.sample([1, 2, 3], 2)} if change > 1 else {1: ["a", "b"], 2: ["c"]}
        df = spark.createDataFrame([(d, i, t) for d, ts in rows.items() for i, t in enumerate(ts)], SCHEMA)
        # a change that was killed half way leaves data behind and is run again
        df.limit(1).write.mode("overwrite").parquet(f"{folder}/data/batch={change}/dataset_id=9")
        versions.write_version(df, folder, change, mode)
        for d, ts in rows.items():
            number = max((v for e, v in kept if e == d), default=0) + 1
            kept[d, number] = (kept.get((d, active.get(d)), []) if mode == "append" else []) + ts
            active[d] = number
    got = {}
    for r in versions.read_version(spark, folder, df.schema, versions.manifest(spark, folder).select("dataset_id", "version").distinct()).orderBy("idx").collect():
        got.setdefault((r["dataset_id"], r["version"]), []).append((r["idx"], r["text"]))
    assert got == {k: list(enumerate(v)) for k, v in kept.items()}
    assert {r["dataset_id"]: r["version"] for r in versions.active(spark, folder).collect()} == active
    now = versions.read_version(spark, folder, df.schema).groupBy("dataset_id").count().collect()
    assert {r["dataset_id"]: r["count"] for r in now} == {d: len(kept[d, v]) for d, v in active.items()}
    assert {(r["dataset_id"], r["version"]): r["n"] for r in versions.version_sizes(spark, folder).collect()} == {k: len(v) for k, v in kept.items()}
    with pytest.raises(ValueError):
        versions.write_version(df, folder, 99, "merge")


def test_an_append_writes_only_its_own_rows(spark):
    folder = work_dir(spark)
    many = spark.range(200_000).select(F.lit(1).cast("long").alias("dataset_id"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    versions.write_version(many, folder, 1, "replace")
    before = size_of(folder)
    versions.write_version(many.where("idx < 10"), folder, 2)
    assert size_of(folder) - before < before / 100
    one = versions.read_version(spark, folder, many.schema)
    assert one.count() == 200_010 and one.agg(F.max("idx"), F.countDistinct("idx")).first() == (200_009, 200_010)


def test_missing_parents_are_counted_in_one_pass_for_each_table(spark):
    rng = random.Random(2)
    ids = lambda n: spark.createDataFrame([(i,) for i in range(n)], "id long")
    ref = lambda n: rng.choice([None, *range(n + 3)])
    runs = [(i, ref(4), ref(5), ref(3), ref(3), ref(6)) for i in range(60)]
    tables = {"projects": ids(4), "models": ids(6)}
    tables["experiments"] = spark.createDataFrame(runs, "id long, project_id long, dataset_id long, benchmark_id long, prompt_id long, model_id long")
    for name, n in (("datasets", 5), ("benchmarks", 3), ("prompts", 3), ("reports", 4)):
        tables[name] = spark.createDataFrame([(i, ref(4)) for i in range(n)], "id long, project_id long")
    tables["dataset_rows"] = spark.createDataFrame([(ref(5),) for _ in range(50)], "dataset_id long")
    tables["experiment_results"] = spark.createDataFrame([(ref(60),) for _ in range(90)], "experiment_id long")
    tables["evaluation_tasks"] = spark.createDataFrame([(ref(60), None if rng.random() < 0.7 else 1) for _ in range(40)], "experiment_id long, experiment_deleted_at long")
    got = {r["check"]: r["n"] for r in repair.missing_parents(tables).collect()}
    want = {}
    for child, column, parent in repair.REFERENCES:
        have = {r["id"] for r in tables[parent].collect()}
        rows = [r for r in tables[child].collect() if child != "evaluation_tasks" or r["experiment_deleted_at"] is None]
        want[f"{child}_missing_{parent.removesuffix('s')}"] = sum(r[column] not in have for r in rows)
    assert got == want and len(got) == 12
