"""Versions of datasets as manifests: a version is a list of stretches of row numbers, each in a batch of files that is
written once and never again.

An append writes its own rows and a manifest line for each dataset that it has; the rows before are named, not copied. A
replacement names its own batch alone. Activating a version, as in a roll-back, writes one pointer. Every change is one small
file in a folder of its own, written last: a change that was killed before is not seen, and its leavings are replaced when
it is run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "dataset_id long, version int, batch long, first long, last long, shift long"
POINTER = "dataset_id long, version int"


def _changes(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """The lines of all changes with their number."""
    typed = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("change", T.LongType())])
    try:
        return spark.read.schema(typed).parquet(f"{folder}/{kind}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(MANIFEST, change): the stretches of every version; rows `first` to `last` of a batch have the numbers moved by shift."""
    return _changes(spark, folder, "manifest", MANIFEST)


def active(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset_id, version): the version that was activated last, a new version being active from its change on."""
    made = manifest(spark, folder).groupBy("dataset_id", "version").agg(F.min("change").alias("change"))
    chosen = _changes(spark, folder, "pointers", POINTER)
    return made.unionByName(chosen.select("dataset_id", "version", "change")).groupBy("dataset_id").agg(F.max_by("version", "change").alias("version"))


def write_version(rows: DataFrame, folder: str, change: int, mode: str = "append") -> None:
    """Make change number `change`, greater than those before: a version of each dataset in rows (dataset_id, idx, ...).

    append: idx, dense from 0, goes on after the active version's; replace: rows are all there is. Only rows are written.
    """
    if mode not in ("append", "replace"):
        raise ValueError("mode must be append or replace")
    spark = rows.sparkSession
    data = f"{folder}/data/batch={change}"
    rows.write.mode("overwrite").partitionBy("dataset_id").parquet(data)
    new = spark.read.schema(rows.schema).parquet(data).groupBy("dataset_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    lines = manifest(spark, folder).where(F.col("change") < change)
    latest = lines.groupBy("dataset_id").agg(F.max("version").alias("latest"))
    new = new.join(latest, "dataset_id", "left").withColumn("version", (F.coalesce("latest", F.lit(0)) + 1).cast("int")).drop("latest")
    if mode == "append":
        now = active(spark, folder)
        old = lines.drop("change").join(now, ["dataset_id", "version"]).join(new.select("dataset_id", F.col("version").alias("next")), "dataset_id")
        end = old.groupBy("dataset_id").agg((F.max(F.col("last") + F.col("shift")) + 1).alias("end"))
        new = new.join(end, "dataset_id", "left").withColumn("shift", F.coalesce("end", F.lit(0))).drop("end")
        kept = old.withColumn("version", F.col("next")).drop("next")
    else:
        new, kept = new.withColumn("shift", F.lit(0)), lines.drop("change").limit(0)
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    out = new.withColumn("batch", F.lit(change)).select(*names).unionByName(kept.select(*names))
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(MANIFEST).fields]
    out.select(*cast).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/change={change}")


def activate(versions: DataFrame, folder: str, change: int) -> None:
    """Make change number `change`: these versions (dataset_id, version) are the active ones."""
    versions.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("version").cast("int").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointers/change={change}")


def read_version(spark: SparkSession, folder: str, schema: T.StructType, versions: DataFrame | None = None) -> DataFrame:
    """The rows of the active versions, or of given ones (dataset_id, version), with version and idx. Stretches are few and
    meet the rows by broadcast; files of other batches and datasets are not read."""
    wanted = active(spark, folder) if versions is None else versions.select("dataset_id", "version")
    lines = manifest(spark, folder).drop("change").join(wanted, ["dataset_id", "version"])
    parts = [f for f in schema.fields if f.name != "dataset_id"]
    table = spark.read.schema(T.StructType([*parts, T.StructField("batch", T.LongType()), T.StructField("dataset_id", T.LongType())])).parquet(f"{folder}/data")
    inside = (table["batch"] == lines["batch"]) & (table["dataset_id"] == lines["dataset_id"]) & F.col("idx").between(F.col("first"), F.col("last"))
    joined = table.join(F.broadcast(lines.withColumnRenamed("version", "_version")), inside)
    return joined.select(table["dataset_id"], F.col("_version").alias("version"), *((F.col("idx") + F.col("shift")).alias("idx") if f.name == "idx" else F.col(f.name) for f in parts))


def version_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset_id, version, n): the rows of every version, from the manifest alone."""
    return manifest(spark, folder).groupBy("dataset_id", "version").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
