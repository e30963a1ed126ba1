"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash of the whole record; pass two puts each
bucket in hash order, shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes it. The running row
count of the buckets makes one global order of it, which is dealt to the shards in turn, so that shard sizes in rows
differ by one at most (law `rows`).

The hash and size of each record are stored once. From them come the number of buckets, their row counts, and their
places in the global order (sums over runs of buckets, then within each run), which meet the rows by a join on the bucket.

Wholly equal rows have one hash. Where they fill more than a bucket, they are counted instead of moved, numbered, and
made again: the number takes part in the hash, so that they spread over all buckets like any other rows.

Defined cases: null ids and texts are hashed as nulls and kept; repeated rows are all kept and take slots of their own;
an empty table gives an empty result; the record travels inside a struct, so columns of any name are safe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import fresh_path, stored

SEED = 20240817
BUCKET_BYTES = 8 << 20
#: Buckets whose row counts one task sums up, and copies of a row that one task makes.
RUN, COPIES = 4096, 1 << 14
#: Repeated records that are broadcast at most; more are joined by their hash.
FEW = 1000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = list(range(n))
    draws = rng.random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int, shards: int):
    def shuffle(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("copy", "ascending")])
        base, bucket = group["base"][0].as_py(), group["bucket"][0].as_py()
        perm = fisher_yates(len(group), np.random.default_rng([seed, bucket]))
        rank = base + np.arange(len(group), dtype=np.int64)
        return pa.table({"record": group["record"].take(pa.array(perm)), "shard": pa.array((rank % shards).astype(np.int32)), "slot": pa.array(rank // shards), "bucket": pa.array(np.full(len(group), bucket, np.int32))})

    return shuffle


def record_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns; maps count as their sorted entries."""
    return F.xxhash64(F.lit(seed), *[F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields])


def bucket_bases(counts: DataFrame) -> DataFrame:
    """(bucket, base) of (bucket, n): the rows of all buckets before, by runs of RUN buckets."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("run").agg(F.sum("n").alias("total")).select("run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(starts, "run").select("bucket", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))


def _numbered(copies: DataFrame) -> DataFrame:
    """Each row of copies n times with a number `copy`, in tasks of COPIES rows each."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    spread = copies.withColumn("at", parts)
    spread = spread.repartition(F.col("h"), F.col("at"))
    return spread.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("at") + COPIES, F.col("n")) - 1))).drop("at", "n")


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(record, shard, slot, bucket): every row of docs as a struct, with its shard and its place in it.

    key and text: columns of which the text gives a row's size; the others count as 64 bytes.
    """
    signs = stored(docs.select(record_hash(docs, seed).alias("h"), (F.coalesce(F.octet_length(text), F.lit(0)) + 64).cast("long").alias("size")), "shard-signs")
    total = signs.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    # of n bytes no more than n / bucket_bytes records can fill a bucket by their repeats
    repeated = stored(signs.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where((F.col("size") > bucket_bytes) & (F.col("n") > 1)).select("h", "n"), "shard-repeats")
    many = repeated.count()
    known = F.broadcast(repeated.select("h")) if many <= FEW else repeated.select("h")
    spread = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("h", "copy"), F.lit(buckets)).cast("int"))
    rows = docs.select(F.struct("*").alias("record"), record_hash(docs, seed).alias("h")).withColumn("copy", F.lit(0).cast("long"))
    if many:
        same = rows.join(known, "h").groupBy("h", "record").agg(F.count("*").alias("n"))
        rows = rows.join(known, "h", "left_anti").unionByName(_numbered(same))
        counted = signs.select("h", F.lit(0).cast("long").alias("copy")).join(known, "h", "left_anti").unionByName(_numbered(repeated))
    else:
        counted = signs.select("h", F.lit(0).cast("long").alias("copy"))
    bases = bucket_bases(stored(spread(counted).groupBy("bucket").agg(F.count("*").alias("n")), "shard-counts"))
    rows = spread(rows).withColumn("order", F.xxhash64(F.lit(seed + 1), "h")).join(bases, "bucket").select("bucket", "base", "order", "copy", "record")
    schema = T.StructType([T.StructField("record", docs_struct(docs)), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return rows.groupBy("bucket").applyInArrow(_shuffled(seed, shards), schema)


def docs_struct(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards under path, a folder shard=K each, and read them back; slot gives the order in a shard."""
    out = sharded(docs, **options)
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shard_documents(docs: DataFrame) -> DataFrame:
    """The digest of the written shards."""
    back = write_shards(docs, fresh_path(docs.sparkSession, "shards"))
    text = F.col("record.text")
    return back.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
