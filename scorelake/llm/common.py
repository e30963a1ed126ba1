"""What the operators share: the common folder, Arrow text access, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds at a time.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A local master may go without one: its own folder will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="scorelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: a cut of the lineage that outlives any executor."""
    return stored_at(df, fresh_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(path: str) -> None:
    """Remove what `stored_at` wrote, once nothing reads it any more."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo modulus: the fixed split of rows into folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw, ends


def chunks(ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes; a longer text is a run of its own."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop
        start = stop


#: Odd multiplier of the polynomial hash and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * (out[have - 1 : have] * base)
        have += step
    return out


class Pieces:
    """Hashes of any byte ranges of a chunk: prefix sums of byte * base^position, moved back to position 0."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if not hasattr(Pieces, "_up") or len(Pieces._up) < n:
            Pieces._up, Pieces._down = _powers(_BASE, max(n, CHUNK_BYTES)), _powers(_BASE_INVERSE, max(n, CHUNK_BYTES))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * Pieces._up[: n - 1], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * Pieces._down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a chunk; cuts: the offsets of its texts, from 0."""
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = cuts[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: A key with more than this share of the rows is hot: there are at most 1 / HOT_SHARE of them, few enough to broadcast.
HOT_SHARE = 1e-3
#: Edges up to which connected components join without a look at hot nodes.
PLAIN_EDGES = 1 << 20


def join_with_hot(rows: DataFrame, names: DataFrame, key: str, counted: str, total: int) -> DataFrame:
    """rows joined to names, one row of which tells by `counted` how many of the `total` rows have its key.

    Keys of over HOT_SHARE of the rows meet their names by broadcast, at most 1 / HOT_SHARE of them, and stay where they
    are; all others are dealt by key.
    """
    few = max(1, int(total * HOT_SHARE))
    hot, cold = names.where(F.col(counted) > few).drop(counted), names.where(F.col(counted) <= few).drop(counted)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).union(rows.join(keys, key, "left_anti").join(cold, key))


def connected_components(edges: DataFrame, limit: int = 60, plain: int = PLAIN_EDGES) -> DataFrame:
    """(node, component) of an edge list (a, b): alternating large and small stars until nothing moves.

    Each step rewrites the edges as min-aggregates and equi-joins and is written to the shared folder, so a lost
    executor costs one step; the step before is then removed. The centre of a large star is a hot key: with over `plain`
    edges such nodes are joined by broadcast. Two steps are equal if the number of edges and the sum of their hashes are.
    component is the smallest node that is reachable. Nodes without an edge do not occur.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = fresh_path(spark, "links")
        out = stored_at(df, path)
        return out, path, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least_joined(pairs: DataFrame, total: int) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return pairs.join(least.drop("n"), "a") if total <= plain else join_with_hot(pairs, least, "a", "n", total)

    links, path, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(limit):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least_joined(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = least_joined(large, state[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, old = state, path
        links, path, state = kept(small)
        discard(old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {limit} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
