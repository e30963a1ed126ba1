"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint has a bit where over half of its word shingles' hashes have it. Equal fingerprints collapse to
one; the distinct ones are cut into two 32-bit segments. Two fingerprints that differ in three bits at most differ in
one bit at most in some segment, so every fingerprint looks up the table of each segment under all keys of the Hamming
ball of radius one around its own key (33 of them), and each match is verified over all 64 bits. Matches under a key
are linked by a spanning forest, not by all pairs, and connected components of the links give the groups.

A segment that over HOT distinct fingerprints share makes large groups under the 33 keys around it. Under such a key the
other segment differs in three bits at most too, so that one of its four bytes is equal: fingerprints meet there under
the key and each of these bytes.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; null ids keep their
fingerprint, and the smallest non-null id of a group names it (null if there is none); repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import connected_components, join_with_hot, stored, text_bytes

SEED = 42
RADIUS = 3
#: Groups of a key up to this size are compared at once, larger ones by a search that leaves a forest.
SMALL = 8
#: Distinct fingerprints with one segment from which its keys are split by a byte of the other.
HOT = 4096
#: Split keys that are broadcast at most; more are joined by key.
FEW = 1 << 18


def fingerprint(raw: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = raw.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(lengths + 1) - 1
        start = stop - lengths
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], SEED) for a, b in zip(start[: len(words) - size + 1].tolist(), stop[size - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, ends = text_bytes(batch["text"])
        view = memoryview(raw)
        found = np.array([fingerprint(bytes(view[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], ["id", "fp"])


def _signed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sides() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs.append(batch["sign"])
            yield batch.select(["id", "text"])

    signs: list[pa.Array] = []
    for found in _fingerprints(sides()):
        yield pa.RecordBatch.from_arrays([found["id"], signs.pop(0), found["fp"]], ["id", "sign", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def _near(values: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ one) <= RADIUS


def _forest(values: np.ndarray) -> list[tuple[np.uint64, np.uint64]]:
    """Links that hold together what is near in one key's group: each value joins what it first reaches."""
    left, edges = values, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = _near(left, one)
            new = left[hit]
            edges += [(one, x) for x in new]
            queue += list(new)
            left = left[~hit]
    return edges


def _verified(keys: np.ndarray, values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that come sorted by key, with whole groups."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    size_of = np.repeat(sizes, sizes)
    ends = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for step in range(1, SMALL):
        i = np.flatnonzero((keys[:-step] == keys[step:]) & (own[:-step] | own[step:]) & (size_of[:-step] <= SMALL)) if len(keys) > step else np.zeros(0, np.int64)
        i = i[np.bitwise_count(values[i] ^ values[i + step]) <= RADIUS]
        ends.append((values[i], values[i + step]))
    for f, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        if own[f : f + n].any():
            found = _forest(np.unique(values[f : f + n]))
            ends.append((np.array([x for x, _ in found], np.uint64), np.array([y for _, y in found], np.uint64)))
    return np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, sorted by key: the tail group of what is at hand waits for what follows."""
    step, held, size = 1 << 16, [], 0

    def flushed(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if not held:
            return
        keys, values, own = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = len(keys) if whole else int(np.searchsorted(keys, keys[-1]))
        a, b = _verified(keys[:cut], values[:cut], own[:cut])
        held, size = [(keys[cut:], values[cut:], own[cut:])] if cut < len(keys) else [], 0
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for part in batches:
        if not len(part):
            continue
        new = (part["key"].to_numpy(zero_copy_only=False), part["fp"].to_numpy(zero_copy_only=False).view(np.uint64), part["own"].to_numpy(zero_copy_only=False))
        going_on = held and new[0][-1] == held[0][0][0]  # one group so far
        held.append(new)
        size += len(part)
        if size >= step and not going_on:
            yield from flushed(False)
    yield from flushed(True)


def near_links(distinct: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp at RADIUS or fewer bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    # the segment's number goes into bit 32 of the key
    tag = F.lit(1 << 32)
    around = [0, *(1 << i for i in range(32))]
    ball = lambda k: [F.struct((k.bitwiseXOR(F.lit(m))).alias("key"), F.lit(m == 0).alias("own")) for m in around]
    dealt = distinct.repartition(parts)
    probes = dealt.select("fp", F.explode(F.array(*ball(low), *ball(high.bitwiseOR(tag)))).alias("p")).select(F.col("p.key").alias("key"), "fp", F.col("p.own").alias("own"))
    own = distinct.select(F.explode(F.array(low, high.bitwiseOR(tag))).alias("key")).groupBy("key").count().where(F.col("count") > hot)
    wide = stored(own.select(F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(m)) for m in around])).alias("key")).distinct(), "wide-keys")
    many = wide.count()
    if many:
        other = F.when(F.col("key").bitwiseAND(tag) == 0, high).otherwise(low)
        # four more keys, marked in bit 33, hold a byte's number and value
        bytes_ = F.array(*[F.col("key").bitwiseOR(F.lit(1 << 33 | i << 34)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)), 36)) for i in range(4)])
        keys = F.broadcast(wide) if many <= FEW else wide
        split = probes.join(keys, "key").select(F.explode(bytes_).alias("key"), "fp", "own")
        probes = probes.join(keys, "key", "left_anti").unionByName(split)
    return probes.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def group_names(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, rep, copies, component) of the distinct fingerprints of stored rows (id, fp); component is a fingerprint."""
    spark = rows.sparkSession
    reps = stored(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "distinct-fingerprints")
    groups = connected_components(near_links(reps.select("fp"), int(spark.conf.get("spark.sql.shuffle.partitions")), hot))
    return reps.join(groups, reps.fp == groups.node, "left").select("fp", "rep", "copies", F.coalesce("component", "fp").alias("component"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id that links reach."""
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    named = group_names(rows, hot)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    names = join_with_hot(named.select("fp", "copies", "component"), least, "component", "n", named.count()).select("fp", "copies", "component_id")
    return join_with_hot(rows, names, "fp", "copies", rows.count()).select("id", "fp", "component_id")


def record_sign(docs: DataFrame):
    """A hash of all columns by name, the same for wholly equal rows; maps count as their sorted entries."""
    return F.xxhash64(F.lit(SEED), *[F.array_sort(F.map_entries(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields])


def _identity(key: Column, sign: Column) -> list[Column]:
    return [F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("late"), sign.alias("sign")]


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, and of rows with one id that of the least
    record hash. Rows are told apart by id and record, so that different texts under one id are judged by themselves;
    of wholly equal rows one stays. A row without an id comes after all that have one."""
    columns = docs.columns
    signed = docs.select(F.col(key).cast("long").alias("id"), record_sign(docs).alias("sign"), F.col(text).cast("string").alias("text"))
    rows = stored(signed.mapInArrow(_signed_fingerprints, "id long, sign long, fp long"), "fingerprints")
    keys = rows.groupBy("id", "sign", "fp").agg(F.count("*").alias("copies"))
    named = group_names(rows, hot)
    least = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "sign", "copies")).alias("one")
    # the least of each fingerprint first, so that a large group brings a row per fingerprint to its component
    first = keys.groupBy("fp").agg(least)
    chosen = first.join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min("one").alias("one"))
    chosen = stored(chosen.select(F.struct(*_identity(F.col("one.id"), F.col("one.sign"))).alias("_row"), F.col("one.copies").alias("_copies"), F.col("one.copies").alias("_share")), "chosen-rows")
    marked = docs.select(F.struct(*_identity(F.col(key).cast("long"), record_sign(docs))).alias("_row"), F.struct("*").alias("record"))
    # a row in very many wholly equal copies meets its choice by broadcast; the copies of a row merge before they are shuffled
    kept = join_with_hot(marked, chosen, "_row", "_share", rows.count()).select("record", "_row", "_copies")
    single = kept.select("record")
    if chosen.where("_copies > 1").limit(1).count():
        again = kept.where("_copies > 1").groupBy("_row").agg(F.first("record").alias("record"))
        single = kept.where("_copies = 1").select("record").union(again.select("record"))
    return single.select(*[F.col(f"record.`{c}`").alias(c) for c in columns])


def simhash_groups(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
