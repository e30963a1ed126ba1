"""What two experiments of a cohort did on the rows they share, for all pairs at once, without a join of rows.

Rows lie in blocks of 32,768. For every experiment, level (a score, or whether a row passed) and block there is one short
record of its rows: their places, or a bitmap where those are many, so that it takes 4 KB at most and little where runs
share few rows. The experiments of a cohort that have rows in a block are dealt into tiles, as few as hold TILE experiments
or ROWS rows each: so a block of many runs with few rows each is one tile, and its records are sent once. A task takes the
records of a block for two tiles. Rows that many of its experiments have go into a small matrix of level codes, experiments
by rows, over which each experiment counts what the others have on its own rows; for the other rows the pairs that share
them are written out, as few as they are, and counted. So the work grows with the rows that pairs share, and for rows that
most runs have with a byte of the matrix each; a row that every run has is no hot key, a task holds 2 x TILE experiments of
a block or 2 x ROWS rows, and runs that have no block in common never meet. The counts of all blocks are then summed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.analytics import COHORT, cohort_joined
from scorelake.sources.storage import stored

#: Rows of a block, as a power of two; a place in it is a short integer.
BITS = 15

#: Experiments or rows up to which runs of a block lie in one tile.
TILE, ROWS = 256, 1 << 19
#: A row goes into the matrix if more than one in HOT experiments of a tile have it.
HOT = 16
#: Cells of a matrix, pairs of levels, and shared rows that are counted at a time.
CELLS, COUNTERS, SHARED = 1 << 18, 1 << 16, 1 << 21
#: Levels up to which blocks are counted; with more, as with continuous scores, rows are joined.
LEVELS = 64


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of each record as bytes: two for each, or a bitmap where that is shorter."""
    for batch in batches:
        out = []
        for places in batch["places"]:
            at = np.asarray(places, np.int16)
            if 2 * len(at) >= 1 << BITS - 3:
                bits = np.zeros(1 << BITS, bool)
                bits[at] = True
                out.append(np.packbits(bits).tobytes())
            else:
                out.append(at.tobytes())
        yield batch.assign(places=pd.Series(out, index=batch.index, dtype=object))


def _places(packed: bytes) -> np.ndarray:
    if len(packed) == 1 << BITS - 3:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))
    return np.frombuffer(packed, np.int16)


def _entries(records: pd.DataFrame, place: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Experiment, row and level code of each row of the records."""
    rows = [_places(packed) for packed in records["places"]]
    sizes = [len(x) for x in rows]
    return np.repeat(place, sizes), np.concatenate(rows).astype(np.int64), np.repeat(level, sizes)


def _by_matrix(codes: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> Iterator[tuple]:
    """(experiments, experiments, level codes, level codes, counts) from a matrix of level codes plus 1, experiments by rows.
    left and right: the experiments of two tiles, which may be the same one."""
    same = left is right
    for at, i in enumerate(left):
        own = np.flatnonzero(codes[i])
        if not len(own):
            continue
        mine = codes[i, own].astype(np.int32)
        others = right[at + 1 :] if same else right
        strip = max(1, min(CELLS // len(own), COUNTERS // (k * k)))
        for start in range(0, len(others), strip):
            js = others[start : start + strip]
            theirs = codes[np.ix_(js, own)]
            cells = (np.arange(len(js), dtype=np.int32)[:, None] * k + theirs) * k + mine
            n = np.bincount(cells[theirs > 0])
            found = np.flatnonzero(n)
            yield np.full(len(found), i), js[found // (k * k)], found % k - 1, found // k % k - 1, n[found]


def _by_rows(entries: tuple, in_left: np.ndarray, in_right: np.ndarray, same: bool, k: int) -> Iterator[tuple]:
    """The same from entries (experiment, row, level code): the pairs of each row are written out, SHARED at a time."""
    e, row, code = entries
    order = np.lexsort((e, row))
    e, row, code = (x[order] for x in (e, row, code))
    theirs = np.flatnonzero(in_right[e])
    ends = np.searchsorted(row[theirs], np.arange((1 << BITS) + 1))  # where each row begins among theirs
    mine = theirs if same else np.flatnonzero(in_left[e])
    begin = np.arange(1, len(theirs) + 1) if same else ends[row[mine]]
    many = ends[row[mine] + 1] - begin
    # by experiment, so that the rows that a pair shares are counted together
    by = np.argsort(e[mine], kind="stable")
    mine, begin, many = (x[by] for x in (mine, begin, many))
    so_far = np.cumsum(many)
    start, experiments = 0, len(in_left)
    while start < len(mine):
        stop = max(start + 1, int(np.searchsorted(so_far, so_far[start] - many[start] + SHARED, "right")))
        each = many[start:stop]
        i = np.repeat(mine[start:stop], each)
        j = theirs[np.arange(len(i)) + np.repeat(begin[start:stop] - (np.cumsum(each) - each), each)]
        cell, n = np.unique(((e[i] * experiments + e[j]) * k + code[i]) * k + code[j], return_counts=True)
        yield cell // (k * k * experiments), cell // (k * k) % experiments, cell // k % k, cell % k, n
        start = stop


def _joint(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one block for the experiments of two tiles."""
    frame = pd.concat(list(frames))
    who, place = np.unique(frame["experiment_id"].to_numpy(), return_inverse=True)
    levels, level = np.unique(frame["level"].to_numpy(), return_inverse=True)
    k = len(levels) + 1
    tile = np.zeros(len(who), np.int64)
    tile[place] = frame["tile"]
    left = np.flatnonzero(tile == key[-2])
    same = key[-2] == key[-1]
    right = left if same else np.flatnonzero(tile == key[-1])
    if frame["n"].sum() > 2 * ROWS:  # tiles of TILE experiments with many rows
        codes = np.zeros((len(who), 1 << BITS), np.uint8)
        for e, code, packed in zip(place, level, frame["places"], strict=True):
            codes[e, _places(packed)] = code + 1
        parts = _by_matrix(codes, left, right, k)
    else:
        e, row, code = _entries(frame, place, level)
        in_left, in_right = tile == key[-2], tile == key[-1]
        hot = HOT * np.bincount(row[in_right[e]], minlength=1 << BITS) > len(right)
        dense = hot[row]
        codes = np.zeros((len(who), np.count_nonzero(hot)), np.uint8)
        codes[e[dense], np.cumsum(hot)[row[dense]] - 1] = code[dense] + 1
        rest = tuple(x[~dense] for x in (e, row, code))
        parts = itertools.chain(_by_matrix(codes, left, right, k), _by_rows(rest, in_left, in_right, same, k))
    yield from _told(parts, who, levels)


def _told(parts: Iterator[tuple], who: np.ndarray, levels: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counts with the names of experiments and levels, the smaller experiment first, in frames of about SHARED rows."""
    held, n_held = [], 0
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held.append(part)
            n_held += len(part[0])
        if held and (part is None or n_held >= SHARED):
            i, j, a, b, n = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
            turned = i > j
            yield pd.DataFrame({"a": who[np.where(turned, j, i)], "b": who[np.where(turned, i, j)], "level_a": levels[np.where(turned, b, a)], "level_b": levels[np.where(turned, a, b)], "n": n})
            held, n_held = [], 0


def joint_counts(results: DataFrame, experiments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(a, b, level_a, level_b, n): on how many shared rows experiments a < b of one cohort stand at two levels.

    results: experiment_id, row_idx (not negative, once per experiment) and level, of the rows that count. wanted: pairs
    (a, b) to tell of; other experiments are then not read.
    """
    cohorts = experiments.select("experiment_id", *COHORT)
    if wanted is not None:
        cohorts = cohorts.join(_named(wanted), "experiment_id", "left_semi")
    rows = results.select("experiment_id", F.shiftright("row_idx", BITS).alias("block"), F.col("row_idx").bitwiseAND((1 << BITS) - 1).cast("short").alias("place"), F.col("level").cast("double").alias("level")).join(cohorts, "experiment_id")
    # rows of a run and block are brought together once; the aggregate then needs no exchange of its own
    lists = rows.repartition("experiment_id", "block").groupBy(*COHORT, "experiment_id", "block", "level").agg(F.collect_list("place").alias("places"), F.count("*").alias("n"))
    kinds = [f"`{f.name}` {'binary' if f.name == 'places' else f.dataType.simpleString()}" for f in lists.schema.fields]
    records = stored(lists.mapInPandas(_packed, ", ".join(kinds)))
    counted = _sides(records).groupBy(*COHORT, "block", "low", "high").applyInPandas(_joint, "a long, b long, level_a double, level_b double, n long")
    # a pair lies in one partition, so that what is then summed or drawn by pair needs no exchange of its own
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = counted.repartition(parts, "a", "b").groupBy("a", "b", "level_a", "level_b").agg(F.sum("n").alias("n"))
    return out if wanted is None else out.join(wanted.select("a", "b").distinct(), ["a", "b"])


def _sides(records: DataFrame) -> DataFrame:
    """The records with the pairs of tiles of their block that they take part in: one where a block has few runs or rows."""
    where = [*COHORT, "block"]
    tiles = F.ceil(F.count_distinct("experiment_id") / TILE)
    if "n" in records.columns:
        tiles = F.least(tiles, F.ceil(F.sum("n") / ROWS))
    sizes = records.groupBy(*where).agg(tiles.cast("int").alias("tiles"))
    placed = records.join(sizes, where).withColumn("tile", F.pmod(F.xxhash64("experiment_id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return placed.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})


def _named(wanted: DataFrame) -> DataFrame:
    """The experiments of pairs."""
    return wanted.select(F.col("a").alias("experiment_id")).union(wanted.select(F.col("b").alias("experiment_id"))).distinct()


def score_pairs(results: DataFrame, experiments: DataFrame, wanted: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """(a, b, score_a, score_b, n): how often two scores meet on shared rows. With few scores in all by blocks, else by a join
    of rows; both count the same. The results are read once, those of the wanted pairs' experiments only."""
    return bounded_score_pairs(results, experiments, wanted, levels)[0]


def bounded_score_pairs(results: DataFrame, experiments: DataFrame, wanted: DataFrame | None = None, levels: int = LEVELS) -> tuple[DataFrame, int | None]:
    """`score_pairs`, and how many pairs of scores there can be, where scores are few."""
    if wanted is not None:
        wanted = stored(wanted)
        results = results.join(_named(wanted), "experiment_id", "left_semi")
    results = stored(results.select("experiment_id", "row_idx", "score"))
    n_scores = results.select("score").distinct().limit(levels + 1).count()
    if n_scores <= levels:
        return joint_counts(results.withColumn("level", F.col("score")), experiments, wanted).withColumnsRenamed({"level_a": "score_a", "level_b": "score_b"}), n_scores**2
    joined = cohort_joined(results, experiments, "score")
    if wanted is not None:
        joined = joined.join(wanted.select("a", "b").distinct(), ["a", "b"])
    return joined.groupBy("a", "b", "score_a", "score_b").agg(F.count("*").alias("n")), None


def discordants(results: DataFrame, experiments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(a, b, only_a, only_b): how often only one of two experiments passes a shared row. results: with score."""
    counts = joint_counts(results.withColumn("level", (F.col("score") >= 1).cast("int")), experiments, wanted)
    a, b, n = F.col("level_a") == 1, F.col("level_b") == 1, F.col("n")
    tell = lambda flag: F.sum(F.when(flag, n).otherwise(0))
    return counts.groupBy("a", "b").agg(tell(a & ~b).alias("only_a"), tell(b & ~a).alias("only_b"))


def failure_diff(marked: DataFrame, experiments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """How many shared rows only a, only b, or both get wrong. marked: experiment_id, row_idx, wrong."""
    counts = joint_counts(marked.withColumn("level", F.col("wrong").cast("int")), experiments, wanted)
    a, b, n = F.col("level_a") == 1, F.col("level_b") == 1, F.col("n")
    tell = lambda flag: F.sum(F.when(flag, n).otherwise(0))
    return counts.groupBy("a", "b").agg(F.sum("n").alias("shared_rows"), tell(a & ~b).alias("a_only_wrong"), tell(b & ~a).alias("b_only_wrong"), tell(a & b).alias("both_wrong"))
