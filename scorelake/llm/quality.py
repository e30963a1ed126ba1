"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are 0 (low quality), 1 (good but toxic) and 2 (good and clean), from the labels. One weight vector is shared by
all grades: a text's score is the mean weight of its words, of their shapes (case, digits and symbols, runs collapsed)
and of a mark for words that repeat the one before, each hashed into a fixed table, plus a weight for its length. The
ordered thresholds turn the score s into P(grade >= j) = sigmoid(s - threshold_j).

The scale so puts toxicity below the fully good, as selection wants it; P(grade >= 1) is quality by itself. The labels
have no finer ratings.

The model is fitted on at most SAMPLE labelled documents outside the held-out fold (crc32 of the id modulo FOLDS), the
first by a seeded hash of their id; the bound is the parameter `sample`. All documents are scored, whole.

Defined cases: null and wordless texts score by their length weight alone; labels with a null are not used; of labels
or documents with one id the least grade and the least text are learned from; repeated rows score alike; without labels every text is kept with probability 1 and grade 2; only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Pieces, chunks, id_remainder, text_bytes, word_ranges

FOLDS, HELD_OUT = 5, 0
SAMPLE = 6000
SEED = 7
BITS = 14
#: Table: word buckets, shape buckets, repeat mark, length buckets.
REPEAT, LENGTHS = 2 << BITS, (2 << BITS) + 1
SIZE = LENGTHS + 24
SCALE = 8.0
KEEP = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[48:58] = ord("0")


def tokens(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a chunk: its text, word bucket, shape bucket, and whether it repeats the word before."""
    start, stop = word_ranges(raw, cuts)
    owner = np.searchsorted(cuts, start, "right") - 1
    hashed = Pieces(_LOWER[raw]).hash(start, stop)
    kind = _CLASS[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[start] = True
    place = np.r_[0, np.cumsum(kept)]
    shape = Pieces(kind[kept]).hash(place[start], place[stop])
    again = np.zeros(len(start), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    low = np.uint64((1 << BITS) - 1)
    return owner, (hashed & low).astype(np.int64), (shape & low).astype(np.int64) + (1 << BITS), again


def length_bucket(words: np.ndarray) -> np.ndarray:
    return LENGTHS + np.minimum(23, np.log2(words + 1.0)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows of the sampled texts."""
    for batch in batches:
        raw, ends = text_bytes(batch["text"])
        rows = []
        for a, b in chunks(ends):
            owner, word, shape, again = tokens(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            count = np.bincount(owner, minlength=b - a)
            length = length_bucket(count)
            for d in range(b - a):
                lo, hi = np.searchsorted(owner, [d, d + 1])
                columns, times = np.unique(np.r_[word[lo:hi], shape[lo:hi], np.full(again[lo:hi].sum(), REPEAT)], return_counts=True)
                rows.append({"columns": [*columns.tolist(), int(length[d])], "vals": [*(times * (SCALE / max(1, count[d]))).tolist(), 1.0]})
        yield pa.RecordBatch.from_pylist([x | {"doc_id": k, "grade": g} for x, k, g in zip(rows, batch["doc_id"].to_pylist(), batch["grade"].to_pylist(), strict=True)], pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("columns", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(grade: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, size: int, grades: int, rounds: int = 250, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit model, by Adam on the whole sample."""
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    cut = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    weight = np.zeros(size)
    params = np.r_[weight, cut]
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        weight, cut = params[:size], params[size:]
        gaps = np.exp(np.clip(cut[1:], -20, 20))
        theta = cut[0] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(row, value * weight[column], n)
        edge = np.r_[-np.inf, theta, np.inf]
        up, low = sigmoid(edge[grade + 1] - score), sigmoid(edge[grade] - score)
        inside = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) / inside, low * (1 - low) / inside
        d_theta = np.zeros(grades + 1)
        np.add.at(d_theta, grade + 1, -du / n)
        np.add.at(d_theta, grade, dl / n)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.r_[np.bincount(column, value * ((du - dl) / n)[row], size) + decay * weight / 10, tail[0], tail[1:] * gaps]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return params[:size], params[size] + np.r_[0, np.cumsum(np.exp(np.clip(params[size + 1 :], -20, 20)))]


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels without nulls."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).cast("int").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray] | None:
    """The model of a bounded sample of labelled rows; None if there are no two grades among them."""
    one = graded(labels).where(id_remainder("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))
    got = rows.select("doc_id", "grade", "text").mapInArrow(_features, "doc_id long, grade int, columns array<int>, vals array<float>").toArrow().sort_by("doc_id")
    grade = got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return None
    columns = got["columns"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(columns.offsets.to_numpy()))
    return fit_ordinal(grade, row, columns.flatten().to_numpy().astype(np.int64), got["vals"].combine_chunks().flatten().to_numpy().astype(np.float64), SIZE, 3)


def _scoring(model: tuple[np.ndarray, np.ndarray] | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            good, clean = np.ones(len(ends) - 1), np.ones(len(ends) - 1)
            for a, b in chunks(ends) if model is not None else ():
                weight, theta = model
                owner, word, shape, again = tokens(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                count = np.bincount(owner, minlength=b - a)
                s = np.bincount(owner, weight[word] + weight[shape] + weight[REPEAT] * again, b - a) * SCALE / np.maximum(1, count) + weight[length_bucket(count)]
                good[a:b], clean[a:b] = sigmoid(s - theta[0]), sigmoid(s - theta[1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(good + clean), pa.array(good), pa.array(good >= KEEP)], ["doc_id", "held_out", "expected_grade", "p_good", "keep"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, expected_grade, p_good, keep) of every document; p_good is P(grade >= 1)."""
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scoring(model), "doc_id long, held_out boolean, expected_grade double, p_good double, keep boolean")


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model keeps, with their columns; rows without an id are judged by the same rule."""
    model = fit(docs, labels)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = next(_scoring(model)(iter([pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.bool_()), batch["text"]], ["doc_id", "held_out", "text"])])))
            yield batch.filter(judged["keep"]).select(names)

    return docs.mapInArrow(keep, docs.schema)
