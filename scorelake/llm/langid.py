"""Language identification by string kernels.

The kernel of two texts is the blended spectrum with presence: the number of distinct byte n-grams, n = 1 to 3, that
both hold, divided by the root of the product of their numbers, all n-grams of a text counted. Landmarks are LANDMARKS training texts; the Nystroem map of a text
is its kernel row times the inverse root of the landmarks' kernel matrix; one ridge regression per language, one versus
the rest, is fitted on that map. All kernel rows of a chunk of texts come from one matrix product.

Landmarks and at most `sample` training texts are taken from rows outside the held-out fold, evenly over the languages
and in the order of a seeded hash of their ids. Each language's number of rows gives the part of the hash's range in
which its training ids lie, so that no language's rows meet in a task. Bounds of the sample, all parameters: `sample`
texts, the `sample` commonest languages, `landmarks` landmarks of at most LANDMARK_BYTES bytes each and VOCABULARY
n-grams together. Whole texts are read everywhere.

Defined cases: a null text or one without letters is `und` with score 0; rows with a null lang are never learned from;
ties go to the first language by name; if there is nothing to learn, every row is `und`; repeated rows score alike; of
rows with one id one text is learned from, that of the least language and then the least hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, id_remainder, text_bytes

FOLDS, HELD_OUT = 5, 0
LANDMARKS = 128
SAMPLE = 2000
SEED = 11
RIDGE = 1e-3
LANDMARK_BYTES, VOCABULARY = 1 << 18, 200_000
#: Bytes of the presence matrix of a chunk, and its texts at most.
MATRIX_BYTES, ROWS = 64 << 20, 512
#: How many ids more than needed the hash ranges hold on average.
SPARE = 1.5
CODES = 256 + (1 << 16) + (1 << 24)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes at all places of a chunk and the text of each; n-grams do not cross texts."""
    low = _LOWER[raw].astype(np.int32)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    two = low[:-1] << 8 | low[1:]
    three = two[:-1] << 8 | low[2:]
    same2, same3 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    return np.concatenate([low, two[same2] + 256, three[same3] + 256 + (1 << 16)]), np.concatenate([owner, owner[1:][same2], owner[2:][same3]])


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, ends = text_bytes(batch["text"])
        sets = [np.unique(codes(raw[a:b], np.array([0, b - a]))[0]).tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["turn"], pa.array(sets, pa.list_(pa.int32()))], ["turn", "grams"])


class Kernel:
    """Kernel rows against the landmarks."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(sets))
        self.marks = np.zeros((len(self.vocabulary), len(sets)), np.float32)
        for k, grams in enumerate(sets):
            self.marks[np.searchsorted(self.vocabulary, grams), k] = 1 / np.sqrt(max(1, len(grams)))
        self._place: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_place": None}

    @property
    def chunk_rows(self) -> int:
        return max(1, min(ROWS, MATRIX_BYTES // (4 * (len(self.vocabulary) + 1))))

    def presence(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts by vocabulary, and how many distinct n-grams each text has, those included that no landmark has."""
        if self._place is None:
            self._place = np.zeros(CODES, np.int32)
            self._place[self.vocabulary] = np.arange(1, len(self.vocabulary) + 1)
        out = np.zeros((len(cuts) - 1, len(self.vocabulary) + 1), np.float32)
        code, owner = codes(raw, cuts)
        place = self._place[code]
        out.reshape(-1)[owner * out.shape[1] + place] = 1
        other = place == 0
        others = np.unique(owner[other].astype(np.int64) * CODES + code[other]) // CODES
        return out[:, 1:], out[:, 1:].sum(axis=1) + np.bincount(others, minlength=len(out))

    def rows(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        has, count = self.presence(raw, cuts)
        return (has @ self.marks) / np.sqrt(np.maximum(1, count))[:, None]


def _text_runs(ends: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    for a, b in chunks(ends):
        for c in range(a, b, rows):
            yield c, min(b, c + rows)


def _kernel_rows(kernel: Kernel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            got = [x for a, b in _text_runs(ends, kernel.chunk_rows) for x in kernel.rows(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]).tolist()]
            yield pa.RecordBatch.from_arrays([batch["turn"], batch["lang"], pa.array(got, pa.list_(pa.float32()))], ["turn", "lang", "row"])

    return rows


class Model:
    def __init__(self, kernel: Kernel, langs: list[str], weights: np.ndarray):
        self.kernel, self.langs, self.weights = kernel, langs, weights

    def scores(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """One regression value per text and language."""
        return self.kernel.rows(raw, cuts) @ self.weights[:-1] + self.weights[-1]


def training_ids(docs: DataFrame, sample: int, seed: int) -> list[tuple]:
    """(place, doc_id, lang, sign) of an equal number of ids of each language, in order of place within the language.

    The counts of at most `sample` languages come to the driver, and about SPARE x sample ids.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", FOLDS) != HELD_OUT))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return []
    per_lang = max(1, sample // len(counts))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)
    edges = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (SPARE * per_lang + 20) / r["count"]) * (1 << 53))) for r in counts], "lang string, edge long")
    near = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("sign"), order.alias("place")).join(F.broadcast(edges), "lang").where("place < edge")
    one = near.groupBy("place", "doc_id").agg(F.min(F.struct("lang", "sign")).alias("m")).select("place", "doc_id", "m.lang", "m.sign")
    out, taken = [], {}
    for r in sorted(map(tuple, one.collect())):
        if taken.setdefault(r[2], 0) < per_lang:
            taken[r[2]] += 1
            out.append((taken[r[2]], *r[1:]))
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))[:sample]


def training_texts(docs: DataFrame, chosen: list[tuple]) -> DataFrame:
    """(turn, lang, text) of chosen ids, one row each; chosen is bounded by the sample."""
    ids = docs.sparkSession.createDataFrame([(k, *r[1:]) for k, r in enumerate(chosen)], "turn int, doc_id long, lang string, sign long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("sign"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), ["doc_id", "lang", "sign"]).groupBy("turn").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, seed: int = SEED) -> Model | None:
    """The model of the rows outside the held-out fold; None if no row has a language."""
    chosen = training_ids(docs, sample, seed)
    if not chosen:
        return None
    texts = training_texts(docs, chosen)
    # two candidates for each landmark, in case that some are too long
    wide = texts.where((F.col("turn") < 2 * landmarks) & (F.octet_length("text") <= LANDMARK_BYTES))
    marks = wide.select("turn", "lang", "text").mapInArrow(_gram_sets, "turn int, grams array<int>").toArrow().sort_by("turn")
    sets, known = [], np.zeros(0, np.int64)
    for grams in marks["grams"]:
        grams = np.asarray(grams.values, np.int64)
        more = np.union1d(known, grams)
        if len(sets) < landmarks and len(more) <= VOCABULARY:
            sets.append(grams)
            known = more
    if not sets:
        return None
    kernel = Kernel(sets)
    got = texts.select("turn", "lang", "text").mapInArrow(_kernel_rows(kernel), "turn int, lang string, row array<float>").toArrow().sort_by("turn")
    rows = np.stack([np.asarray(x.values, np.float64) for x in got["row"]])
    named = got["lang"].to_pylist()
    names = sorted(set(named))
    # the landmarks' own kernel matrix comes from their n-gram columns
    gram = kernel.marks.T.astype(np.float64) @ kernel.marks
    value, vector = np.linalg.eigh(gram)
    root = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    mapped = np.c_[rows @ root, np.ones(len(rows))]
    aim = np.where(np.array(named)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    pull = RIDGE * len(rows) * np.eye(mapped.shape[1])
    pull[-1, -1] = 1e-9
    beta = np.linalg.solve(mapped.T @ mapped + pull, mapped.T @ aim)
    return Model(kernel, names, np.r_[root @ beta[:-1], beta[-1:]].astype(np.float32))


def _predicting(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.full(len(batch), "und", object)
            score = np.zeros(len(batch))
            raw, ends = text_bytes(batch["text"])
            worded = np.asarray(batch["worded"].to_numpy(zero_copy_only=False), bool)
            for a, b in _text_runs(ends, model.kernel.chunk_rows) if model is not None else ():
                values = model.scores(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                best = values.argmax(axis=1)
                sure = np.clip((values[np.arange(b - a), best] + 1) / 2, 0, 1)
                names[a:b] = np.where(worded[a:b], np.array(model.langs, object)[best], "und")
                score[a:b] = np.where(worded[a:b], sure, 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = fit(docs, sample, landmarks)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("worded"))
    return rows.mapInArrow(_predicting(model), "doc_id long, held_out boolean, lang_pred string, score double")
