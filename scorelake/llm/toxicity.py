"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Words are folded (lower case, look-alike digits and signs to letters, other signs dropped; runs of single letters are
read as one more word). The kernel of two words is the gap-weighted subsequence kernel of order three: each common
subsequence of three letters counts DECAY to the power of both its spans, up to SPAN letters, and the value is divided
by the root of the words' own. Gaps and inserted characters so lower a match without losing it. Landmarks are the words
whose document frequency is most raised in toxic training texts, and the commonest words of clean ones.

A second kernel of words does not mind gaps at all: it counts common subsequences of ORDER letters whatever lies between them,
divided by the root of the words' own counts. A letter put into every gap of an insult leaves it near a fifth, while
other words with the same letters hardly have them in that order. It is computed for the landmarks all of whose letters a word
of at most LONG letters has, and is zero for the others.

A sentence is told by one word, its witness; its kernel row is that word's, so that rows are exact and the Nystroem map
is, too. A linear SVM on the map comes down to one number per distinct word: a sentence scores as its best word, a text
as its best sentence, through a logistic curve fitted on the training texts. Nothing is cut off: a word far from all
landmarks just scores low. The SVM is trained on labelled sentences, each with the word nearest to a toxic landmark as
its witness: those of clean texts are negative; of a toxic text those are positive that the current machine accepts, and
its best one in any case (multiple-instance rounds). The machine's kernel is the sum of the first kernel, a power of it and
the second one, each mapped by its own Nystroem root: the power tells rare stems from common words with most of their letters.
So that spoilt forms stay on the toxic side, toxic landmarks with one to three inserted letters, with a letter in every gap and
with a letter less are trained on as further positives (virtual examples), each by the square of how often its landmark is
met, where no clean sentence lies nearly as close to the landmark in one of the two kernels.

The sample is at most `sample` toxic and 2 x `sample` clean labelled texts outside the held-out fold, by a seeded hash
of the id, and all their sentences: equal witnesses are merged and counted, those of clean texts together and those of toxic
ones text by text. Settings were chosen by cross-validation within the training folds. All texts are scored, whole.

Defined cases: null and empty texts score as a sentence without any match; words under three letters match nothing;
labels with nulls are ignored, and an id labelled both ways counts as toxic; of texts with one id the least is learned
from; without both classes all scores are 0; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Pieces, chunks, id_remainder, stored, text_bytes, word_ranges

FOLDS, HELD_OUT = 4, 2
SAMPLE = 2000
SEED = 13
CANDIDATES, TOXIC_MARKS, CLEAN_MARKS = 400, 80, 8
#: A landmark is not taken if its kernel value with one taken before is above this.
APART = 0.9
DECAY, SPAN, COST = 0.95, 8, 0.5
THRESHOLD = 0.3
#: The kernel is summed with SHARE times its POWER, which tells stems that share most of their letters.
POWER, SHARE = 6, 1.0
#: Letters of the subsequences that may have any gaps, and of the words in which they are looked for.
ORDER, LONG = 4, 24
#: Forms of a toxic landmark with one, two and three inserted letters, a letter in every gap and a letter less, the weight of all
#: forms against that of the positives, and by how much they must lie nearer to it than any clean sentence does in the
#: first or the second kernel to be trained on.
FORMS, FORM_SHARE, CLEAR, GAP_CLEAR = (4, 4, 4, 8, 6), 2.0, 0.1, 0.03
#: Eigenvalues of the landmarks' kernel matrices above which their directions are used.
RANK = 0.05
#: Training sentences taken at a time.
BLOCK = 1 << 14
#: Pairs of words whose common subsequences are counted at a time.
PAIRS = 1 << 15
TEXT_BYTES = 1 << 20
#: Bytes of words whose subsequences are listed at a time, and words whose numbers a worker remembers.
WORD_BYTES, KNOWN_WORDS = 1 << 16, 1 << 20
#: Letters a to z, then ten classes of all other letters.
LETTERS = 36
GAPS = [(i, j) for i in range(1, SPAN) for j in range(1, SPAN) if i + j <= SPAN]
#: Fixed look-alikes.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _fold_table() -> np.ndarray:
    out = np.full(0x110000, -1, np.int8)
    for c in range(0x250):
        for low in (chr(c).lower(),):
            if len(low) == 1 and low.isalpha():
                out[c] = ord(low) - 97 if "a" <= low <= "z" else 26 + ord(low) % 10
    out[0x250:] = 26 + np.arange(0x250, 0x110000) % 10
    for sign, letter in ALIKE.items():
        out[ord(sign)] = ord(letter) - 97
    return out


_fold: list[np.ndarray] = []


def folded(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of the byte ranges, concatenated, and the range of each letter."""
    if not _fold:
        _fold.append(_fold_table())
    size = stop - start
    ends = np.r_[0, np.cumsum(size)]
    taken = raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    chars = np.frombuffer(taken.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(start)), size)[(taken & 0xC0) != 0x80]
    letter = _fold[0][chars]
    # a $ or digit counts as a letter only inside a word with true letters; a mere sign at the edge does not matter
    kept = letter >= 0
    return letter[kept].astype(np.int64), owner[kept]


def triples(letter: np.ndarray, owner: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pair of gaps: the weight, and codes and owners of the subsequences with them."""
    for i, j in GAPS:
        d = i + j
        same = np.flatnonzero(owner[d:] == owner[:-d]) if len(owner) > d else np.zeros(0, np.int64)
        yield DECAY ** (d + 1), (letter[same] * LETTERS + letter[same + i]) * LETTERS + letter[same + d], owner[same]


def places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words one after the other, and their starts and stops."""
    stop = np.cumsum([len(w.encode()) for w in words]) if words else np.zeros(0, np.int64)
    return np.frombuffer("".join(words).encode(), np.uint8), np.r_[0, stop[:-1]][: len(words)], stop


def spelled(letter: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters by word and place (-1 beyond its end), sizes, and sets of letters as bits; words over LONG letters are empty."""
    size = np.bincount(owner, minlength=count)
    out = np.full((count, LONG), -1, np.int8)
    inside = size[owner] <= LONG
    place = np.arange(len(owner)) - np.r_[0, np.cumsum(size)][owner]
    out[owner[inside], place[inside]] = letter[inside]
    bits = np.zeros(count, np.uint64)
    np.bitwise_or.at(bits, owner[inside], np.uint64(1) << letter[inside].astype(np.uint64))
    return out, np.where(size <= LONG, size, 0), bits


def common_subsequences(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For each pair of words, in how many ways subsequences of ORDER letters of one are those of the other, with any gaps."""
    n, high, wide = len(a), int(a_size.max(initial=0)), int(b_size.max(initial=0))
    above = np.zeros((ORDER + 1, wide + 1, n))
    above[0] = 1
    for i in range(high):
        row = np.zeros_like(above)
        row[0] = 1
        for j in range(wide):
            same = (a[:, i] == b[:, j]) & (a[:, i] >= 0)
            row[1:, j + 1] = above[1:, j + 1] + row[1:, j] - above[1:, j] + same * above[:-1, j]
        above = row
    return above[ORDER, wide]


class Landmarks:
    def __init__(self, words: list[str], toxic: int):
        self.words, self.toxic = words, toxic
        letter, owner = folded(*places(words))
        self.spelled = spelled(letter, owner, len(words))
        self.own = common_subsequences(*self.spelled[:2], *self.spelled[:2])
        self.table = np.zeros((LETTERS**3, len(words)), np.float32)
        for w, code, o in triples(letter, owner):
            np.add.at(self.table, (code, o), w)
        self.table /= np.sqrt(np.maximum((self.table**2).sum(axis=0), 1e-12))
        self.used = self.table.any(axis=1)

    def gram(self) -> np.ndarray:
        return self.table.T.astype(np.float64) @ self.table

    def gap_gram(self) -> np.ndarray:
        n = len(self.words)
        i, j = np.divmod(np.arange(n * n), n)
        letters, size, _ = self.spelled
        counts = common_subsequences(letters[i], size[i], letters[j], size[j]).reshape(n, n)
        return counts / np.sqrt(np.maximum(self.own[:, None] * self.own[None, :], 1e-12))

    def gap_rows(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rows of the second kernel of the words at byte ranges."""
        out = np.zeros((len(start), len(self.words)), np.float32)
        marks, mark_size, mark_bits = self.spelled
        for a, b in chunks(np.r_[0, np.cumsum(stop - start)], WORD_BYTES):
            letters, size, bits = spelled(*folded(raw, start[a:b], stop[a:b]), b - a)
            fits = (mark_bits[None, :] & ~bits[:, None] == 0) & (mark_size[None, :] >= ORDER) & (size[:, None] >= mark_size[None, :])
            w, m = np.nonzero(fits)
            used, at = np.unique(w, return_inverse=True)
            own = np.concatenate([np.zeros(0), *(common_subsequences(letters[u], size[u], letters[u], size[u]) for u in np.array_split(used, len(used) // PAIRS + 1))])
            for k in range(0, len(w), PAIRS):
                x, y = w[k : k + PAIRS], m[k : k + PAIRS]
                counts = common_subsequences(letters[x], size[x], marks[y], mark_size[y])
                out[a + x, y] = counts / np.sqrt(np.maximum(own[at[k : k + PAIRS]] * self.own[y], 1e-12))
        return out

    def both(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rows of the first kernel, then of the second."""
        return np.concatenate([self.rows(raw, start, stop), self.gap_rows(raw, start, stop)], axis=1)

    def rows(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The kernel rows of the words at byte ranges."""
        out = np.zeros((len(start), len(self.words)), np.float32)
        for a, b in chunks(np.r_[0, np.cumsum(stop - start)], WORD_BYTES):
            letter, owner = folded(raw, start[a:b], stop[a:b])
            if b - a == 1:  # one word, however long, is counted by subsequence
                counts = sum((w * np.bincount(code, minlength=LETTERS**3) for w, code, _ in triples(letter, owner)), np.zeros(LETTERS**3))
                out[a] = counts @ self.table / np.sqrt(max(float(counts @ counts), 1e-12))
                continue
            parts = [(o * LETTERS**3 + code, np.full(len(code), w)) for w, code, o in triples(letter, owner)]
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            if not len(key):
                continue
            sums = np.bincount(at, np.concatenate([w for _, w in parts]), len(key))
            owner, code = np.divmod(key, LETTERS**3)
            own = np.sqrt(np.maximum(np.bincount(owner, sums**2, b - a), 1e-12))
            hit = np.flatnonzero(self.used[code])
            if len(hit):
                owner = owner[hit]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[a + owner[first]] = np.add.reduceat(self.table[code[hit]] * sums[hit, None].astype(np.float32), first, axis=0)
            out[a:b] /= own[:, None].astype(np.float32)
        return out


def apart(words: list[str], limit: int) -> list[str]:
    """The first words of the list no two of which are within APART of each other."""
    near = Landmarks(words, 0).gram() > APART
    taken: list[int] = []
    for k in range(len(words)):
        if len(taken) < limit and not near[k, taken].any():
            taken.append(k)
    return [words[k] for k in taken]


def words_of(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops, text and sentence of the words of a chunk; a run of three or more single letters is a word too."""
    start, stop = word_ranges(raw, cuts)
    owner = np.searchsorted(cuts, start, "right") - 1
    lines = np.cumsum(raw == 10)
    ended = np.isin(raw[stop - 1], [33, 46, 63]) if len(stop) else np.zeros(0, bool)
    new = np.ones(len(start), bool)
    new[1:] = ended[:-1] | (owner[1:] != owner[:-1]) | (lines[start[1:]] != lines[start[:-1]])
    sentence = np.cumsum(new) - 1
    single = (stop - start) <= 2
    linked = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    edge = np.flatnonzero(np.diff(np.r_[False, linked, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= 2
    a, b = a[long], b[long]
    return np.r_[start, start[a]], np.r_[stop, stop[b]], np.r_[owner, owner[a]], np.r_[sentence, sentence[a]]


def distinct_words(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the first place of each, and which one each word is."""
    return np.unique(Pieces(raw).hash(start, stop), return_index=True, return_inverse=True)


def witnesses(marks: Landmarks, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and place in the chunk's words of the witness of each sentence."""
    start, stop, owner, sentence = words_of(raw, cuts)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    hashes, first, which = distinct_words(raw, start, stop)
    near = marks.rows(raw, start[first], stop[first])[:, : marks.toxic].max(axis=1, initial=0)
    order = np.lexsort((which, -near[which], sentence))
    witness = order[np.r_[True, np.diff(sentence[order]) != 0]]
    return owner[witness], hashes[which[witness]].astype(np.int64), first[which[witness]]


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each training text."""
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = {w for x in (text or "").lower().split() if len(w := "".join(c for c in x if c.isalpha())) >= 3}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string()), pa.array([toxic] * len(words), pa.int32())], ["word", "toxic"])


def _rows(marks: Landmarks):
    """(doc_id, toxic, word, times, row) of the witnesses of training texts: of toxic texts each one's, of clean ones those of a
    chunk together, without id. row: both kernels' rows as half floats. A text without words has one zero row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            ids, toxic = batch["doc_id"].to_numpy(), batch["toxic"].to_numpy()
            for a, b in chunks(ends, TEXT_BYTES):
                part, cuts = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                owner, word, place = witnesses(marks, part, cuts)
                bare = np.setdiff1d(np.arange(b - a), owner)
                of = np.where(toxic[a:b] == 1, np.arange(b - a), -1)
                keys, first, times = np.unique(np.c_[np.r_[of[owner], of[bare]], np.r_[word, np.zeros(len(bare), np.int64)]], axis=0, return_index=True, return_counts=True)
                start, stop, *_ = words_of(part, cuts) if len(owner) else (place, place)
                rows = np.zeros((len(keys), 2 * len(marks.words)), np.float16)
                worded = first < len(owner)
                at = place[first[worded]]
                rows[worded] = marks.both(part, start[at], stop[at])
                doc = keys[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][doc], mask=doc < 0), pa.array((doc >= 0).astype(np.int32)), pa.array(keys[:, 1]), pa.array(times), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "toxic", "word", "times", "row"])

    return run


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A linear SVM with squared hinge loss and a weight of each row, by Newton steps in the primal over blocks of rows;
    the last column of x is the bias."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    inside = weight > 0
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(len(w))
        at = np.flatnonzero(inside)
        for a in range(0, len(at), BLOCK):
            rows = at[a : a + BLOCK]
            block = x[rows].astype(np.float64)
            part = block * (2 * weight[rows])[:, None]
            left += part.T @ block
            right += part.T @ y[rows]
        w = np.linalg.solve(left, right)
        new = (weight > 0) & (y * (x @ w.astype(np.float32)) < 1)
        if (new == inside).all():
            break
        inside = new
    return w


def logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | s), with Platt's smoothed targets, by Newton steps."""
    ones, zeros = weight @ y, weight @ (1 - y)
    aim = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.c_[s, np.ones(len(s))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (weight * (p - aim)) + 1e-3 * w)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def spoilt(word: str, forms: tuple[int, ...] = FORMS, seed: int = SEED) -> list[str]:
    """Forms of a word as FORMS tells, at seeded inner places."""
    rng = np.random.default_rng([seed, *word.encode()])
    letter = lambda: chr(97 + int(rng.integers(26)))
    out = []
    for more, count in enumerate(forms[:3], 1):
        for _ in range(count):
            at = set(rng.choice(np.arange(1, max(2, len(word))), min(more, max(1, len(word) - 1)), replace=False).tolist())
            out.append("".join((letter() if i in at else "") + c for i, c in enumerate(word)))
    out += ["".join((letter() if i else "") + c for i, c in enumerate(word)) for _ in range(forms[3])]
    for _ in range(forms[4]):
        at = int(rng.integers(1, max(2, len(word) - 1)))
        out.append(word[:at] + word[at + 1 :])
    return out


def parts(rows: np.ndarray) -> np.ndarray:
    """Both kernels' rows to the three parts of the summed kernel: the first, its power, and the second."""
    first, second = np.split(rows, 2, axis=1)
    return np.concatenate([first, first**POWER, second], axis=1)


def nystroem(gram: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The map from the parts of a kernel row to the features of the summed kernel."""
    roots = []
    for part, share in ((gram, 1.0), (gram**POWER, SHARE), (gaps, 1.0)):
        value, vector = np.linalg.eigh(part)
        roots.append(np.sqrt(share) * vector[:, value > RANK] / np.sqrt(value[value > RANK]))
    n = len(gram)
    out = np.zeros((3 * n, sum(r.shape[1] for r in roots)))
    column = 0
    for k, root in enumerate(roots):
        out[k * n : (k + 1) * n, column : column + root.shape[1]] = root
        column += root.shape[1]
    return out


def virtual_rows(marks: Landmarks, clean: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both kernels of spoilt toxic landmarks where no clean sentence comes nearly as near (`clean`: the largest values of
    clean sentences), and the share of each form by the toxic sentences (`near`: their values) that hold its landmark."""
    forms = [spoilt(w) for w in marks.words[: marks.toxic]]
    own = np.repeat(np.arange(marks.toxic), [len(f) for f in forms])
    rows = marks.both(*places([w for f in forms for w in f])).astype(np.float64)
    each, n = np.arange(len(own)), len(marks.words)
    used = (rows[each, own] > clean[own] + CLEAR) | (rows[each, n + own] > clean[n + own] + GAP_CLEAR)
    support = np.bincount(near.argmax(axis=1)[near.max(axis=1, initial=0) > APART], minlength=marks.toxic)[own[used]].astype(float) ** 2
    return rows[used], support / max(1.0, support.sum())


class Model:
    """word_weight: of each landmark and part, by which a word's kernel row becomes its number."""

    def __init__(self, marks: Landmarks, word_weight: np.ndarray, bias: float, slope: float, offset: float):
        self.marks, self.word_weight, self.bias, self.slope, self.offset = marks, word_weight.astype(np.float32), bias, slope, offset
        self._known: dict[int, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def word_numbers(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of distinct words; those of the words met last are remembered."""
        keys = hashes.tolist()
        out = np.array([self._known.get(k, np.nan) for k in keys])
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            out[new] = parts(self.marks.both(raw, start[new], stop[new])) @ self.word_weight
            if len(self._known) + len(new) > KNOWN_WORDS:
                self._known.clear()
            self._known.update(zip([keys[i] for i in new.tolist()], out[new].tolist(), strict=True))
        return out

    def numbers(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each text's best word, 0 without words, and the bias."""
        best = np.full(len(cuts) - 1, -np.inf)
        start, stop, owner, _ = words_of(raw, cuts)
        if len(start):
            hashes, first, which = distinct_words(raw, start, stop)
            np.maximum.at(best, owner, self.word_numbers(raw, start[first], stop[first], hashes)[which])
        best[np.isinf(best)] = 0
        return best + self.bias

    def scores(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.numbers(raw, cuts) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """The model of a bounded sample outside the held-out fold; None if a class is missing."""
    rated = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(id_remainder("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    chosen = rated.where("toxic = 1").orderBy(*order).limit(sample).union(rated.where("toxic = 0").orderBy(*order).limit(2 * sample))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(texts.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    counts = rows.select("text", "toxic").mapInArrow(_vocabularies, "word string, toxic int").groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    share = (F.col("t") + F.col("c") + 1) / (size[1] + size[0] + 2)
    raised = (F.col("t") / size[1] - F.col("c") / size[0]) / F.sqrt(share * (1 - share) * (1 / size[1] + 1 / size[0]))
    top = counts.where("t >= 2").withColumn("z", raised).where("z > 3").orderBy(F.desc("z"), "word").limit(CANDIDATES).collect()
    common = counts.orderBy(F.desc("c"), "word").limit(CLEAN_MARKS).collect()
    if not top:
        return None
    words = apart([r["word"] for r in top], TOXIC_MARKS)
    toxic_marks = len(words)
    marks = Landmarks(words + [r["word"] for r in common if r["word"] not in words], toxic_marks)
    found = rows.mapInArrow(_rows(marks), "doc_id long, toxic int, word long, times long, row binary")
    got = found.groupBy("doc_id", "toxic", "word").agg(F.sum("times").alias("times"), F.first("row").alias("row")).toArrow()
    # rows of one length lie one after the other in the column's own memory
    column = pa.concat_arrays(got["row"].chunks)
    kernel = np.frombuffer(column.buffers()[2], np.float16).reshape(-1, 2 * len(marks.words))[column.offset :][: len(column)]
    toxic, times, ids, word = (got[c].fill_null(0).to_numpy() for c in ("toxic", "times", "doc_id", "word"))
    order = np.lexsort((word, ids, toxic))
    kernel, toxic, times, ids = kernel[order], toxic[order], times[order], ids[order]
    del got, column
    model, forms = learned(marks, kernel, ids, toxic, times)
    # the curve is fitted on the numbers of whole texts
    best = rows.mapInArrow(_numbering(model), "toxic int, number double").toArrow()
    number, label = best["number"].to_numpy(), best["toxic"].to_numpy().astype(float)
    form_number, share = forms
    model.slope, model.offset = logistic(np.r_[number, form_number], np.r_[label, np.ones(len(form_number))], np.r_[np.ones(len(label)), FORM_SHARE * label.sum() * share])
    return model


def learned(marks: Landmarks, kernel: np.ndarray, ids: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[Model, tuple[np.ndarray, np.ndarray]]:
    """The machine of witnesses with these kernel rows, labels and counts, those of toxic texts with their ids; and the numbers
    and shares of the virtual examples."""
    n, m = len(kernel), len(marks.words)
    root = nystroem(marks.gram(), marks.gap_gram())
    first = kernel[:, :m]
    _, doc = np.unique(np.where(toxic == 1, ids, ids.max(initial=0) + 1), return_inverse=True)
    # a toxic text of which nothing comes near a landmark teaches nothing
    touched = (toxic == 1) & first.any(axis=1)
    positive = touched & (first[:, : marks.toxic].max(axis=1, initial=0) > 0.9)
    forms, share = virtual_rows(marks, kernel[toxic == 0].max(axis=0, initial=0).astype(np.float64), first[toxic == 1, : marks.toxic])
    # features of the witnesses, then of the forms, and a column for the bias
    x = np.ones((n + len(forms), root.shape[1] + 1), np.float32)
    x[n:, :-1] = parts(forms) @ root
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        x[a:b, :-1] = parts(kernel[a:b].astype(np.float64)) @ root
    w = np.zeros(x.shape[1])
    for _ in range(4):
        if not positive.any():
            positive = toxic == 1
        side = np.r_[np.where(positive, 1.0, -1.0), np.ones(len(forms))]
        weight = COST * np.r_[times * (positive | (toxic == 0)), FORM_SHARE * (times * positive).sum() * share]
        w = svm(x, side, weight)
        f = x @ w.astype(np.float32)
        best = np.full(doc.max(initial=0) + 1, -np.inf)
        np.maximum.at(best, doc, f[:n])
        positive = touched & ((f[:n] > 0) | (f[:n] == best[doc]))
    return Model(marks, root @ w[:-1], float(w[-1]), 1.0, 0.0), (f[n:], share)


def _numbering(model: Model):
    """(toxic, number) of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            number = np.concatenate([np.zeros(0), *(model.numbers(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in chunks(ends, TEXT_BYTES))])
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(number)], ["toxic", "number"])

    return run


def _scoring(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            score = np.zeros(len(batch))
            for a, b in chunks(ends, TEXT_BYTES) if model is not None else ():
                score[a:b] = model.scores(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scoring(model), "doc_id long, held_out boolean, score double, predicted int")
