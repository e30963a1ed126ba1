"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is its words, each a run of spaces with what follows it. A word starts as characters; an agenda holds the
adjacent pairs whose concatenation is a piece, best score first and then leftmost; each candidate is skipped for good
if a hash keyed by the seed, the document's id and the word's place in the text, of the pair's place and its two pieces,
falls below the dropout rate; the others are merged in agenda order. Characters outside the vocabulary become byte pieces, and so does
a literal U+2581, so that decoding restores every text exactly. So every
occurrence of a word has draws of its own.

A word's merges without dropout are found once per chunk. An occurrence of which no such merge is skipped has just these,
since a skipped candidate that would not be merged changes nothing; only the others run an agenda of their own.

Since the choice to skip a candidate depends only on its identity, skipped candidates are simply never listed. The words
of a chunk run their agendas side by side in arrays, one merge per word and round; words of over LONG characters use a
heap each.

Defined cases: null and empty texts have no pieces; a null id counts as a hash of 0; repeated rows are encoded alike; only the
id and text columns are read. The tokenizer file is a parameter.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Pieces, chunks, mixed, text_bytes

MODEL = os.environ.get("SCORELAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RATE, SEED = 0.1, 20240817
LONG = 256
TEXT_BYTES = 1 << 19
NONE = np.int64(1) << 40
SPACE = "▁"


class Vocabulary:
    """Tables of a BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.bytes_of: list[bytes] = []
        rank: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        order = sorted(normal, key=lambda x: (-model.get_score(normal[x]), normal[x]))
        rank = {piece: r for r, piece in enumerate(order)}
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("pieces that span words are not supported")
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(" " if piece == SPACE else piece)] = i
        self.char[ord(SPACE)] = -1
        pairs = [(normal[p[:k]] * self.size + normal[p[k:]], rank[p], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs] + [NONE], np.int64)
        self.made = np.array([x[2] for x in pairs] + [-1], np.int32)
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # open-addressed table of the pairs
        self.mask = (1 << (2 * len(pairs)).bit_length()) - 1
        self.slots = np.full(self.mask + 1, len(pairs), np.int32)
        left = np.arange(len(pairs))
        probe = self._slot(self.keys)
        while len(left):
            free = self.slots[probe] == len(pairs)
            self.slots[probe[free]] = left[free]
            lost = self.slots[probe] != left
            left, probe = left[lost], (probe[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the tables; the last entry if there is none."""
        known = (left >= 0) & (right >= 0)
        keys = np.where(known, left.astype(np.int64) * self.size + right, -1)
        probe, out = self._slot(keys), np.full(len(keys), len(self.keys), np.int64)
        todo = np.flatnonzero(known)
        while len(todo):
            at = self.slots[probe[todo]]
            empty = at == len(self.keys)
            hit = ~empty
            hit[hit] = self.keys[at[hit]] == keys[todo[hit]]
            out[todo[hit]] = at[hit]
            todo = todo[~empty & ~hit]
            probe[todo] = (probe[todo] + 1) & self.mask
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def skipped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate of two pieces at a place of a keyed word is dropped."""
    with np.errstate(over="ignore"):
        h = mixed(key ^ mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def segment_word(voc: Vocabulary, chars: np.ndarray, key: int, rate: float) -> np.ndarray:
    """One word by a heap: the final symbols, with -1 - code point for a character outside the vocabulary."""
    sym = [int(s) if s >= 0 else -1 - int(c) for s, c in zip(voc.char[chars], chars, strict=True)]
    n = len(sym)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        at = int(voc.pair(np.array([sym[i]]), np.array([sym[j]]))[0])
        if at < len(voc.keys) and not skipped(np.array([key], np.uint64), np.array([i]), np.array([sym[i]]), np.array([sym[j]]), rate)[0]:
            heapq.heappush(agenda, (int(voc.ranks[at]), i, sym[i], sym[j], int(voc.made[at])))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, a, b, made = heapq.heappop(agenda)
        j = right[i]
        if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], right[i] = made, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return np.array([s for s, a in zip(sym, alive, strict=True) if a], np.int64)


def segment_words(voc: Vocabulary, chars: np.ndarray, cuts: np.ndarray, keys: np.ndarray, rate: float, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All words chars[cuts[k]:cuts[k+1]] by parallel agendas: final symbols in order, and the word of each.

    log: takes (word, place, left, right) of the merges of each round, of words of LONG characters at most.
    """
    sizes = np.diff(cuts)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(chars)) - cuts[:-1][word]
    sym = voc.char[chars].astype(np.int64)
    sym = np.where(sym < 0, -1 - chars.astype(np.int64), sym)
    done_w, done_p, done_s = [], [], []
    for k in np.flatnonzero(sizes > LONG).tolist():
        got = segment_word(voc, chars[cuts[k] : cuts[k + 1]], int(keys[k]), rate)
        done_w.append(np.full(len(got), k))
        done_p.append(np.arange(len(got)))
        done_s.append(got)
    keep = sizes[word] <= LONG
    word, place, sym = word[keep], place[keep], sym[keep]

    def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda order and merged piece of the pairs that begin at the symbols i, which are not the last."""
        near = word[i] == word[i + 1]
        at = np.full(len(i), len(voc.keys), np.int64)
        at[near] = voc.pair(sym[i[near]], sym[i[near] + 1])
        listed = np.flatnonzero(at < len(voc.keys))
        if rate > 0 and len(listed):
            j = i[listed]
            at[listed[skipped(keys[word[j]], place[j], sym[j], sym[j + 1], rate)]] = len(voc.keys)
        return voc.ranks[at], voc.made[at]

    rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        rank[:-1], made[:-1] = ranked(np.arange(len(sym) - 1))
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(word)])
        # rank, then place in the array, in one number
        order = np.where(rank < NONE, rank << 40 | np.arange(len(sym)), np.int64(1) << 62)
        best = np.minimum.reduceat(order, first)
        busy = best < np.int64(1) << 62
        if not busy.all():
            still = np.repeat(busy, size)
            done_w.append(word[~still])
            done_p.append(place[~still])
            done_s.append(sym[~still])
            word, place, sym, rank, made = word[still], place[still], sym[still], rank[still], made[still]
            if not len(sym):
                break
            moved = np.cumsum(np.r_[0, still[:-1]])
            best = best[busy]
            at = moved[best & ((1 << 40) - 1)]
        else:
            at = best & ((1 << 40) - 1)
        if log is not None:
            log.append((word[at], place[at], sym[at], sym[at + 1]))
        sym[at] = made[at]
        left = np.ones(len(sym), bool)
        left[at + 1] = False
        at = at - np.arange(len(at))  # one symbol goes from each earlier word
        word, place, sym, rank, made = word[left], place[left], sym[left], rank[left], made[left]
        for i in (at, at - 1):
            i = i[(i >= 0)]
            rank[i[i == len(sym) - 1]] = NONE
            i = i[i < len(sym) - 1]
            rank[i], made[i] = ranked(i)
    w, p, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_w, done_p, done_s))
    turn = np.argsort(w << 32 | p, kind="stable")
    return s[turn], w[turn]


def _segmented(voc: Vocabulary, spread: np.ndarray, start: np.ndarray, stop: np.ndarray, keys: np.ndarray, rate: float, log: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segment_words of byte ranges, and the number of characters of each."""
    size = stop - start
    ends = np.r_[0, np.cumsum(size)]
    taken = spread[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    chars = np.frombuffer(taken.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    points = np.r_[0, np.cumsum((taken & 0xC0) != 0x80)][ends]
    return *segment_words(voc, chars, points, keys, rate, log), np.diff(points)


def _differs(log: list, keys: np.ndarray, which: np.ndarray, words: int, rate: float) -> np.ndarray:
    """Of which occurrences a merge of their word is skipped; keys, which: the key and the word of each."""
    if not log:
        return np.zeros(len(keys), bool)
    word, place, left, right = (np.concatenate(x) for x in zip(*log, strict=True))
    turn = np.argsort(word, kind="stable")
    merges = np.bincount(word, minlength=words)
    base, n = np.cumsum(merges) - merges, merges[which]
    of = np.repeat(np.arange(len(which)), n)
    at = turn[np.repeat(base[which] - (np.cumsum(n) - n), n) + np.arange(len(of))]
    out = np.zeros(len(keys), bool)
    out[of[skipped(keys[of], place[at], left[at], right[at], rate)]] = True
    return out


def encode(voc: Vocabulary, raw: np.ndarray, cuts: np.ndarray, streams: np.ndarray, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts of a chunk, and the n+1 offsets of their texts."""
    n = len(cuts) - 1
    full = np.diff(cuts) > 0
    # a space before every text that has a character
    spread = np.insert(raw, cuts[:-1][full], 32)
    starts = np.r_[0, np.cumsum(np.diff(cuts) + full)]
    space = spread == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[starts[:-1][full]] = True
    start = np.flatnonzero(begin)
    stop = np.r_[start[1:], len(spread)]
    owner = np.searchsorted(starts, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    _, first, which = np.unique(Pieces(spread).hash(start, stop), return_index=True, return_inverse=True)
    log: list | None = [] if rate > 0 else None
    sym, word, sizes = _segmented(voc, spread, start[first], stop[first], np.zeros(len(first), np.uint64), 0.0, log)
    total = len(first)
    if rate > 0:
        keys = mixed(mixed(streams[owner].astype(np.uint64) + np.uint64(seed)) + (start - starts[owner]).astype(np.uint64))
        own = np.flatnonzero(_differs(log, keys, which, total, rate) | (sizes > LONG)[which])
        if len(own):
            more, of, _ = _segmented(voc, spread, start[own], stop[own], keys[own], rate)
            sym, word = np.r_[sym, more], np.r_[word, of + total]
            which[own] = total + np.arange(len(own))
            total += len(own)
    if (sym < 0).any():
        width = np.ones(len(sym), np.int64)
        lost = np.flatnonzero(sym < 0)
        as_bytes = [chr(-1 - c).encode() for c in sym[lost].tolist()]
        width[lost] = [len(b) for b in as_bytes]
        out = np.repeat(sym, width)
        out[np.repeat(sym < 0, width)] = voc.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
        sym, word = out, np.repeat(word, width)
    count = np.bincount(word, minlength=total)
    base = np.cumsum(count) - count
    of_word = count[which]
    place = np.cumsum(of_word)
    ids = sym[np.repeat(base[which] - (place - of_word), of_word) + np.arange(place[-1])]
    return ids.astype(np.int32), np.r_[0, np.cumsum(np.bincount(owner, of_word, n).astype(np.int64))]


def decode(voc: Vocabulary, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the id lists ids[cuts[k]:cuts[k+1]] and their offsets."""
    size = voc.lengths[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    out = voc.flat[np.repeat(voc.starts[ids] - (end - size), size) + np.arange(total)]
    ends = np.r_[0, end][cuts]
    full = np.diff(ends) > 0
    out = np.delete(out, ends[:-1][full])  # the space before each text
    return out, np.r_[0, np.cumsum(np.diff(ends) - full)]


def _encoding(path: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            raw, ends = text_bytes(batch["text"])
            streams = batch["stream"].to_numpy()
            for a, b in chunks(ends, TEXT_BYTES):
                part, cuts = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                ids, at = encode(voc, part, cuts, streams[a:b], rate, seed)
                back, back_cuts = decode(voc, ids, at)
                same = np.diff(back_cuts) == np.diff(cuts)
                if same.all() and np.array_equal(back, part):
                    pass
                else:
                    same = np.array([s and np.array_equal(back[back_cuts[k] : back_cuts[k + 1]], part[cuts[k] : cuts[k + 1]]) for k, s in enumerate(same)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["stream"][a:b], lists, pa.array(np.diff(at)), pa.array(same)], ["doc_id", "stream", "ids", "n_pieces", "lossless"])

    return run


def encoded(docs: DataFrame, path: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, stream, ids, n_pieces, lossless): the pieces of each text and whether they decode to it.

    stream: the hash of the id that keys the draws of the text.
    """
    stream = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "doc_id")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stream.alias("stream"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(path, rate, seed), "doc_id long, stream long, ids array<int>, n_pieces long, lossless boolean")


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                lists = part["ids"].fill_null([]) if part["ids"].null_count else part["ids"]
                sizes = np.array([len(x) for x in lists], np.int64)
                raw, cuts = decode(voc, lists.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([raw[x:y].tobytes().decode("utf-8") for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())], ["doc_id", "text"])

    return run


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ids."""
    return rows.select("doc_id", "ids").mapInArrow(_decoding(path), "doc_id long, text string")
