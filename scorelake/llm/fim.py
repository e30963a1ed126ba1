"""Fill-in-the-middle transformation: cuts found on a wavelet matrix over character classes.

Each byte of a chunk of texts is a symbol of four bits: its own class (word, blank, line end, continuation of a character)
and the class of what follows (word, blank, line end, end of text). A wavelet matrix over the symbols answers how many of
each occur before a place. A unit (token, line or character) ends at the symbols of a fixed set, so the sum of their ranks
is the number of units that end before a place, and the place after which k units have ended is found by bisection on
that sum, for all texts of a chunk at once. The ranks of the continuation symbols give code points.

Two numbers and two shares, from a keyed digest of the document id, choose the cuts and the form: plain, PSM
(`<P>`prefix`<S>`suffix`<M>`middle) or SPM (`<S>`suffix`<P>`prefix`<M>`middle). Texts that are empty or hold a mark are
left plain, so an output is split again at its marks without loss: no mark can overlap another.

Plan: no shuffle; texts go through in chunks of about a megabyte, a longer text in a chunk of its own (about three bytes
of tables for each byte).

Defined cases: null text counts as empty and stays an empty plain text; a null id is written as nothing in the key; repeated
rows give equal rows; texts of blanks are one token. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, text_bytes

SEED = 42
#: Percent of texts that are transformed, and of those that take the SPM form.
RATE, SPM = 50, 80
MARKS = ("<P>", "<S>", "<M>")

WORD, BLANK, LINE, INNER = range(4)
END = INNER  # as the class of what follows, which is never the inside of a character
BITS = 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[10] = LINE
_CLASS[128:192] = INNER


def _symbols(own: tuple[int, ...], after: tuple[int, ...]) -> list[int]:
    return [4 * o + a for o in own for a in after]


#: The symbols at which a unit ends. A token is a word with the blanks before it, or the blanks at the end of the text.
UNITS = {
    "token": _symbols((WORD, INNER), (BLANK, LINE, END)) + _symbols((BLANK, LINE), (END,)),
    "line": _symbols((LINE,), (WORD, BLANK, LINE, END)) + _symbols((WORD, BLANK, INNER), (END,)),
}
CONTINUATIONS = _symbols((INNER,), (WORD, BLANK, LINE, END))


class WaveletMatrix:
    """Symbols of `bits` bits; rank in one step for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            packed = np.zeros(8 * (self.n // 64 + 1), np.uint8)
            packed[: (self.n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, self.n - int(before[-1])))
            one = bit.astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        w = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & low).astype(np.int64)

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place."""
        ends = np.append(place, 0)
        for level in range(self.bits):
            ones = self.ones(level, ends)
            ends = self.levels[level][2] + ones if symbol >> (self.bits - 1 - level) & 1 else ends - ones
        return ends[:-1] - ends[-1]

    def ranks(self, symbols: list[int], place: np.ndarray) -> np.ndarray:
        """The sum of the ranks of several symbols."""
        return sum((self.rank(s, place) for s in symbols), np.zeros(len(place), np.int64))

    def reached(self, symbols: list[int], start: np.ndarray, stop: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The least place from start at which `count` of the symbols have been passed, by bisection."""
        aim = self.ranks(symbols, start) + count
        low, high = start.copy(), stop.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.ranks(symbols, middle) >= aim
            open_ = low < high
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def symbols_of(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The symbols of a chunk of texts; cuts: their offsets, from 0."""
    own = _CLASS[raw]
    after = np.empty_like(own)
    after[:-1] = np.where(own[1:] == INNER, WORD, own[1:])
    last = cuts[1:][cuts[1:] > cuts[:-1]] - 1
    after[last] = END
    return own * 4 + after


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _form(text: bytes, h: list[int], rate: int, spm: int) -> str:
    if not text or any(m.encode() in text for m in MARKS) or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def _transformed(batches: Iterator[pa.RecordBatch], unit: str, rate: int, spm: int, seed: int) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in MARKS)
    ends = UNITS[unit]
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        ids = batch["doc_id"].to_pylist()
        for a, b in chunks(offsets):
            cuts = offsets[a : b + 1] - offsets[a]
            part = raw[offsets[a] : offsets[b]]
            matrix = WaveletMatrix(symbols_of(part, cuts), BITS)
            start, stop = cuts[:-1].astype(np.int64), cuts[1:].astype(np.int64)
            n = matrix.ranks(ends, stop) - matrix.ranks(ends, start)
            h = [draws(i, seed) for i in ids[a:b]]
            two = np.sort(np.array([x[:2] for x in h], np.int64).reshape(-1, 2) % (n + 1)[:, None], axis=1)
            first, second = (matrix.reached(ends, start, stop, two[:, k]) for k in (0, 1))
            inner = [matrix.ranks(CONTINUATIONS, x) for x in (start, first, second)]
            prefix, middle = first - start - (inner[1] - inner[0]), second - first - (inner[2] - inner[1])
            whole, out, forms = part.tobytes(), [], []
            for i in range(b - a):
                text = whole[start[i] : stop[i]]
                form = _form(text, h[i], rate, spm)
                x, y = int(first[i] - start[i]), int(second[i] - start[i])
                parts = {"plain": (text,), "psm": (p, text[:x], s, text[y:], m, text[x:y]), "spm": (s, text[y:], p, text[:x], m, text[x:y])}
                out.append(b"".join(parts[form]))
                forms.append(form)
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, unit: str = "token", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document, cut between units (`token` or `line`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _transformed(batches, unit, rate, spm, seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    p, s, m = MARKS
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digests(docs: DataFrame) -> DataFrame:
    """What `fill_in_middle` makes, with the digests of the outputs and of the texts made again from them."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
