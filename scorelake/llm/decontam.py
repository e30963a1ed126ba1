"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by `budget(m)` edits. Cut into budget+1 pieces, at least one piece
of it stands unchanged in the passage; so an Aho-Corasick automaton of all pieces finds every candidate place, and
Myers' bit-parallel search over the surrounding window gives the distance. Before the whole item is searched, the run of
pieces around the hit is doubled step by step: a run of j pieces must lie within j-1 edits of the text, since of two
runs that make up one within its budget at least one is within its own. Texts and items are compared in lower case
with white space collapsed. An item of under SHORT characters says little inside longer words: it matches only where the
characters beside the place are neither letters nor digits.

The items are a stated query set. Equal items are matched once; the distinct ones are written to the shared folder in files
of bounded size. One stage reads the documents: a task holds a bounded run of them, goes over the files and has the automaton
of one file at a time. Neither the items nor the documents pass through the driver.

Defined cases: null and empty texts match nothing; null and blank items are skipped, all others are searched; repeated
items and repeated documents give a row each; an empty table gives an empty result; only the id and text columns are
read; documents are dropped row by row, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stored

ERROR_RATE = 0.1
SHORT = 24
#: Bytes of items that one automaton holds.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that a task holds while it goes over the blocks, if there are several.
HELD_BYTES = 32 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors+1 pieces of nearly equal length with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def runs_above(piece: int, count: int) -> list[tuple[int, int]]:
    """The ranges of pieces of a halving tree that hold a piece, from its parent up, without the whole."""
    lo, hi, out = 0, count, []
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if piece < mid else (mid, hi)
    return out[:0:-1]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The smallest edit distance of the pattern to a substring of text, and the first end where it occurs."""
    full = (1 << m) - 1
    high = 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph <<= 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return best, end


def ends_within(peq: dict[str, int], m: int, text: str, limit: int) -> list[tuple[int, int]]:
    """(distance, end) of every end of a substring of text within limit edits of the pattern, nearest first."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        score += 1 if ph & high else -1 if mh & high else 0
        if score <= limit:
            out.append((score, j))
        ph <<= 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return sorted(out)


def bounded_match(item: str, errors: int, text: str, start: int, stop: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest place in text[start:stop] that no letter or digit touches."""
    peq, back = masks(item), masks(item[::-1])
    for distance, end in ends_within(peq, len(item), text[start:stop], errors):
        end += start
        if end < len(text) and text[end].isalnum():
            continue
        for _, length in ends_within(back, len(item), text[max(0, end - len(item) - errors) : end][::-1], distance):
            begin = end - length
            if begin == 0 or not text[begin - 1].isalnum():
                return distance, begin, end
    return None


class Matcher:
    """The automaton of a block of items; owners: the id and the number of copies of each item, where it was read from a file."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(k, item, budget(len(item), rate)) for k, item in items]
        self.owners: list[tuple[int | None, int]] = []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, tuple]]] = {}
        for n, (_, item, errors) in enumerate(self.items):
            cut = pieces(item, errors)
            ends = [at for at, _ in cut] + [len(item)]
            trees: dict[tuple[int, int], tuple] = {}
            for i, (at, piece) in enumerate(cut):
                above = []
                for lo, hi in runs_above(i, len(cut)):
                    if (lo, hi) not in trees:
                        trees[lo, hi] = (ends[lo], ends[hi], hi - lo - 1, masks(item[ends[lo] : ends[hi]]))
                    above.append(trees[lo, hi])
                places.setdefault(piece, []).append((n, at + len(piece) - 1, tuple(above)))
        for piece, owners in places.items():
            self.automaton.add_word(piece, tuple(owners))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def found(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for each item within its budget, at its best place; ends in normal(text)."""
        if not self.items:
            return
        windows: dict[int, list[list[int]]] = {}
        for at, owners in self.automaton.iter(text):
            for n, offset, above in owners:
                _, item, errors = self.items[n]
                origin = at - offset
                for lo, hi, few, peq in above:
                    if myers(peq, hi - lo, text[max(0, origin + lo - few) : max(0, origin + hi + few)])[0] > few:
                        break
                else:
                    few = -1
                if few >= 0:
                    continue
                start = origin - errors
                stop = origin + len(item) + errors
                runs = windows.setdefault(n, [])
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                    runs[-1][0] = min(runs[-1][0], start)
                else:
                    runs.append([start, stop])
        for n, runs in windows.items():
            key, item, errors = self.items[n]
            if n not in self.masks:
                self.masks[n] = masks(item)
            best = None
            for start, stop in runs:
                start = max(0, start)
                if len(item) < SHORT:
                    hit = bounded_match(item, errors, text, start, min(stop, len(text)))
                    best = min(filter(None, (best, hit)), default=None)
                    continue
                distance, end = myers(self.masks[n], len(item), text[start:stop])
                if distance <= errors and (best is None or distance < best[0]):
                    best = distance, start, start + end
            if best and len(item) < SHORT:
                yield key, *best
            elif best:
                distance, start, end = best
                _, length = myers(masks(item[::-1]), len(item), text[start:end][::-1])
                yield key, distance, end - length, end


def item_files(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = "item_id", text: str = "text") -> list[str]:
    """Files of the item table (id, text, copies) in the shared folder, each a block of about block_bytes."""
    items = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    items = items.groupBy("id", "text").agg(F.count("*").alias("copies"))
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return sorted(stored(items.repartition(max(1, -(-int(total) // block_bytes)), "id", "text"), "items").inputFiles())


_last: dict[tuple[str, float], Matcher] = {}


def matcher(file: str, rate: float) -> Matcher:
    """The automaton of one block; a worker holds one at a time and keeps it for its next task."""
    if (file, rate) not in _last:
        _last.clear()
        store, path = fs.FileSystem.from_uri(file)
        block = pq.read_table(path, filesystem=store).to_pylist()
        block = [(r["id"], normal(r["text"]), r["copies"]) for r in block]
        built = Matcher([(n, t) for n, (_, t, _) in enumerate(block) if t], rate)
        built.owners = [(k, c) for k, _, c in block]
        _last[file, rate] = built
    return _last[file, rate]


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in runs of about limit bytes."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _matching(files: list[str], rate: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _held(batches, HELD_BYTES if len(files) > 1 else 0):
            texts = [(key, normal(x.as_py())) for batch in run for key, x in zip(batch["id"].to_pylist(), batch["text"], strict=True) if x.is_valid]
            for file in files:
                block, rows = matcher(file, rate), []
                for key, text in texts:
                    for n, *place in block.found(text):
                        item, copies = block.owners[n]
                        rows += [(key, item, *place)] * copies
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

    return match


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): every pair of a document and an item within the item's budget."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_matching(item_files(benchmark, block_bytes), rate), "doc_id long, item_id long, distance long, start long, end long")


def _clean(files: list[str], rate: float, text: str, names: list[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _held(batches, HELD_BYTES if len(files) > 1 else 0):
            texts = [[None if not x.is_valid else normal(x.as_py()) for x in batch[text]] for batch in run]
            clean = [[True] * len(batch) for batch in run]
            for file in files:
                block = matcher(file, rate)
                clean = [[ok and (t is None or next(block.found(t), None) is None) for ok, t in zip(*both, strict=True)] for both in zip(clean, texts, strict=True)]
            for batch, ok in zip(run, clean, strict=True):
                yield batch.filter(pa.array(ok, pa.bool_())).select(names)

    return keep


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item leaks, judged row by row in one pass."""
    return docs.mapInArrow(_clean(item_files(benchmark, block_bytes), rate, text, docs.columns), docs.schema)
