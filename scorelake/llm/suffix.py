"""Exact duplicate passages by a bucketed suffix array with deep-shallow sorting.

Every byte that a LENGTH-byte string covers is removed if that string also starts in a text with a smaller id.

1. The suffixes are dealt by content: each LENGTH-byte window belongs to the window's minimizer, the K-gram of least
   hash, leftmost first. Equal windows have equal minimizers, so a run of windows with one minimizer (a segment) goes to
   the bucket of that K-gram's hash, and all equal windows of the corpus meet in one bucket. Only segments that may
   share a window are sent: texts are packed into parts, each part sends short hashes of its segments' K-grams with the
   bytes beside them, and learns which of them other parts have. Equal segments of a part are merged before the shuffle:
   the smallest id is sent, the others are known to be covered. Of equal segments of one text those that overlap are
   sent once with their reach, so that a run of one byte or of a short pattern costs one record, however long it is.
2. In a bucket only K-grams of several texts matter. Equal segments are merged to their smallest id again. The suffixes
   that start in the remaining segments are sorted to LENGTH bytes: multikey quicksort on eight-byte words to the
   shallow depth SHALLOW, all open groups in step, then each group that still has a longer common prefix by a blind
   trie. Neighbours with LENGTH common bytes are equal windows; all but those of the smallest id are covered.
3. The covered intervals of each text meet its bytes, and the rest is kept.

At the two edges of a passage that very many texts hold, the segments reach into each text's own bytes, so all differ
and share their K-gram. A sample of the texts tells the K-grams of more than HOT different segments. Their windows are
dealt one by one, by a 128-bit hash of their LENGTH bytes: equal windows of a part are merged to their smallest id,
windows whose hint no other segment has are not sent, and the others spread over all buckets.

The number of buckets and parts grows with the input. A K-gram brings about HOT different segments to a bucket at most,
besides equal ones; a segment or window held by very many texts is sent once per part, which grows with the parts.

A text longer than a part is worked on in slices that overlap by LENGTH - 1 bytes: each window lies in one of them.

Defined cases: a null text has no bytes; texts of equal id (or with a null id, which counts as larger than any other)
do not cover each other; bytes are judged on the input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from scorelake.llm.common import Pieces, chunks, mixed, stored, text_bytes

LENGTH = 50
HASH_BYTES = 1 << 19
K = 16
SHALLOW = 24
#: Bytes of text of a part.
BATCH_BYTES = 1 << 20
#: Different segments of a K-gram from which its windows are dealt one by one, and how many of them a sample shows.
HOT = 4096
SHOWN = 64
#: Bytes of text for each bucket of segments.
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place on, for all places where K bytes follow."""
    h = raw.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < K:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return mixed(h)


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of width neighbours from each place on, the leftmost of equals."""
    # the place goes into the low half, so that one minimum gives both; the order is that of the high half of h
    low = np.uint64(32)
    key = (h >> low) << low | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows, text, minimizer place and its hash, of each run of windows with one minimizer place."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    sizes = np.diff(cuts)
    if len(raw) < LENGTH or not (sizes >= LENGTH).any():
        return none
    h = gram_hashes(raw)
    place = least_in_window(h, LENGTH - K + 1)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(place)]
    inside = np.arange(len(place), dtype=np.int64) <= (cuts[1:] - LENGTH)[owner]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(inside.astype(np.int64), first)
    # windows that cross into the next text come last in a text, so a run's inner windows lead it
    good = count > 0
    first, count = first[good], count[good]
    return first, count, owner[first], place[first], h[place[first]]


def range_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 128-bit hash of byte ranges, as two columns; a block of ranges at a time."""
    out = np.empty((len(start), 2), np.uint64)
    for a, b in chunks(np.r_[0, np.cumsum(size)], HASH_BYTES):
        part, ends = take_ranges(raw, start[a:b], size[a:b]).astype(np.uint64) + np.uint64(1), np.cumsum(size[a:b])
        for column, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power_table(base, len(part)), out=sums[1:])
            begin = ends - size[a:b]
            down = _power_table(pow(base, -1, 1 << 64), len(part))[begin]
            out[a:b, column] = mixed((sums[ends] - sums[begin]) * down + size[a:b].astype(np.uint64))
    return out


_tables: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        have = 1
        step_base = np.array([base], np.uint64)
        while have < len(out):
            step = min(have, len(out) - have)
            out[have : have + step] = out[:step] * (out[have - 1 : have] * step_base)
            have += step
        _tables[base] = out
    return _tables[base][:n]


def take_ranges(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return raw[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, first key first, and where its groups of equals begin."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


#: A segment: index into its blob's owners, first window, number of windows, and the K-gram's place from there.
#: reach: how far the last of its overlapping repeats in the text begins after the first.
SEGMENT = np.dtype([("owner", "<u4"), ("at", "<u4"), ("reach", "<u4"), ("count", "u1"), ("gram_at", "u1")])
#: A window that is dealt alone: the hash of its bytes, index into its blob's owners, and place.
WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("owner", "<u4"), ("at", "<u4"), ("reach", "<u4")])
#: The number of a text: its id with a hash of its bytes, which tells texts of one id apart.
TEXT = np.dtype([("id", "<i8"), ("tag", "<u4")])
INTERVAL = np.dtype([("id", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("stop", "<i4")])
#: Bytes beside a K-gram that its hint covers; half of what a window has beside it.
SIDE = (LENGTH - K) // 2
ROW = np.dtype([("id", "<i8"), ("tag", "<u4"), ("size", "<i8")])


def merged(intervals: np.ndarray) -> np.ndarray:
    """Disjoint maximal intervals of each text, sorted."""
    if not len(intervals):
        return intervals
    intervals = intervals[np.lexsort((intervals["start"], intervals["tag"], intervals["id"]))]
    # a running maximum that starts anew with each text
    new = np.r_[True, (np.diff(intervals["id"]) != 0) | (intervals["tag"][1:] != intervals["tag"][:-1])]
    lift = np.cumsum(new) << 32
    reach = np.maximum.accumulate(intervals["stop"] + lift)
    new[1:] |= intervals["start"][1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = intervals[first].copy()
    out["stop"] = np.maximum.reduceat(intervals["stop"], first)
    return out


def pack(*tables: np.ndarray) -> bytes:
    """Tables column after column, compressed."""
    parts = [np.array([len(t) for t in tables], "<i8").tobytes()]
    for t in tables:
        parts += [np.ascontiguousarray(t[n]).tobytes() for n in t.dtype.names] if t.dtype.names else [t.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unpack(data: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds, strict=True):
        table = np.empty(n, kind)
        for name in kind.names or [None]:
            one = kind[name] if name else kind
            (table[name] if name else table)[...] = np.frombuffer(raw, one, n, at)
            at += n * one.itemsize
        out.append(table)
    return out


BYTE = np.dtype("u1")


def _texts(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(len(batch), TEXT)
    out["id"], out["tag"] = batch["id"].fill_null(NO_ID).to_numpy(), batch["tag"].to_numpy().astype(np.uint32)
    return out


def _blobs(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


PART_DATA = [("part", pa.int64()), ("data", pa.binary())]
BUCKET_DATA = [("bucket", pa.int32()), ("part", pa.int64()), ("data", pa.binary())]


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to packed parts of BATCH_BYTES, each under a number of its own."""
    for batch in batches:
        raw, ends = text_bytes(batch["text"])
        texts = _texts(batch)
        for a, b in chunks(ends, BATCH_BYTES):
            rows = np.empty(b - a, ROW)
            rows["id"], rows["tag"], rows["size"] = texts["id"][a:b], texts["tag"][a:b], np.diff(ends[a : b + 1])
            part = int.from_bytes(os.urandom(8), "little") >> 1
            rest = _to_ipc(batch.slice(a, b - a).select(["rest"])) if "rest" in batch.schema.names else b""
            yield _blobs([*PART_DATA, ("rest", pa.binary())], [(part, pack(rows, raw[ends[a] : ends[b]]), rest)])


def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, raw = unpack(data, ROW, BYTE)
    return raw, np.r_[0, np.cumsum(rows["size"])], rows[["id", "tag"]].astype(TEXT)


def slices(raw: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes and offsets of a part, a longer text in overlapping slices, and where each slice begins."""
    if len(cuts) != 2 or len(raw) <= BATCH_BYTES + LENGTH:
        yield raw, cuts, 0
        return
    for a in range(0, len(raw) - LENGTH + 1, BATCH_BYTES):
        part = raw[a : a + BATCH_BYTES + LENGTH - 1]
        yield part, np.array([0, len(part)]), a


def overlapping_runs(group: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places of equal segments of a text the first of each run of overlapping ones, and the run's reach."""
    order = np.lexsort((at, owner, group))
    g, o, place = group[order], owner[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (np.diff(place) > LENGTH)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(order)] - 1
    return order[first], place[last] - place[first]


def side_hashes(raw: np.ndarray, first: np.ndarray, place: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the hashes of the K-gram with SIDE bytes after it, and with SIDE bytes before it; 0 where the
    segment's windows do not reach so far. A window has LENGTH - K bytes beside its K-gram, so SIDE or more on one side:
    equal windows share one of the two."""
    pieces = Pieces(raw)
    out = []
    for tag, start, stop, has in ((1, place, place + K + SIDE, place + K + SIDE <= first + count + LENGTH - 1), (2, place - SIDE, place + K, place - SIDE >= first)):
        h = np.zeros(len(first), np.uint64)
        h[has] = mixed(pieces.hash(start[has], stop[has]) + np.uint64(tag)) >> np.uint64(64 - bits) | np.uint64(1)
        out.append(h)
    return out[0], out[1]


def _hints(buckets: int, bits: int):
    """Packed parts to their sorted side hashes by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"], strict=True):
                raw, cuts, _ = _unpacked(data.as_py())
                found = []
                for some, at, _ in slices(raw, cuts):
                    first, count, _, place, _ = segments(some, at)
                    if len(first):
                        found.append(np.unique(np.concatenate(side_hashes(some, first, place, count, bits))))
                if not found:
                    continue
                sides = np.unique(np.concatenate(found))
                sides = sides[sides > 0]
                home = ((sides >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                yield _blobs(BUCKET_DATA, [(b, part, pack(np.diff(mine, prepend=np.uint64(0)))) for b, mine in _by(home, sides)])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The blobs of each bucket, of batches sorted by bucket."""
    current, held = None, []
    for batch in batches:
        for bucket, part, data in zip(batch["bucket"].to_pylist(), batch["part"].to_pylist(), batch["data"], strict=True):
            if bucket != current and held:
                yield current, held
                held = []
            current = bucket
            held.append((part, data.as_py()))
    if held:
        yield current, held


U64 = np.dtype("<u8")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part's side hashes those that another part has too."""
    for _, held in _grouped(batches):
        lists = [np.cumsum(unpack(data, U64)[0]) for _, data in held]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if len(twice):
            for (part, _), mine in zip(held, lists, strict=True):
                mine = mine[twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine]
                if len(mine):
                    yield _blobs(PART_DATA, [(part, pack(np.diff(mine, prepend=np.uint64(0))))])


def _sampled_segments(rate: float):
    """The K-gram hash and the hash of the bytes of each segment of a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for batch in batches:
            for data in batch["data"]:
                raw, cuts, _ = _unpacked(data.as_py())
                size = np.diff(cuts)
                chosen = np.flatnonzero(rng.random(len(size)) < rate)
                raw = take_ranges(raw, cuts[chosen], size[chosen])
                first, count, _, _, gram = segments(raw, np.r_[0, np.cumsum(size[chosen])])
                if len(first):
                    columns = [gram, range_hashes(raw, first, count + LENGTH - 1)[:, 0]]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["gram", "segment"])

    return run


def hot_grams(data: DataFrame, hot: int) -> np.ndarray:
    """Sorted hashes of the K-grams of about hot or more different segments; of n segments there are n / hot at most.

    Which K-grams are listed is a matter of cost alone: the one list decides for all parts.
    """
    rate = min(1.0, SHOWN / hot)
    seen = data.mapInArrow(_sampled_segments(rate), "gram long, segment long").distinct().groupBy("gram").count()
    found = seen.where(F.col("count") >= max(2, int(hot * rate))).select("gram").toArrow()["gram"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def is_among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _scatter(buckets: int, bits: int, hot: np.ndarray):
    """Cogrouped by part, texts and shared side hashes: to segments by bucket, windows of the K-grams in hot by bucket
    (numbered from buckets on), and the intervals known in the part."""

    def run(key: tuple, texts: pa.Table, hints: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = []
        for data in texts["data"]:
            raw, cuts, names = _unpacked(data.as_py())
            shared = [np.cumsum(unpack(x.as_py(), U64)[0]) for x in hints["data"]]
            for some, at, begin in slices(raw, cuts):
                rows += [(b, part, kind, blob) for b, kind, blob in flush(some, at, begin, names, shared)]
        names = [("bucket", pa.int32()), ("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names)})

    def flush(raw: np.ndarray, cuts: np.ndarray, begin_at: int, texts: np.ndarray, shared: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        first, count, owner, place, gram = segments(raw, cuts)
        if not len(first):
            return
        right, left = side_hashes(raw, first, place, count, bits)
        # of hashes in this part alone only those of several texts matter; they join those that other parts have
        wanted = [*shared]
        for side in (right, left) if len(texts) > 1 else ():
            turn = np.argsort(side, kind="stable")
            own, whose = side[turn], owner[turn]
            wanted.append(own[1:][(own[1:] == own[:-1]) & (own[1:] > 0) & (whose[1:] != whose[:-1])])
        if not wanted:
            return
        wanted = np.unique(np.concatenate(wanted))
        if not len(wanted):
            return
        right, left = is_among(right, wanted), is_among(left, wanted)
        near = right | left
        first, count, owner, place, gram, right, left = (x[near] for x in (first, count, owner, place, gram, right, left))
        if not len(first):
            return
        ids = texts["id"]
        same = range_hashes(raw, first, count + LENGTH - 1)
        order, begin = groups_of(same[:, 0], same[:, 1], gram)
        least = np.minimum.reduceat(ids[owner[order]], begin)
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        known = np.zeros(len(first), bool)
        known[order] = ids[owner[order]] > least[group]
        covered = merged(_intervals(texts[owner[known]], first[known] - cuts[owner[known]] + begin_at, count[known]))
        if len(covered):
            yield int(covered["tag"][0]) % buckets, 1, pack(covered)
        groups = np.empty(len(first), np.int64)
        groups[order] = group
        lead, reach = overlapping_runs(groups[~known], owner[~known], first[~known])
        first, count, owner, place, gram, right, left = (x[~known][lead] for x in (first, count, owner, place, gram, right, left))
        many = is_among(gram, hot)
        if many.any():
            yield from windows(raw, cuts, begin_at, texts, *(x[many] for x in (first, count, owner, place, right, left, reach)))
            first, count, owner, place, gram, reach = (x[~many] for x in (first, count, owner, place, gram, reach))
        home = (mixed(gram) % np.uint64(buckets)).astype(np.int64)
        for b, mine in _by(home, np.arange(len(home))):
            named, index = np.unique(owner[mine], return_inverse=True)
            rows = np.empty(len(mine), SEGMENT)
            rows["owner"], rows["at"], rows["count"], rows["gram_at"], rows["reach"] = index, first[mine] - cuts[owner[mine]] + begin_at, count[mine], place[mine] - first[mine], reach[mine]
            yield b, 0, pack(rows, texts[named], take_ranges(raw, first[mine], count[mine] + LENGTH - 1))

    def windows(raw: np.ndarray, cuts: np.ndarray, begin_at: int, texts: np.ndarray, first: np.ndarray, count: np.ndarray, owner: np.ndarray, place: np.ndarray, right: np.ndarray, left: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        of = np.repeat(np.arange(len(first)), count)
        at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        # a window with SIDE bytes after its K-gram has the right hint, any other the left one
        some = np.where(at + LENGTH >= place[of] + K + SIDE, right[of], left[of])
        at, owner, reach = at[some], owner[of[some]], reach[of[some]]
        if not len(at):
            return
        same, ids = range_hashes(raw, at, np.full(len(at), LENGTH)), texts["id"]
        order, begin = groups_of(same[:, 0], same[:, 1])
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        known = np.zeros(len(at), bool)
        known[order] = ids[owner[order]] > np.minimum.reduceat(ids[owner[order]], begin)[group]
        covered = merged(_intervals(texts[owner[known]], at[known] - cuts[owner[known]] + begin_at, np.ones(known.sum(), np.int64), reach[known]))
        if len(covered):
            yield int(covered["tag"][0]) % buckets, 1, pack(covered)
        at, owner, same, reach = at[~known], owner[~known], same[~known], reach[~known]
        home = ((same[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        for b, mine in _by(home, np.arange(len(home))):
            named, index = np.unique(owner[mine], return_inverse=True)
            rows = np.empty(len(mine), WINDOW)
            rows["high"], rows["low"], rows["owner"], rows["at"], rows["reach"] = same[mine, 0], same[mine, 1], index, at[mine] - cuts[owner[mine]] + begin_at, reach[mine]
            yield buckets + b, 0, pack(rows, texts[named])

    return run


def _by(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for a, b in zip(first, [*first[1:], len(key)], strict=True):
        yield int(key[a]), rows[a:b]


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of words within their groups, to the depth of the words.

    Three-way quicksort where a character is an eight-byte word and all open groups are split in step: each group takes
    a pivot, its rows go below, to or above it, and the equal ones move on to the next word. group: sorted numbers.
    Returns the order of the rows and the final groups of equal rows, in that order.
    """
    n, depth = words.shape
    order = np.arange(n)
    level = np.zeros(n, np.int64)
    group = np.unique(group, return_inverse=True)[1].astype(np.int64) if n else group
    while True:
        size = np.bincount(group) if n else np.zeros(0, np.int64)
        open_ = (size[group] > 1) & (level < depth)
        at = np.flatnonzero(open_)
        if not len(at):
            return order, group
        g = group[at]
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        counts = np.diff(np.r_[begin, len(g)])
        value = words[order[at], level[at]]
        # the median of three is the pivot
        a, b, c = value[begin], value[begin + counts // 2], value[begin + counts - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), counts)
        side = (value > pivot).astype(np.int64) + (value >= pivot)
        local = np.repeat(np.arange(len(begin)), counts)
        turn = np.argsort(local * 3 + side, kind="stable")
        order[at] = order[at][turn]
        level[at] = level[at][turn] + (side[turn] == 1)
        # new numbers: three for each old one keep the order
        wide = group * 3 + 1
        wide[at] = g[turn] * 3 + side[turn]
        group = np.r_[0, np.cumsum(np.diff(wide) != 0)]


class BlindTrie:
    """A compacted trie that keeps only branch depths and first bytes: each new string is blindly led to one leaf,
    compared with it once, and hung in at the depth where they part."""

    def __init__(self, text: bytes, length: int):
        self.text, self.length = text, length
        #: A leaf is a list of places of equal strings; a branch is (depth, {byte: child}).
        self.root: list | tuple | None = None

    def add(self, place: int) -> None:
        text = self.text
        if self.root is None:
            self.root = [place]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(text[place + node[0]]) or next(iter(node[1].values()))
        other, depth = node[0], 0
        while depth < self.length and text[other + depth] == text[place + depth]:
            depth += 1
        if depth == self.length:
            node.append(place)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][text[place + node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][text[place + depth]] = [place]
            return
        branch = (depth, {text[other + depth]: node, text[place + depth]: [place]})
        if parent is None:
            self.root = branch
        else:
            parent[1][text[place + parent[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """The groups of equal strings in order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node:
                out.append(node)
        return out


def sorted_windows(text: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at start, to LENGTH bytes, sorted within groups; the order and the groups of equal ones."""
    padded = np.r_[text, np.zeros(64, np.uint8)]
    eight = np.zeros(len(text) + 56, np.uint64)
    for i in range(8):
        eight |= padded[i : i + len(eight)].astype(np.uint64) << np.uint64(56 - 8 * i)
    shallow = np.stack([eight[start + d] for d in range(0, SHALLOW, 8)], axis=1)
    order, group = multikey_quicksort(shallow, group)
    # deep part: a group whose rest is all alike needs no trie
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    at = start[order]
    alike = np.ones(len(at), bool)
    head = at[begin[group]] if len(at) else at
    for d in [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]:
        alike &= eight[at + d] == eight[head + d]
    uneven = np.unique(group[~alike])
    raw, extra = text.tobytes(), np.zeros(len(order), np.int64)
    for g in uneven.tolist():
        a, b = begin[g], begin[g] + size[g]
        trie = BlindTrie(raw, LENGTH - SHALLOW)
        where: dict[int, int] = {}
        for i in range(a, b):
            where[int(at[i]) + SHALLOW] = order[i]
            trie.add(int(at[i]) + SHALLOW)
        k = a
        for n, leaf in enumerate(trie.leaves()):
            for p in leaf:
                order[k] = where[p]
                extra[k] = n
                k += 1
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (extra[1:] != extra[:-1])
    return order, np.cumsum(new) - 1


OPEN = np.dtype([("gram", "<u8"), ("part", "<i4"), ("id", "<i8"), ("tag", "<u4"), ("at", "<i4"), ("count", "<i8"), ("reach", "<i8")])
#: Windows that are sorted at a time; the windows of one K-gram stay together.
SLICE = 1 << 18


def covered_in_bucket(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The intervals that the segments of one bucket cover in texts of larger ids, and the blob of each."""
    rows, owners, text, base, parts = [], [], [], 0, []
    for n, blob in enumerate(blobs):
        one, names, part = unpack(blob, SEGMENT, TEXT, BYTE)
        one["owner"] += base
        base += len(names)
        parts.append(np.full(len(names), n, np.int32))
        rows.append(one)
        owners.append(names)
        text.append(part)
    wire, owners, text = np.concatenate(rows), np.concatenate(owners), np.concatenate(text)
    size = wire["count"].astype(np.int64) + LENGTH - 1
    start = np.cumsum(size) - size
    rows = np.empty(len(wire), OPEN)
    rows["at"], rows["count"], rows["reach"], rows["part"] = wire["at"], wire["count"], wire["reach"], np.concatenate(parts)[wire["owner"]]
    rows["id"], rows["tag"] = owners["id"][wire["owner"]], owners["tag"][wire["owner"]]
    rows["gram"] = gram_hashes(take_ranges(text, start + wire["gram_at"], np.full(len(wire), K)))[::K]
    del wire, owners
    # K-grams of one text only can cover nothing
    order, begin = groups_of(rows["gram"])
    ids = rows["id"][order]
    several = np.maximum.reduceat(ids, begin) > np.minimum.reduceat(ids, begin)
    kept = np.sort(order[np.repeat(several, np.diff(np.r_[begin, len(order)]))])
    if not len(kept):
        return np.zeros(0, INTERVAL), np.zeros(0, np.int32)
    text = take_ranges(text, start[kept], size[kept])
    rows, size = rows[kept], size[kept]
    start = np.cumsum(size) - size
    # equal segments: those of the smallest id go on
    same = range_hashes(text, start, size)
    order = np.lexsort((rows["id"], same[:, 1], same[:, 0], rows["gram"]))
    begin = np.flatnonzero(np.r_[True, np.any([np.diff(k[order]) != 0 for k in (rows["gram"], same[:, 0], same[:, 1])], axis=0)])
    group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    covered = np.zeros(len(rows), bool)
    covered[order] = rows["id"][order] > rows["id"][order[begin]][group]
    out = [(_intervals(rows[covered], rows["at"][covered], rows["count"][covered], rows["reach"][covered]), rows["part"][covered])]
    lead = order[~covered[order]]
    # only the segments that share their K-gram with a different segment are sorted window by window
    gram = rows["gram"][lead]
    edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    ids = rows["id"][lead]
    rivals = np.repeat(np.maximum.reduceat(ids, edge) > np.minimum.reduceat(ids, edge), np.diff(np.r_[edge, len(gram)]))
    lead, gram = lead[rivals], gram[rivals]
    if len(lead):
        edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        weight = np.add.reduceat(rows["count"][lead], edge)
        turn = np.cumsum(weight) // SLICE
        cut = edge[np.flatnonzero(np.r_[True, np.diff(turn) != 0])]
        for a, b in zip(cut, [*cut[1:], len(lead)], strict=True):
            mine = lead[a:b]
            out.append(_covered_windows(rows[mine], take_ranges(text, start[mine], size[mine]), np.cumsum(size[mine]) - size[mine]))
    return np.concatenate([x for x, _ in out]), np.concatenate([p for _, p in out])


def _covered_windows(rows: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the windows of the segments, sorted by K-gram, that also start in a text with a smaller id."""
    count = rows["count"]
    of = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    order, equal = sorted_windows(text, start[of] + offset, np.repeat(np.r_[0, np.cumsum(rows["gram"][1:] != rows["gram"][:-1])], count))
    begin = np.flatnonzero(np.r_[True, equal[1:] != equal[:-1]])
    ids = rows["id"][of[order]]
    window = np.sort(order[ids > np.minimum.reduceat(ids, begin)[equal]])
    if not len(window):
        return np.zeros(0, INTERVAL), np.zeros(0, np.int32)
    # neighbouring windows of one segment make one run
    at = np.flatnonzero(np.r_[True, (np.diff(window) != 1) | (np.diff(of[window]) != 0)])
    hit = window[at]
    return _intervals(rows[of[hit]], rows["at"][of[hit]] + offset[hit], np.diff(np.r_[at, len(window)]), rows["reach"][of[hit]]), rows["part"][of[hit]]


def _intervals(rows: np.ndarray, at: np.ndarray, count: np.ndarray, reach: np.ndarray | int = 0) -> np.ndarray:
    """What count windows from at on cover, with repeats up to reach: these begin LENGTH bytes apart at most."""
    out = np.empty(len(rows), INTERVAL)
    out["id"], out["tag"], out["start"], out["stop"] = rows["id"], rows["tag"], at, at + count + LENGTH - 1 + reach
    return out


def covered_by_hash(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The intervals that windows dealt alone cover in texts of larger ids, and the blob of each."""
    pairs = [unpack(blob, WINDOW, TEXT) for blob in blobs]
    parts = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(rows) for rows, _ in pairs])
    texts = np.concatenate([names[rows["owner"]] for rows, names in pairs])
    rows = np.concatenate([rows for rows, _ in pairs])
    order, begin = groups_of(rows["high"], rows["low"])
    ids = texts["id"][order]
    group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    gone = order[ids > np.minimum.reduceat(ids, begin)[group]]
    return _intervals(texts[gone], rows["at"][gone].astype(np.int64), np.ones(len(gone), np.int64), rows["reach"][gone].astype(np.int64)), parts[gone]


def _sort_buckets(buckets: int):
    """Partitions sorted by bucket and kind: each bucket's segments are sorted, known intervals pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def open_ones() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                closed = batch.filter(pc.equal(batch["kind"], 1))
                passing.extend(zip(closed["part"].to_pylist(), closed["data"].to_pylist(), strict=True))
                yield batch.filter(pc.equal(batch["kind"], 0)).select(["bucket", "part", "data"])

        passing: list[tuple[int, bytes]] = []
        for bucket, held in _grouped(open_ones()):
            found, blob = (covered_in_bucket if bucket < buckets else covered_by_hash)([data for _, data in held])
            rows = [(held[n][0], pack(merged(mine))) for n, mine in _by(blob, found)]
            if rows or passing:
                yield _blobs(PART_DATA, rows + passing)
            passing.clear()
        if passing:
            yield _blobs(PART_DATA, passing)

    return run


def _cut_texts(texts: pa.Table, found: pa.Table) -> Iterator[tuple[np.void, bytes, bytes, int]]:
    """Cogrouped by part: the number of each text, its bytes, what is kept of them, and how many spans go."""
    rows = [unpack(x.as_py(), INTERVAL)[0] for x in found["data"]]
    cover = merged(np.concatenate(rows)) if rows else np.zeros(0, INTERVAL)
    names, begin = np.unique(cover[["id", "tag"]].astype(TEXT), return_index=True)
    stop = np.r_[begin[1:], len(cover)]
    for blob in texts["data"]:
        table, raw = unpack(blob.as_py(), ROW, BYTE)
        own = table[["id", "tag"]].astype(TEXT)
        place = np.searchsorted(names, own)
        ends = np.cumsum(table["size"])
        for k, p in enumerate(place):
            mine = raw[ends[k] - table["size"][k] : ends[k]].tobytes()
            gone = cover[begin[p] : stop[p]] if p < len(names) and names[p] == own[k] else cover[:0]
            left, at = [], 0
            for x, y in zip(gone["start"].tolist(), gone["stop"].tolist(), strict=True):
                left.append(mine[at:x])
                at = y
            yield own[k], mine, b"".join([*left, mine[at:]]), len(gone)


def _digests(texts: pa.Table, found: pa.Table) -> pa.Table:
    out = [{"doc_id": None if own["id"] == NO_ID else int(own["id"]), "n_bytes": len(mine), "n_removed": len(mine) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()} for own, mine, kept, spans in _cut_texts(texts, found)]
    return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _kept_rows(names: list[str], schema: pa.Schema):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not len(texts):
            return schema.empty_table()
        # a character that a removed span cuts goes with it
        pairs = [(kept.decode("utf-8", "ignore"), spans) for _, _, kept, spans in _cut_texts(texts, found)]
        kept, left = pa.array([t for t, _ in pairs], pa.string()), pa.array([bool(t) or not spans for t, spans in pairs], pa.bool_())
        rest = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in texts["rest"]])["rest"].combine_chunks()
        rest = pa.concat_arrays(rest.chunks) if isinstance(rest, pa.ChunkedArray) else rest
        columns = dict(zip([f.name for f in rest.type], rest.flatten(), strict=True))
        return pa.table({n: kept if n == "text" else columns[n] for n in names}).cast(schema).filter(left)

    return run


def dealt(docs: DataFrame, key: str, text: str, bucket_bytes: int, rest: bool = False, hot: int = HOT) -> tuple[DataFrame, DataFrame, int]:
    """Packed texts, the segments and windows sent to the buckets, and the number of buckets."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), text_tag(text).alias("tag"), F.col(text).cast("string").alias("text"), *[F.struct(*[c for c in docs.columns if c != text]).alias("rest")] * rest)
    texts = stored(rows.mapInArrow(_pack_texts, "part long, data binary, rest binary"), "suffix-texts")
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    bits = min(63, max(36, int(total).bit_length() + 6))
    width = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    data = texts.select("part", "data")
    hints = data.mapInArrow(_hints(buckets, bits), "bucket int, part long, data binary")
    shared = hints.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "part long, data binary")
    scatter = _scatter(buckets, bits, hot_grams(data, hot))
    return texts, data.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(scatter, "bucket int, part long, kind int, data binary"), buckets


def covered(docs: DataFrame, key: str, text: str, bucket_bytes: int, rest: bool = False, hot: int = HOT):
    """Packed texts and covered intervals, cogrouped by part; with rest the packed texts also hold all other columns."""
    texts, scattered, buckets = dealt(docs, key, text, bucket_bytes, rest, hot)
    width = max(1, min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = scattered.repartition(width, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_sort_buckets(buckets), "part long, data binary")
    return (texts if rest else texts.select("part", "data")).groupBy("part").cogroup(found.groupBy("part"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return covered(docs, key, text, bucket_bytes, hot=hot).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_duplicates(docs: DataFrame, key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with the duplicate passages cut from their text; rows of which the cuts leave nothing go. Null and empty texts
    lose nothing and stay."""
    schema = to_arrow_schema(docs.schema)
    cut = covered(docs.where(F.col("text").isNotNull()), key, "text", bucket_bytes, rest=True).applyInArrow(_kept_rows(docs.columns, schema), docs.schema)
    return cut.union(docs.where(F.col("text").isNull()))


def text_tag(text: str):
    return F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(1 << 32))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)
