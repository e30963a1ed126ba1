"""Suffix-array deduplication and SimHash groups against brute force."""

import hashlib
import random

import numpy as np
import pytest

from scorelake.llm import simhash, suffix


def brute_suffix(rows):
    order = lambda i: suffix.NO_ID if i is None else i
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(order(i), seen.get(b[p : p + 50], suffix.NO_ID))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_groups(fp, ids):
    group = {}
    left = list(range(len(fp)))
    while left:
        queue, members = [left.pop(0)], []
        while queue:
            x = queue.pop()
            members.append(x)
            near = [y for y in left if bin(int(fp[x]) ^ int(fp[y])).count("1") <= 3]
            left = [y for y in left if y not in near]
            queue += near
        known = [ids[m] for m in members if ids[m] is not None]
        group |= {m: min(known, default=None) for m in members}
    return [group[k] for k in range(len(fp))]


@pytest.mark.parametrize("bucket", [2000, 1 << 24])
def test_suffix_dedup_equals_brute_force(edge_docs, edge_rows, bucket):
    got = suffix.deduplicated(edge_docs, bucket_bytes=bucket).collect()
    assert sorted(map(tuple, got), key=str) == brute_suffix([(r[0], r[1]) for r in edge_rows])


def test_suffix_dedup_deals_the_edges_of_a_hot_passage_window_by_window(spark):
    rng = np.random.default_rng(3)
    own = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = own(200)
    rows = [(i, own(60) + passage + own(60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, sent, buckets = suffix.dealt(docs, "doc_id", "text", 2000, hot=32)
    most = 0
    for r in sent.where("kind = 0").collect():
        if r["bucket"] < buckets:
            wire, _, text = suffix.unpack(r["data"], suffix.SEGMENT, suffix.TEXT, suffix.BYTE)
            size = wire["count"].astype(np.int64) + suffix.LENGTH - 1
            start = np.cumsum(size) - size
            grams = [text[a : a + suffix.K].tobytes() for a in start + wire["gram_at"]]
            most = max(most, max(map(grams.count, grams)))
    assert most < 64  # all 300 segments of an edge had one K-gram
    got = suffix.deduplicated(docs, bucket_bytes=2000, hot=32).collect()
    assert sorted(map(tuple, got), key=str) == brute_suffix(rows)


def test_suffix_dedup_window_by_window_equals_brute_force(edge_docs, edge_rows):
    got = suffix.deduplicated(edge_docs, bucket_bytes=2000, hot=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_suffix([(r[0], r[1]) for r in edge_rows])


def test_suffix_dedup_of_runs_and_short_texts(spark):
    rows = [(5, "a" * 300), (6, "a" * 200), (7, "ab" * 100), (3, "b" * 49), (2, "b" * 49), (9, "ab" * 60 + "c" * 60), (9, "c" * 60)]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_suffix(rows)


def test_suffix_dedup_of_long_runs_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 300)
    rng = np.random.default_rng(8)
    own = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    shared = own(700)
    rows = [(4, "a" * 900 + own(30)), (3, "-" * 400), (8, "a" * 500 + "-" * 100), (9, "ab- " * 200), (2, "ab- " * 60 + own(20) + "ab- " * 40)]
    rows += [(11, own(100) + shared + own(400)), (10, own(333) + shared[:500] + own(50)), (12, shared[100:] + "a" * 70 + shared[:90])]
    for hot in (suffix.HOT, 2):
        got = suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=2000, hot=hot).collect()
        assert sorted(map(tuple, got), key=str) == brute_suffix(rows)


def test_a_run_of_one_byte_is_sent_as_one_record():
    import pyarrow as pa

    text = np.full(3_000_000, 97, np.uint8)
    rows = np.zeros(1, suffix.ROW)
    rows["size"] = len(text)
    data = suffix.pack(rows, text)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([data])], ["part", "data"])
    hints = pa.table({"data": [x.as_py() for b in suffix._hints(4, 40)(iter([batch])) for x in b["data"]]})
    sent = suffix._scatter(4, 40, np.zeros(0, np.uint64))((pa.scalar(1),), pa.table({"data": [data]}), hints)
    assert sum(len(suffix.unpack(x.as_py(), suffix.SEGMENT, suffix.TEXT, suffix.BYTE)[0]) for x in sent["data"]) <= 4


def test_suffix_dedup_empty(empty_docs):
    assert suffix.suffix_dedup(empty_docs).count() == 0
    assert suffix.without_duplicates(empty_docs).columns == empty_docs.columns


def test_kept_text_keeps_columns(edge_docs):
    out = suffix.without_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.where("doc_id = 100").count() == 0 and out.where("doc_id = 0").count() == 2
    assert out.where("text IS NULL").count() == 1 and out.where("text = ''").count() == 1  # nothing of them was cut


def test_multikey_quicksort_and_trie_sort_windows():
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 3000)
    text[1000:1400] = text[:400]
    start = np.arange(0, 2900)
    order, equal = suffix.sorted_windows(text, start, np.zeros(len(start), np.int64))
    windows = [text[s : s + suffix.LENGTH].tobytes() for s in start[order]]
    assert windows == sorted(windows)
    assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == (np.diff(equal) == 0).tolist()


def test_simhash_groups_equal_brute_force(edge_docs, edge_rows):
    got = simhash.near_groups(edge_docs).collect()
    assert len(got) == len(edge_rows)
    fp = [r["fp"] & (1 << 64) - 1 for r in got]
    ids = [r["id"] for r in got]
    assert [r["component_id"] for r in got] == brute_groups(fp, ids)
    assert {r["fp"] for r in got if r["id"] in (200, 201, 202)} == {0}


def test_simhash_links_chains_and_large_groups(spark):
    base = 0x123456789ABCDEF0
    near = {base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)} | {base ^ 0b111 << 40, base ^ 0b111111 << 40, base ^ (1 << 63) ^ 0b11111111}
    values = np.array(sorted(near), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    from scorelake.llm.common import connected_components

    found = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df, 4)).collect()}
    groups = brute_groups(values, [int(x) for x in values.view(np.int64)])
    assert [found.get(int(x), int(x)) for x in values.view(np.int64)] == groups


@pytest.mark.parametrize("hot", [1, 3])
def test_simhash_splits_hot_segments(spark, hot):
    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 32, 3, np.uint64)
    values = np.array([int(low[i % 3]) | int(x) << 32 for i, x in enumerate(rng.integers(0, 1 << 32, 120, np.uint64))], np.uint64)
    flips = np.array([1 << int(a) | 1 << int(b) | 1 << int(c) for a, b, c in rng.integers(0, 64, (200, 3))], np.uint64)
    values = np.unique(np.r_[values, rng.choice(values, 200) ^ flips])
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(values.view(np.int64))], "id long, fp long").repartition(4)
    from scorelake.llm.common import stored

    named = simhash.group_names(stored(rows, "rows"), hot).collect()
    least = {}
    for r in named:
        least[r["component"]] = min(r["rep"], least.get(r["component"], 1 << 40))
    got = {r["rep"]: least[r["component"]] for r in named}
    assert [got[i] for i in range(len(values))] == brute_groups(values, list(range(len(values))))


def test_components_with_hot_nodes(spark):
    from scorelake.llm.common import connected_components

    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(1040, 299)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), plain=10).collect()}
    assert set(found.values()) == {0} and len(found) == 341


def test_one_row_of_each_group_stays(spark, edge_docs, edge_rows):
    kept = [tuple(r) for r in simhash.keep_one(edge_docs).collect()]
    fp = [simhash.fingerprint((r[1] or "").encode()) for r in edge_rows]
    groups = brute_groups(np.array(fp, np.uint64), list(range(len(fp))))  # by row, so that ids don't matter
    members = {}
    for row, g in zip(edge_rows, groups, strict=True):
        members.setdefault(g, []).append(row)
    assert len(kept) == len(members)
    for rows in members.values():
        mine = [k for k in kept if k in rows]
        ids = [r[0] for r in rows if r[0] is not None]
        assert len(mine) == 1 and mine[0][0] == min(ids, default=None)
    two = spark.createDataFrame([(1, "one text that stands here alone"), (1, "a second text under the same id"), (0, "a second text under the same id"), (0, "a second text under the same id")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(two).collect())) == [(0, "a second text under the same id"), (1, "one text that stands here alone")]


def test_one_row_stays_of_many_equal_ones(spark):
    """Copies of over a thousandth of the rows meet their choice by broadcast, fewer are dealt by key: one row of each stays."""
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    rows = [(i, line()) for i in range(1500)] + [(None, line())] * 400 + [(7000, line())] * 600 + [(8000, line())] * 2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(set(rows), key=str)


def test_simhash_empty(empty_docs):
    assert simhash.keep_one(empty_docs).columns == empty_docs.columns and simhash.keep_one(empty_docs).count() == 0
    assert simhash.simhash_groups(empty_docs).count() == 0


def test_fingerprint_law():
    import xxhash

    words = "the cat sat on the mat".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 2)
    assert simhash.fingerprint(b"The CAT  sat\non the mat ") == want
    assert simhash.fingerprint(b"two words") == xxhash.xxh64_intdigest("two words", 42)
