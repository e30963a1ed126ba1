"""Sharding, WARC archives and tokens: laws and exact round trips."""

import zlib

import numpy as np
import pytest

from scorelake.llm import pieces, sharding, warc


def test_shards_hold_all_rows_evenly(edge_docs, edge_rows):
    got = sharding.shard_documents(edge_docs).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_repeat_and_keep_clashing_columns(edge_docs):
    runs = [sorted((r["shard"], r["slot"], r["record"]["text"] or "", r["record"]["shard"]) for r in sharding.sharded(edge_docs, bucket_bytes=4000).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and {x[3] for x in runs[0]} == {7}


def test_shards_of_hot_repeats(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"text {i}", {"b": 1, "a": 2}) for i in range(50)], "doc_id long, text string, m map<string,int>")
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 20).alias("text"), F.lit(None).cast("map<string,int>").alias("m"))
    docs = rows.union(same).drop("m").repartition(3)
    got = sharding.sharded(docs, bucket_bytes=4000).collect()
    assert len(got) == 3050 and sum(r["record"]["doc_id"] is None for r in got) == 3000
    sizes = np.bincount([r["bucket"] for r in got])
    assert sizes.max() < 150  # the repeats are spread over about 65 buckets
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    key = lambda rs: sorted((r["shard"], r["slot"], r["record"]["text"]) for r in rs)
    assert key(sharding.sharded(docs.repartition(5), bucket_bytes=4000).collect()) == key(got)
    assert sharding.sharded(rows, bucket_bytes=500).count() == 50  # with maps


def test_bucket_bases_are_running_sums(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    counts = [(b, 3 * b % 7) for b in range(23) if b % 5]
    got = {r["bucket"]: r["base"] for r in sharding.bucket_bases(spark.createDataFrame(counts, "bucket int, n long")).collect()}
    assert got == {b: sum(n for c, n in counts if c < b) for b, _ in counts}


def test_fisher_yates_is_a_uniform_permutation():
    counts = np.zeros((4, 4))
    rng = np.random.default_rng(0)
    for _ in range(4000):
        counts[np.arange(4), sharding.fisher_yates(4, rng)] += 1
    assert np.abs(counts - 1000).max() < 120


def test_empty_tables(empty_docs, spark):
    assert sharding.shard_documents(empty_docs).count() == 0
    assert pieces.encoded(empty_docs).count() == 0
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip(spark):
    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "ü" * 5000, 6: "<p>a</p>"}
    rows = [(k, None if k == 5 else f"http://x/\r\n{k}", v, 1) for k, v in html.items()] + [(6, "http://again", "<p>a</p>", 1), (None, "u", "only", 1)]
    got = {(r["page_id"], r["record_type"]): r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, records int")).collect()}
    assert got[1, "revisit"]["refers_to"] == got[2, "revisit"]["refers_to"] == 6
    assert got[6, "response"]["refers_to"] is None and got[3, "revisit"]["refers_to"] == 4
    for (page, _), r in got.items():
        data = ("only" if page is None else html[page] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.sha1_base32(data))


def test_warc_one_response_for_each_payload(spark):
    rows = [(6, f"http://{i}", "<p>a</p>") for i in range(9)] + [(6, "http://1", "<p>a</p>")] * 4 + [(2, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (6, "u", "other"), (None, "u", "null ids")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.warc_round_trip(df).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["payload_bytes"] == 8 and r["payload_digest"] == warc.sha1_base32(b"<p>a</p>")]
    assert [r["page_id"] for r in same if r["record_type"] == "response"] == [6] and all(r["refers_to"] == 6 for r in same if r["record_type"] == "revisit")
    assert sum(r["record_type"] == "response" for r in got if r["payload_bytes"] == 5) == 1
    assert all(r["record_type"] == "response" for r in got if r["payload_digest"] == warc.sha1_base32(b"null ids"))


def test_warc_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{'word ' * (i % 50)}{i}</html>") for i in range(200)]
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder) == 200
    got = {r["page_id"]: r["payload"].decode() for r in warc.read_archives(spark, folder).collect()}
    assert got == {i: h for i, _, h in rows}


def test_warc_dictionary_and_frames():
    records = [warc.record(i, "u", b"<p>some common text %d</p>" % i, warc.sha1_base32(b"<p>some common text %d</p>" % i), None, False) for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(data[4:8], "little") > 0
    assert list(warc.frames(data)) == records
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))


def test_warc_reads_frames_without_a_size_and_goes_on_after_damage(spark, tmp_path):
    import zstandard

    rows = [(i, b"<p>page %d</p>" % i) for i in range(10)]
    records = [warc.record(i, "u", body, warc.sha1_base32(body), None, False) for i, body in rows]
    packer = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True)
    packed = [packer.compress(r) for r in records]
    assert list(warc.frames(b"".join(packed))) == records
    for at in (0, 2, 7, len(packed[4]) // 2, len(packed[4]) - 2):
        bad = bytearray(packed[4])
        bad[at] ^= 0x5A
        got = list(warc.scan(b"".join([*packed[:4], bytes(bad), *packed[5:]])))
        assert [w for w, _ in got if w is not None] == records[:4] + records[5:] and sum(e is not None for _, e in got) == 1
    (tmp_path / "a.warc.zst").write_bytes(b"".join([*packed[:4], packed[4][:-6], *packed[5:]]))
    back = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r["page_id"] for r in back if r["error"] is None) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert sum(r["error"] is not None for r in back) == 1
    assert [e for _, e in warc.scan(packer.compress(b"x" * 5000), most=1000)] == ["record of over 1000 bytes"]


def test_warc_rolls_over_and_reads_only_what_the_manifest_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://h/{i}", rng.bytes(1500).hex()) for i in range(700)]
    folder = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert warc.write_archives(pages, folder, archive_bytes=200_000) == 700
    names = sorted((tmp_path / "archives").glob("*.warc.zst"))
    assert len(names) > 2 and names[0].read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    (tmp_path / "archives" / "part-000000-0000-999.warc.zst").write_bytes(names[0].read_bytes())  # of a lost attempt
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(spark, folder).collect()} == {i: h for i, _, h in rows}
    assert warc.read_archives(spark, folder).count() == 700


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r.replace(b"<p>", b"<q>"), lambda r: r.replace(b"WARC-Date", b"WARC-Day"), lambda r: r[:-2]])
def test_warc_broken_records_are_told(change):
    raw = warc.record(1, "u", b"<p>x</p>", warc.sha1_base32(b"<p>x</p>"), None, False)
    assert warc.parsed(raw)["payload"] == b"<p>x</p>"
    with pytest.raises(ValueError):
        warc.parsed(change(raw))


def test_pieces_decode_to_every_text(edge_docs, edge_rows):
    rows = pieces.encoded(edge_docs)
    got = rows.collect()
    assert len(got) == len(edge_rows) and all(r["lossless"] for r in got)
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decoded(rows).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in edge_rows), key=str)


def test_pieces_without_dropout_equal_the_library(edge_rows):
    import pyarrow as pa
    import sentencepiece

    from scorelake.llm.common import text_bytes

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r[1] for r in edge_rows if "▁" not in (r[1] or "")] + ["a" * 600, "tab\tnew\nline  two"]
    raw, ends = text_bytes(pa.array(texts))
    ids, at = pieces.encode(pieces.vocabulary(pieces.MODEL), raw[ends[0] : ends[-1]], ends - ends[0], np.zeros(len(texts), int), rate=0.0)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [model.encode(t or "") for t in texts]


def test_dropout_is_keyed_and_equals_the_heap():
    voc = pieces.vocabulary(pieces.MODEL)
    words = [" internationalisation", " über", " the", " 🙂x"] * 5
    chars = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    keys = np.arange(len(words)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got, word = pieces.segment_words(voc, np.concatenate(chars), np.r_[0, np.cumsum([len(c) for c in chars])], keys, 0.5)
    for k, c in enumerate(chars):
        assert np.array_equal(got[word == k], pieces.segment_word(voc, c, int(keys[k]), 0.5))
    assert len({tuple(got[word == k]) for k in range(0, 20, 4)}) > 1


def test_pieces_of_a_word_vary_with_its_place_and_document():
    voc = pieces.vocabulary(pieces.MODEL)
    text = b" international" * 400
    raw, cuts = np.frombuffer(text * 40, np.uint8), np.arange(41) * len(text)
    ids, at = pieces.encode(voc, raw, cuts, np.arange(40))
    words, now = set(), []
    for i in ids[at[0] : at[1]].tolist():
        if voc.bytes_of[i].startswith(b" ") and now:
            words.add(tuple(now))
            now = []
        now.append(i)
    assert len(words) > 8  # one document and 400 occurrences: it had one segmentation for each key of 8
    assert len({ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)}) == 40
    # the law: each occurrence is segmented as by an agenda of its own
    starts = np.arange(400) * len(b" international")
    keys = pieces.mixed(pieces.mixed(np.uint64([pieces.SEED + 3])) + np.r_[0, starts[1:] + 1].astype(np.uint64))
    chars = [np.frombuffer(("  international" if k == 0 else " international").encode("utf-32-le"), np.uint32) for k in range(400)]
    want = np.concatenate([pieces.segment_word(voc, c, int(k), pieces.RATE) for c, k in zip(chars, keys, strict=True)])
    assert np.array_equal(ids[at[3] : at[4]], want)
