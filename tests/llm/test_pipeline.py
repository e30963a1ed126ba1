"""The pipeline's stages against plain versions."""

import numpy as np
import pytest

import corpus_pipeline as P
from scorelake.llm import decontam, pieces, quality, simhash
from scorelake.llm.common import stored

from tests.llm.test_dedup import brute_groups, brute_suffix
from tests.llm.test_models import sellers

SF = "/root/testdata/sf0.001"
PASSAGE = "a passage of some length that several of these documents hold word for word and more"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, edge_docs, labels):
    """The edge documents with their labels and a benchmark of two items, one of them planted with edits."""
    folder = tmp_path_factory.mktemp("sf")
    extra = [(300, "before " + PASSAGE + " after it all", "en"), (301, PASSAGE.replace("several", "sevral") + " once more", "en"), (302, "nothing of note in here, none", "en")]
    more = spark.createDataFrame([(i, t, g, "s", len(t), 7, 8, 0.5, 9, 10) for i, t, g in extra], edge_docs.schema)
    edge_docs.union(more).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "an item that no document holds in any form whatever")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == before.columns
            assert 0 < docs.count() <= before.count()
    assert docs.count() > 0 and docs.where("not lossless").count() == 0


def test_each_stage_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, doc = docs.columns.index("text"), docs.columns.index("doc_id")
    whole = rows_of(docs)

    judged = {(r["doc_id"], round(r["p_good"], 9)) for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r["p_good"] >= quality.KEEP}
    good = rows_of(P.quality_classifier(spark, docs, sf_dir))
    assert set(good) <= set(whole) and {r[doc] for r in good} == {i for i, _ in judged}

    fp = np.array([simhash.fingerprint((r[text] or "").encode()) for r in whole], np.uint64)
    members = {}
    for row, g in zip(whole, brute_groups(fp, list(range(len(whole)))), strict=True):
        members.setdefault(g, []).append(row)
    want = [min(m, key=lambda r: (r[doc] is None, r[doc] or 0)) for m in members.values()]
    near = rows_of(P.near_duplicates(spark, docs, sf_dir))
    assert [r[doc] for r in near] == [r[doc] for r in sorted(want, key=str)] and set(near) <= set(whole)

    removed = {(r[0], r[1]): r[2] for r in brute_suffix([(r[doc], r[text]) for r in whole])}
    cut = rows_of(P.duplicate_passages(spark, docs, sf_dir))
    for row in cut:
        assert row[4] == len(row[text]) if row[text] is not None else row[text] is None
    gone = sorted((r[doc] for r in whole if r[text] and removed[r[doc], len(r[text].encode())] == len(r[text].encode())), key=str)
    assert sorted([r[doc] for r in cut] + gone, key=str) == sorted((r[doc] for r in whole), key=str)
    size = {(r[doc], len((r[text] or "").encode())) for r in cut}
    assert all((i, n - k) in size or n == k or any(ord(c) > 127 for r in whole if r[doc] == i for c in r[text] or "") for (i, n), k in removed.items())

    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda t: t is not None and len(t) < 2000 and any(sellers(x, decontam.normal(t)) <= decontam.budget(len(x)) for x in items)
    assert rows_of(P.benchmark_decontamination(spark, docs, sf_dir)) == [r for r in whole if not leaks(r[text])]
    assert {r[doc] for r in whole if leaks(r[text])} == {300, 301}

    coded = P.sentencepiece_encoding(spark, docs, sf_dir)
    assert coded.where("NOT lossless").count() == 0
    assert sorted(((r["doc_id"], r["text"]) for r in pieces.decoded(coded).collect()), key=str) == sorted(((r[doc], r[text] or "") for r in whole), key=str)


def test_stages_of_empty_tables_and_clashing_columns(spark, sf_dir, empty_docs, edge_docs):
    clash = edge_docs.withColumnsRenamed({"shard": "record", "slot": "fp", "part": "ids", "id": "sign"})
    for name, stage in P.STAGES[:4]:
        for docs in (empty_docs, clash):
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
        assert stage(spark, empty_docs, sf_dir).count() == 0
        assert out.count() > 0


def test_run_keeps_its_last_stage_only(spark, sf_dir):
    import glob

    from scorelake.llm.common import shared_dir

    # the folder may hold what earlier sessions left
    stages = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/stage-*"))
    before = stages()
    assert P.run(spark, sf_dir).count() > 0
    made = stages() - before
    assert len(made) == 1 and "stage-sentencepiece" in made.pop()


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
