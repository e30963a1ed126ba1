"""Language, quality, toxicity, quality rules and decontamination."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from scorelake.llm import decontam, langid, quality, rules, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_language_held_out_accuracy(real):
    rows = langid.identify(real["documents"]).join(real["documents"].select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_scores_equal_plain_ridge_regression(spark):
    rng = random.Random(7)
    tongue = {"aa": "kalomire", "bb": "thwxnguz", "cc": "päöüßsch"}
    rows = [(i, "".join(rng.choice(tongue[g] + " ") for _ in range(rng.randint(20, 60))), g) for i in range(60) for g in [rng.choice(list(tongue))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=30, landmarks=9)
    chosen = langid.training_ids(docs, 30, langid.SEED)
    assert len({c[1] for c in chosen}) == len(chosen) <= 30 and all(zlib.crc32(str(c[1]).encode()) % 5 for c in chosen)
    text = {i: t for i, t, _ in rows}
    grams = lambda t: {t.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    marks = [grams(text[c[1]]) for c in chosen[:9]]
    k = lambda t: np.array([len(grams(t) & m) / math.sqrt(len(grams(t)) * len(m)) for m in marks])
    between = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(between)
    x = np.c_[np.array([k(text[c[1]]) for c in chosen]) @ vector / np.sqrt(value), np.ones(len(chosen))]
    y = np.array([[1.0 if c[2] == g else -1.0 for g in model.langs] for c in chosen])
    pull = langid.RIDGE * len(x) * np.eye(x.shape[1])
    pull[-1, -1] = 1e-9
    beta = np.linalg.solve(x.T @ x + pull, x.T @ y)
    raw = [t.encode() for t in text.values()]
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    want = np.array([np.r_[k(t) @ vector / np.sqrt(value), 1] @ beta for t in text.values()])
    assert np.abs(got - want).max() < 2e-3
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, sample=30, landmarks=9).collect()}
    assert out == {i: model.langs[int(np.argmax(w))] for i, w in zip(text, want, strict=True)}


def test_language_sample_of_a_hot_language_and_repeated_ids(spark):
    rows = [(i, f"text number {i}", "en") for i in range(1, 400)] + [(500 + i, f"texte {i}", "fr") for i in range(9)] + [(7, "other text", "en")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = langid.training_ids(docs, 40, 1)
    per = collections.Counter(c[2] for c in chosen)
    assert per["en"] == 20 and 4 <= per["fr"] <= 9 and len({c[1] for c in chosen}) == len(chosen)
    assert langid.training_ids(docs.repartition(7), 40, 1) == chosen
    assert langid.training_texts(docs, chosen).count() == len(chosen)


def test_language_edges(edge_docs, edge_rows, empty_docs):
    got = langid.identify(edge_docs, sample=40, landmarks=10).collect()
    assert len(got) == len(edge_rows)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (200, 201, 202))
    assert langid.identify(empty_docs).count() == 0


def test_language_kernel_by_hand():
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks, text = [b"the cat", b"der hund"], b"The mat, quite another"
    sets = [np.unique(langid.codes(np.frombuffer(m, np.uint8), np.array([0, len(m)]))[0]) for m in marks]
    row = langid.Kernel(sets).rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    own = grams(text.lower())
    want = [len(own & grams(m)) / math.sqrt(len(own) * len(grams(m))) for m in marks]
    assert np.allclose(row, want, atol=1e-6)


def test_quality_separates_labels(real):
    rows = quality.quality_scores(real["documents"], real["labels"]).join(real["labels"], "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95
    assert all(0 <= r["p_good"] <= 1 and r["p_good"] <= r["expected_grade"] <= 2 for r in rows)


def test_quality_held_out(real):
    rows = quality.quality_scores(real["documents"], real["labels"]).join(real["labels"], "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 40
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.9


def test_quality_scores_equal_a_plain_sum_over_words(edge_docs, edge_rows, labels):
    from scorelake.llm.common import Pieces

    weight, theta = quality.fit(edge_docs, labels)
    hashed = lambda w: int(Pieces(np.frombuffer(w, np.uint8)).hash(np.array([0]), np.array([len(w)]))[0]) & (1 << quality.BITS) - 1

    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        kinds = lambda w: [quality._CLASS[c] for c in w]
        shape = lambda w: bytes(x for i, x in enumerate(kinds(w)) if i == 0 or kinds(w)[i - 1] != x)
        low = [w.lower() for w in words]
        s = sum(weight[hashed(v)] + weight[hashed(shape(w)) + (1 << quality.BITS)] for v, w in zip(low, words, strict=True))
        s += weight[quality.REPEAT] * sum(a == b for a, b in zip(low, low[1:], strict=False))
        return s * quality.SCALE / max(1, len(words)) + weight[quality.LENGTHS + min(23, int(math.log2(len(words) + 1)))]

    want = sorted((str(r[0]), round(1 / (1 + math.exp(theta[0] - plain(r[1]))), 6)) for r in edge_rows)
    got = sorted((str(r["doc_id"]), round(r["p_good"], 6)) for r in quality.quality_scores(edge_docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)


def test_quality_edges(edge_docs, edge_rows, labels, empty_docs):
    assert quality.quality_scores(edge_docs, labels).count() == len(edge_rows)
    assert quality.quality_scores(empty_docs, labels).count() == 0
    assert quality.quality_scores(edge_docs, labels.limit(0)).where("keep").count() == len(edge_rows)
    assert quality.select_good(edge_docs, labels).columns == edge_docs.columns


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grade = np.searchsorted([-0.5, 1.0], 2 * x + rng.logistic(size=3000) * 0.3)
    weight, theta = quality.fit_ordinal(grade, np.arange(3000), np.zeros(3000, int), x, 1, 3, rounds=800, decay=0.0)
    assert weight[0] > 0 and theta[0] < theta[1] and np.mean(np.searchsorted(theta, weight[0] * x) == grade) > 0.85


def test_toxicity_held_out(real):
    rows = toxicity.toxicity_scores(real["documents"], real["labels"]).join(real["labels"], "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    held = lambda toxic: [r["predicted"] == toxic for r in rows if r["held_out"] and r["toxic"] == toxic]
    assert (np.mean(held(0)) + np.mean(held(1))) / 2 > 0.75
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_subsequence_kernel_by_hand():
    def features(word):
        out = collections.Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN + 1)):
                    if j - i < toxicity.SPAN and k - j < toxicity.SPAN:
                        out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    dot = lambda a, b: sum(a[u] * b[u] for u in a)
    marks = toxicity.Landmarks(["idiot", "stupid"], 2)
    long = "xyz" * 30000 + "idiot"
    text = b"id.iot i d i o t stupixd " + long.encode()
    start = np.array([0, 7, 17, 25])
    rows = marks.rows(np.frombuffer(text, np.uint8), start, np.array([6, 16, 24, len(text)]))
    for word, row in zip(["idiot", "idiot", "stupixd"], rows, strict=False):
        want = [dot(features(word), features(m)) / math.sqrt(dot(features(word), features(word)) * dot(features(m), features(m))) for m in marks.words]
        assert np.allclose(row, want, atol=1e-5)
    alone = marks.rows(np.frombuffer(text, np.uint8), start[3:], np.array([len(text)]))
    assert np.allclose(rows[3], alone[0], atol=1e-4) and 0 < rows[3][0] < 0.1


def test_toxicity_tolerates_inserted_characters(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "th", "er", "ou", "st", "ble", "ing", "re"]) for _ in range(rng.randint(2, 4)))
    insults = ["idiot", "worthless", "pathetic", "einfaltspinselhafterdummkopfkerl"]
    prose = lambda n, *more: " ".join(rng.sample([*(word() for _ in range(n)), *more], n + len(more))) + "."
    rows = [(i, prose(30) if i % 4 else prose(30, insults[i // 4 % 4], insults[i // 4 % 3])) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    forms = lambda w: [w, w[:3] + "q" + w[3:], ".".join(w), " ".join(w), w.upper(), w.replace("i", "1")]
    probes = [(1000 + 10 * k + j, prose(30, f)) for k, w in enumerate(insults) for j, f in enumerate(forms(w))] + [(2000 + i, prose(30)) for i in range(50)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(spark.createDataFrame(rows + probes, "doc_id long, text string"), labels).collect()}
    assert all(got[i] for i, _ in probes if i < 2000), [t for i, t in probes if i < 2000 and not got[i]]
    assert sum(got[2000 + i] for i in range(50)) <= 5  # words of the insults' own syllables


def test_gap_kernel_by_hand():
    from itertools import combinations

    count = lambda w: collections.Counter("".join(c) for c in combinations(w, toxicity.ORDER))
    dot = lambda a, b: sum(a[u] * b[u] for u in a)
    marks = toxicity.Landmarks(["idiot", "stupid", "scum"], 3)
    words = ["idiot", "ixdyizoqt", "toidi", "distribution", "sqcwuem", "x" * 30 + "idiot", "id"]
    rows = marks.gap_rows(*toxicity.places(words))
    for word, row in zip(words, rows, strict=True):
        for mark, got in zip(marks.words, row, strict=True):
            fits = set(mark) <= set(word) and len(mark) <= len(word) <= toxicity.LONG
            want = dot(count(word), count(mark)) / math.sqrt(dot(count(word), count(word)) * dot(count(mark), count(mark))) if fits else 0.0
            assert abs(got - want) < 1e-5, (word, mark)
    assert np.allclose(np.diag(marks.gap_gram()), 1)


@pytest.mark.parametrize(("form", "least"), [("plain", 1.0), ("one", 0.95), ("two", 0.9), ("three", 0.8), ("gaps", 0.7), ("dropped", 0.75)])
def test_toxicity_of_spoilt_insults(spoilt_scores, form, least):
    assert spoilt_scores[form] >= least and spoilt_scores["clean"] <= 0.06


@pytest.fixture(scope="module")
def spoilt_scores(spark):
    """Shares of spoilt insults that are found in clean texts, and of the clean texts that are; trained at sf0.1."""
    rng, folder = random.Random(3), "/root/testdata/sf0.1"
    insults = ["idiot", "stupid", "trash", "worthless", "disgusting", "pathetic", "loser", "clown", "moron", "scum"]
    letter = lambda: chr(97 + rng.randrange(26))

    def more(word, k):
        at = set(rng.sample(range(1, len(word)), min(k, len(word) - 1)))
        return "".join((letter() if i in at else "") + c for i, c in enumerate(word))

    def less(word):
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + word[at + 1 :]

    make = {"plain": lambda w: w, "one": lambda w: more(w, 1), "two": lambda w: more(w, 2), "three": lambda w: more(w, 3), "gaps": lambda w: more(w, len(w)), "dropped": less}
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    clean = [r["text"] for r in docs.join(labels, "doc_id").where("toxic = 0 AND quality = 1 AND lang = 'en' AND crc32(CAST(doc_id AS STRING)) % 4 = 2").orderBy("doc_id").limit(60).collect()]
    probes, kind = [], {}
    for name, form in make.items():
        for k in range(60):
            words = clean[k].split(" ")
            words.insert(rng.randrange(len(words) + 1), form(insults[k % 10]))
            probes.append((10**9 + len(probes), " ".join(words)))
            kind[probes[-1][0]] = name
    for text in clean:
        probes.append((10**9 + len(probes), text))
        kind[probes[-1][0]] = "clean"
    model = toxicity.fit(docs, labels)
    frame = spark.createDataFrame(probes, "doc_id long, text string").selectExpr("doc_id", "false AS held_out", "text")
    got = collections.defaultdict(list)
    for r in frame.mapInArrow(toxicity._scoring(model), "doc_id long, held_out boolean, score double, predicted int").collect():
        got[kind[r["doc_id"]]].append(r["predicted"])
    return {k: np.mean(v) for k, v in got.items()}


def test_toxicity_edges(edge_docs, edge_rows, labels, empty_docs):
    assert toxicity.toxicity_scores(edge_docs, labels).count() == len(edge_rows)
    assert toxicity.toxicity_scores(empty_docs, labels).count() == 0
    assert toxicity.toxicity_scores(edge_docs, labels.limit(0)).where("score = 0").count() == len(edge_rows)


def brute_signals(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_signals_equal_brute_force(spark, edge_docs, edge_rows, labels):
    extra = [(500, "a b c d e f a b c d e\na b c d e\n\n \nx\nx\n##$ |"), (501, "k " * 30), (502, " lead nbsp x")]
    docs = edge_docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(*x, None) for x in extra], "doc_id long, text string, lang string"))
    got = sorted((tuple(r)[:6] for r in rules.judged(docs, labels).collect()), key=str)
    assert got == sorted(((i, *brute_signals(t)) for i, t in [*((r[0], r[1]) for r in edge_rows), *extra]), key=str)


def test_binomial_tail_is_exact(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, k) for n in (10, 100, 900) for k in (0, 1, 3, 7)], "n long, k long")
    for r in rows.select("n", "k", rules.log_binomial_tail(F.col("n"), F.col("k"), 0.0125).alias("t")).collect():
        want = math.log(math.fsum(math.comb(r["n"], i) * 0.0125**i * 0.9875 ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert abs(r["t"] - want) < 1e-9


def test_rules_reject_only_what_is_safe(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30))
    rows = [(i, prose() if i % 5 else " ".join(f"w{rng.randint(0, 999)}###" for _ in range(30)), "en") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 3000)], "doc_id long, quality int, toxic int")
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in got)


def test_rules_steps_equal_brute_force(spark):
    rng = random.Random(9)
    kinds = {"en": (400, 0.02), "de": (120, 0.0), "fr": (60, 0.0), "es": (90, 0.5)}
    rated = []
    for lang, (n, noise) in kinds.items():
        for i in range(2 * n):
            bad = i >= n
            ratio = lambda top: rng.random() * top if bad or rng.random() < noise else 0.0
            rated.append((lang, False, int(not bad), ratio(1.0), ratio(1.0), ratio(0.2), 5 + ratio(18.0)))
    schema = "doc_id long, text_hash string, stratum string, base_failed boolean, quality int, symbol_ratio double, dup_line_ratio double, repeat_ratio double, word_length double"
    df = spark.createDataFrame([(i, f"t{i}", *r) for i, r in enumerate(rated)], schema)
    got = {r["stratum"]: r["step"] for r in rules.safe_steps(df).collect()}
    names, steps, want = list(rules.GRID), rules.staircase(), {}
    assert len(steps) == 23 and all(sum(a[n] > b[n] for n in names) == 1 and all(a[n] >= b[n] for n in names) for a, b in zip(steps, steps[1:], strict=False))
    for lang in kinds:
        mine = [r for r in rated if r[0] == lang]
        n, best = sum(r[2] for r in mine), None
        for i, step in enumerate(steps):
            out = lambda r: any(v > step[name] for name, v in zip(names, r[3:], strict=True))  # noqa: E731, B023
            k, hits = sum(out(r) for r in mine if r[2]), sum(out(r) for r in mine if not r[2])
            if math.fsum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1)) > 0.05 / 4:
                break
            if hits and (best is None or hits > best[0]):
                best = hits, i
        if best:
            want[lang] = best[1]
    assert got == want and set(want) == {"en", "de"}


def test_repeats_are_one_trial(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30))
    junk = lambda: " ".join(f"w{rng.randint(0, 999)}###" for _ in range(30))
    one, bad = prose(), junk()
    rows = [(1, one)] * 200 + [(1000 + i, one) for i in range(200)] + [(2, bad)] * 50 + [(5000 + i, junk()) for i in range(5)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i == 1 or 1000 <= i < 5000)) for i in {r[0] for r in rows}], "doc_id long, quality int")
    assert all(r["kept"] for r in rules.judged(docs, marks).collect())
    many = [(i, prose()) for i in range(200)] + [(5000 + i, junk()) for i in range(5)] + [(5000, junk())] * 3
    docs = spark.createDataFrame([(*r, "en") for r in many], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 5000)) for i in {r[0] for r in many}], "doc_id long, quality int")
    assert all(r["kept"] == (r["doc_id"] < 5000) for r in rules.judged(docs, marks).collect())


def test_rules_empty(empty_docs, labels):
    assert rules.judged(empty_docs, labels).count() == 0


def sellers(item, text):
    col, best = list(range(len(item) + 1)), len(item)
    for c in text:
        above, col[0] = col[0], 0
        for i in range(1, len(item) + 1):
            above, col[i] = col[i], min(col[i] + 1, col[i - 1] + 1, above + (item[i - 1] != c))
        best = min(best, col[-1])
    return best


def test_decontamination_finds_all_within_budget():
    rng, hits = random.Random(1), 0
    for _ in range(150):
        item = "".join(rng.choice("abcd e") for _ in range(rng.randint(24, 60)))
        errors, text = decontam.budget(len(item)), list(item)
        for _ in range(rng.randint(0, errors + 2)):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], [text[i], "d"], ["b"]])
        text = "".join(rng.choice("abcd") for _ in range(30)) + "".join(text) + "".join(rng.choice("abcd") for _ in range(30))
        got = list(decontam.Matcher([(5, item)], 0.1).found(text))
        want = sellers(item, text)
        assert [g[1] for g in got] == ([want] if want <= errors else [])
        hits += len(got)
        for _, distance, a, b in got:
            assert sellers(item, text[a:b]) == distance
    assert hits > 50


def test_decontamination_finds_planted_items(real, spark, edge_docs, empty_docs):
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(real["documents"], real["benchmark"]).collect()}
    texts = {r["doc_id"]: decontam.normal(r["text"]) for r in real["documents"].collect()}
    exact = {(d, r["item_id"]) for r in real["benchmark"].collect() for d, t in texts.items() if decontam.normal(r["text"]) in t}
    assert exact and exact <= got
    split = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(real["documents"], real["benchmark"], block_bytes=2000).collect()}
    assert split == got
    assert decontam.leaks(edge_docs, real["benchmark"]).count() == decontam.leaks(empty_docs, real["benchmark"]).count() == 0
    items = spark.createDataFrame([(1, None), (2, " "), (3, "short")], "item_id long, text string")
    assert decontam.decontaminate(edge_docs, items).count() == edge_docs.count()
    assert decontam.decontaminate(empty_docs, items).columns == empty_docs.columns


def test_decontamination_of_short_items(spark):
    items = spark.createDataFrame([(1, "Tin soldier"), (2, "tin"), (3, "cat 9")], "item_id long, text string")
    docs = [(1, "one tin  SOLDIER stood"), (2, "a tin"), (3, "satin, tiny, martini"), (None, "(tin)"), (5, "tin soldxer"), (6, "bobcat 9 cat 99"), (7, "cat 9"), (8, None), (8, "tin soldier"), (8, "clean")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaks(rows, items).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 2, 0), (2, 2, 0), (None, 2, 0), (5, 1, 1), (5, 2, 0), (7, 3, 0), (8, 1, 0), (8, 2, 0)], key=str)
    kept = [tuple(r) for r in decontam.decontaminate(rows, items, block_bytes=5).collect()]
    assert sorted(kept, key=str) == sorted([docs[2], docs[5], docs[7], docs[9]], key=str)


def test_decontamination_goes_over_item_files(real, spark):
    """Repeated items give a row each and are matched once; one stage reads the documents however many blocks there are."""
    items = real["benchmark"].select("item_id", "text")
    doubled = items.union(items).union(items.limit(3))
    once = sorted(map(tuple, decontam.leaks(real["documents"], items).collect()))
    first = {r["item_id"] for r in items.limit(3).collect()}
    again = decontam.leaks(real["documents"], doubled, block_bytes=1500)
    assert sorted(map(tuple, again.collect())) == sorted(r for r in once for _ in range(3 if r[1] in first else 2))
    assert len(decontam.item_files(doubled, 1500)) > 3 and len(decontam.item_files(doubled)) == 1
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    kept = decontam.decontaminate(real["documents"], doubled, block_bytes=1500)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in real["documents"].collect()} - {r[0] for r in once}


def test_decontamination_query_equals_brute_force(real, spark):
    """Every pair of a document and an item within the item's edits, by the plain dynamic programme on a fixture."""
    rng = random.Random(2)
    items = [(k, "".join(rng.choice("abcde fgh") for _ in range(rng.choice([26, 40, 55])))) for k in range(6)]
    docs = []
    for i in range(40):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 7)):
            j = rng.randrange(len(text))
            text[j : j + 1] = rng.choice([[], [text[j], "h"], ["a"]])
        docs.append((i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + "".join(text) + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            item = decontam.normal(item)
            d = sellers(item, decontam.normal(t))
            if d <= decontam.budget(len(item)):
                want[i, k] = d
    assert got == want and len(want) > 15
