"""Dataset import: profiling, contracts, validation, versions, sampling. Rows are (idx, input) with input as JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.sources.storage import stored

# Column names that hold the expected answer, in order of preference.
EXPECTED_NAMES = ["expected", "answer", "label", "output", "target", "ground_truth"]


def is_blank(x: Column) -> Column:
    return x.isNull() | ~x.cast("string").rlike(r"(?U)\S")


def column_order(rows: DataFrame) -> DataFrame:
    """(name, position) of all keys in the order in which rows first show them."""
    keys = rows.select("idx", F.posexplode(F.json_object_keys("input")).alias("at", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("idx", "at")).alias("f"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("f.idx", "f.at")) - 1).select("name", "position")


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_rows, n_blank) of each column, in one pass."""
    value = lambda c: F.get_json_object("input", f"$.{c}")
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(is_blank(value(c))).alias(f"b{i}") for i, c in enumerate(columns)])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"b{i}").alias("n_blank")) for i, c in enumerate(columns)])).alias("c")).select("c.name", F.col("n").alias("n_rows"), "c.n_blank")


def infer_contract(columns: list[str], given: dict | None = None) -> dict:
    """Roles of the columns: given ones, else the first expected name (its own case before others) and the rest input."""
    given = given or {}
    expected = given.get("expected")
    if expected is None:
        low = {c.lower(): c for c in reversed(columns)}
        expected = next(([c] for name in EXPECTED_NAMES for c in [name if name in columns else low.get(name)] if c), [])
    metadata, sensitive = given.get("metadata", []), given.get("sensitive", [])
    inputs = given.get("input") or [c for c in columns if c not in {*expected, *metadata}]
    roles = [*inputs, *expected, *metadata]
    if len(set(roles)) != len(roles):
        raise ValueError("roles overlap")
    if unknown := set(roles) - set(columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return {"input": inputs, "expected": expected, "metadata": metadata, "sensitive": sensitive, "required": given.get("required", []), "types": given.get("types", {})}


def missing_required(rows: DataFrame, required: list[str]) -> DataFrame:
    """(idx, field, code) of each required field that is blank, both in the row and in its nested `expected`."""
    blank = lambda c: is_blank(F.get_json_object("input", f"$.{c}")) & is_blank(F.get_json_object("input", f"$.expected.{c}"))
    errors = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))
    return rows.select("idx", F.explode(errors).alias("field"), F.lit("required").alias("code"))


def type_matches(value: Column, kind: str) -> Column:
    """Whether a JSON scalar, as text, is of a declared type; booleans are no numbers, and blanks pass."""
    word = F.lower(F.trim(value))
    if kind == "number":
        ok = value.try_cast("double").isNotNull() & ~word.isin("true", "false", "nan", "infinity", "-infinity")
    elif kind == "integer":
        number = value.try_cast("double")
        ok = number.isNotNull() & (number == F.floor(number))
    elif kind == "boolean":
        ok = word.isin("true", "false", "0", "1", "yes", "no")
    elif kind in ("array", "object", "json"):
        start = {"array": r"^\s*\[", "object": r"^\s*\{", "json": r"^\s*[\[{]"}[kind]
        ok = value.rlike(start)
    else:
        ok = F.lit(True)
    return is_blank(value) | F.coalesce(ok, F.lit(False))


def type_errors(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    errors = F.array_compact(F.array(*[F.when(~type_matches(F.get_json_object("input", f"$.{c}"), k), F.lit(c)) for c, k in types.items()]))
    return rows.select("idx", F.explode(errors).alias("field"), F.lit("type").alias("code"))


def chat_errors(chats: DataFrame) -> DataFrame:
    """(idx, field, code) where `messages` is no list of {role, content} with a known role and a text, or `examples` no
    list of texts and objects."""
    given, shots = F.get_json_object("input", "$.messages"), F.get_json_object("input", "$.examples")
    messages = F.from_json(given, "array<struct<role:string,content:string>>")
    bad = messages.isNull() | F.exists(messages, lambda m: m.isNull() | ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) | m["content"].isNull())
    kinds = F.from_json(shots, "array<variant>")
    odd = kinds.isNull() | F.exists(kinds, lambda x: ~F.coalesce(F.schema_of_variant(x).rlike("^(STRING|OBJECT)"), F.lit(False)))
    found = F.array_compact(F.array(F.when(given.isNotNull() & bad, "messages"), F.when(shots.isNotNull() & odd, "examples")))
    return chats.select("idx", F.explode(found).alias("field"), F.lit("chat").alias("code"))


def import_errors(rows: DataFrame, contract: dict, limit: int = 100) -> DataFrame:
    """All errors, required fields before types before chats, then by row and field; the first `limit`."""
    found = missing_required(rows, contract["required"]).withColumn("turn", F.lit(0)).unionByName(type_errors(rows, contract["types"]).withColumn("turn", F.lit(1))).unionByName(chat_errors(rows).withColumn("turn", F.lit(2)))
    return found.orderBy("turn", "idx", "field").limit(limit)


def split_roles(rows: DataFrame, contract: dict | None = None) -> DataFrame:
    """(idx, input, expected) as JSON objects. By a contract: its input and metadata columns, and its expected ones. Without
    one: an object under `expected` is taken out whole; else the first known answer key is; else nothing is expected."""
    value = lambda c: F.get_json_object("input", f"$.{c}")
    if contract is not None:
        part = lambda names: F.to_json(F.struct(*[value(c).alias(c) for c in names])) if names else F.lit(None).cast("string")
        return rows.select("idx", part([*contract["input"], *contract["metadata"]]).alias("input"), part(contract["expected"]).alias("expected"))
    keys = F.json_object_keys("input")
    whole = F.from_json("input", "map<string,string>")
    explicit = F.coalesce(value("expected").startswith("{"), F.lit(False))
    known = F.coalesce(*[F.when(F.array_contains(keys, k), F.lit(k)) for k in EXPECTED_NAMES])
    taken = F.when(explicit, F.lit("expected")).otherwise(known)
    rest = F.to_json(F.map_filter(whole, lambda k, v: ~k.eqNullSafe(taken)))
    own = F.to_json(F.create_map(F.coalesce(known, F.lit("")), F.element_at(whole, F.coalesce(known, F.lit("")))))
    expected = F.coalesce(F.when(explicit, value("expected")), F.when(known.isNotNull(), own))
    return rows.select("idx", rest.alias("input"), expected.alias("expected"))


def empty_rows(rows: DataFrame, required: list[str]) -> DataFrame:
    """(n_rows, n_empty, n_missing): rows, those with all their fields blank, and those with a blank required field."""
    values = F.map_values(F.from_json("input", "map<string,string>"))
    missing = F.exists(F.array(*[F.get_json_object("input", f"$.{c}") for c in required]), is_blank) if required else F.lit(False)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.forall(F.coalesce(values, F.array().cast("array<string>")), is_blank)).alias("n_empty"), F.count_if(missing).alias("n_missing"))


# Names of columns that may hold personal data, and of columns that may hold the answer.
SENSITIVE_NAME = "(?i)(手机|电话|phone|mobile|邮箱|email|身份证|idcard|id_card|订单|order|地址|address|姓名|name|银行卡|bank)"
ANSWER_NAME = "(?i)(答案|回复|结论|result|output|target|label|标签|类别|ground|expected)"
# Parts of an answer column's name that tell the task, and the mean length from which it is free text.
TASK_WORDS = {"classification": ["label", "标签", "类别", "分类"], "coding": ["prompt", "代码", "code"]}
LONG_ANSWER = 40


def suggested_contract(rows: DataFrame, columns: list[str], head: int = 100) -> dict:
    """Guesses from the names and from the first rows: answer and sensitive columns, chat rows, task type, several answers.
    Only one row of sums comes to the driver."""
    low = {c.lower(): c for c in columns}
    answers = list(dict.fromkeys([*(low[k] for k in EXPECTED_NAMES if k in low), *(c for c in columns if re.search(ANSWER_NAME, c))]))
    value = lambda c: F.get_json_object("input", f"$.{c}")
    listed = lambda c: F.coalesce(value(c).startswith("["), F.lit(False))
    first = rows.orderBy("idx").limit(head)
    length = F.avg(F.when(F.coalesce(value(answers[0]), F.lit("")) != "", F.length(value(answers[0])))) if answers else F.lit(None)
    said = first.agg(F.count_if(listed("messages")).alias("chats"), length.alias("length"), *[F.count_if(listed(c)).alias(f"many{i}") for i, c in enumerate(answers)]).first()
    task = "qa"
    if answers:
        named = next((t for t, words in TASK_WORDS.items() if any(w in answers[0].lower() for w in words)), None)
        task = named or ("generation" if (said["length"] or 0) > LONG_ANSWER else "qa")
    return {"answer_candidates": answers, "sensitive_candidates": [c for c in columns if re.search(SENSITIVE_NAME, c)], "structured_chat": said["chats"] > 0, "task_type": task, "multi_answer": any(said[f"many{i}"] for i in range(len(answers)))}


def with_dense_index(rows: DataFrame, *order: str) -> DataFrame:
    """0-based idx in the given order without one task for all: ranges are sorted and stored once with a number in each,
    and their counts give where each range begins. Equal rows are numbered as they were stored."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    # the high bits of the number are the range, the low ones the place in it
    ranged = ranged.withColumn("_part", F.shiftright("_place", 33)).withColumn("_n", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))  # a row per range
    return ranged.join(F.broadcast(starts), "_part").withColumn("idx", F.col("_start") + F.col("_n")).drop("_part", "_n", "_start")


def appended_version(rows: DataFrame, dataset: str, new: DataFrame) -> DataFrame:
    """A version of old rows with their idx and new rows that continue it. new: with a dense idx of its own."""
    sizes = rows.groupBy(dataset).agg((F.max("idx") + 1).alias("_base"))
    moved = new.join(sizes, dataset, "left").withColumn("idx", F.col("idx") + F.coalesce("_base", F.lit(0))).drop("_base")
    return rows.unionByName(moved)


def replaced_version(rows: DataFrame, dataset: str, new: DataFrame) -> DataFrame:
    """A version in which the datasets that new has are its rows alone, and all others keep theirs."""
    return rows.join(new.select(dataset).distinct(), dataset, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash): SHA-256 of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"))


def new_imports(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """wanted (project_id, idempotency_key, content_hash) without those whose key the project has used, with same_as: the
    first done import of the project with equal content, or null."""
    fresh = wanted.dropDuplicates(["project_id", "idempotency_key"]).join(done, ["project_id", "idempotency_key"], "left_anti")
    same = done.groupBy("project_id", "content_hash").agg(F.min("import_id").alias("same_as"))
    return fresh.join(same, ["project_id", "content_hash"], "left")


def active_version(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen version of each dataset, else the latest."""
    latest = versions.groupBy("dataset_id").agg(F.max("version").alias("latest"))
    return latest.join(chosen, "dataset_id", "left").select("dataset_id", F.coalesce("chosen", "latest").alias("version"))


def row_signals(scored: DataFrame, listed: int = 100) -> DataFrame:
    """(code, n_rows, first_row, rows) of what looks wrong in a dry run; rows: the first `listed` row numbers of a code."""
    clean, raw = F.coalesce("cleaned", F.lit("")), F.coalesce("output", F.lit(""))
    codes = F.array_compact(F.array(
        F.when(is_blank(F.col("expected")), "no_expected"),
        F.when(is_blank(F.col("output")), "empty_output"),
        F.when(clean.rlike("(?i)^(answer|答案)"), "prefix_not_cleaned"),
        F.when(raw.rlike("[,，]") & ~clean.rlike("[,，]"), "comma_truncated"),
        F.when(F.coalesce("error", F.lit("")) != "", "row_error"),
    ))
    found = scored.select("row_idx", F.explode(codes).alias("code"))
    counts = found.groupBy("code").agg(F.count("*").alias("n_rows"), F.min("row_idx").alias("first_row"))
    # the window keeps `listed` rows of a code in each task before the shuffle
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("row_idx"))).where(F.col("place") <= listed)
    return counts.join(first.groupBy("code").agg(F.array_sort(F.collect_list("row_idx")).alias("rows")), "code")


def stratified_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """Up to k rows of each stratum by a seeded hash of the key; the window keeps k rows per stratum before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_stratum).drop("_place")


def deduplicated(rows: DataFrame, text: str, key: str) -> DataFrame:
    """One row per text, blank and case apart: that of the lowest key; rows without text go."""
    norm = F.md5(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))))
    best = rows.where(~is_blank(F.col(text))).groupBy(norm.alias("_norm")).agg(F.min(key).alias("_keep"))
    return rows.join(best.select(F.col("_keep").alias(key)), key, "left_semi")


def dry_run_summary(scored: DataFrame, head: int) -> DataFrame:
    """Mean, full, zero and failed scores of the first rows by idx."""
    first = scored.orderBy("row_idx").limit(head)
    return first.agg(F.count("*").alias("n_rows"), F.avg("score").alias("avg_score"), F.count_if(F.col("score") >= 1.0).alias("n_full"), F.count_if(F.col("score") <= 0.0).alias("n_zero"), F.count_if(F.col("error_kind").isNotNull()).alias("n_error"))


def preview(rows: DataFrame, columns: list[str], offset: int, limit: int, redact) -> DataFrame:
    """A page of rows by idx, values as text, redacted."""
    return rows.orderBy("idx").offset(offset).limit(limit).select("idx", *[redact(F.col(c).cast("string")).alias(c) for c in columns])


def backfilled_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """versions with a version 1 for each dataset that has none."""
    lost = datasets.select("dataset_id").distinct().join(versions, "dataset_id", "left_anti")
    return versions.select("dataset_id", "version").unionByName(lost.withColumn("version", F.lit(1)))


def flat_rows(split: DataFrame) -> DataFrame:
    """(idx, row): input, metadata and expected of a split row as one map again; expected values win."""
    kind = "map<string,string>"
    whole = F.from_json("input", kind)
    inner = F.coalesce(F.from_json(F.get_json_object("input", "$._metadata"), kind), F.create_map().cast(kind))
    expected = F.coalesce(F.from_json("expected", kind), F.create_map().cast(kind))
    plain = F.map_filter(whole, lambda k, v: (k != "_metadata") & ~F.map_contains_key(expected, k) & ~F.map_contains_key(inner, k))
    return split.select("idx", F.map_concat(plain, F.map_filter(inner, lambda k, v: ~F.map_contains_key(expected, k)), expected).alias("row"))


def joined_choices(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Questions that have an answer, as single or multiple choice, with their options as text sorted by letter.

    questions: key, question, options (map letter -> text); answers: key, answer (letters in one text).
    """
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("answer"), F.lit("[A-Z]"), 0)))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")
    out = questions.join(answers, key).withColumn("letters", letters)
    return out.select(key, F.concat("question", F.lit("\n"), shown).alias("question"), F.array_join("letters", "").alias("answer"), F.when(F.size("letters") > 1, "multiple").otherwise("single").alias("kind"))


def version_issues(rows: DataFrame, declared: DataFrame, template_roots: list[str], required: list[str], inputs: list[str] | None = None, expected: list[str] | None = None) -> DataFrame:
    """(dataset_id, code, field, n) of a stored version: row-count drift, prompt variables that no input field maps, and prompt
    variables, required and expected fields that rows lack. rows: dataset_id, idx, input and, with expected fields given,
    expected; declared: dataset_id, row_count. inputs and expected: the fields of the contract; an empty list of expected
    ones asks for any expected answer at all, and `expected` stands for the whole of it."""
    unmapped = [v for v in template_roots if inputs and v not in inputs]
    told = lambda code, field, missing: F.when(missing, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    nothing = lambda value: F.coalesce(value, F.lit("")) == ""
    answers = expected is not None
    inside = lambda c: [F.get_json_object("input", f"$.{c}"), F.get_json_object("input", f"$._metadata.{c}"), *([F.get_json_object("expected", f"$.{c}")] if answers else [])]
    made = [told("missing_variable", v, nothing(F.get_json_object("input", f"$.{v}"))) for v in template_roots if v not in unmapped]
    made += [told("missing_required", c, is_blank(F.coalesce(*inside(c)))) for c in required]
    if answers:
        none = F.coalesce(F.size(F.json_object_keys("expected")), F.lit(0)) <= 0
        made += [told("missing_expected", c, none if c == "expected" else nothing(F.get_json_object("expected", f"$.{c}"))) for c in expected] or [told("no_expected", "", none)]
    found = rows.select("dataset_id", F.explode(F.array_compact(F.array(*made))).alias("e")).groupBy("dataset_id", "e.code", "e.field").agg(F.count("*").alias("n"))
    counts = rows.groupBy("dataset_id").agg(F.count("*").alias("n"))
    drift = declared.join(counts, "dataset_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("row_count")).select("dataset_id", F.lit("row_count_drift").alias("code"), F.lit("").alias("field"), F.coalesce("n", F.lit(0)).alias("n"))
    lost = declared.crossJoin(rows.sparkSession.createDataFrame([(v,) for v in unmapped], "field string")).select("dataset_id", F.lit("unmapped_variable").alias("code"), "field", F.lit(1).cast("long").alias("n"))
    return drift.unionByName(found).unionByName(lost)
