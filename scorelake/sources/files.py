"""Reading and writing of row files: JSONL, JSON lists, CSV and TSV, versioned results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources.storage import stored

#: Folders over which written results are dealt.
PARTS = 256


def infer_format(path: str, given: str | None = None) -> str:
    """The given format, else that of the extension, else json."""
    known = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}
    return given or known.get(path.rsplit(".", 1)[-1].lower(), "json")


def format_of(path: Column, given: Column) -> Column:
    """infer_format as a column, for a table of paths."""
    end = F.lower(F.element_at(F.split(path, r"\."), -1))
    known = F.when(end.isin("csv", "tsv", "json", "jsonl"), end).when(end == "ndjson", "jsonl").otherwise("json")
    return F.coalesce(given, F.when(F.instr(path, ".") > 0, known), F.lit("json"))


# Encodings in the order in which they are tried, and the marks that a UTF-16 file begins with.
ENCODINGS = ["UTF-8", "GBK", "UTF-16"]
MARKS = ["FFFE", "FEFF"]
#: Settings for charsets beside Spark's own few, and for decoding that puts a sign in place of what is no text.
CHARSETS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def with_charsets(spark: SparkSession) -> None:
    for key, value in CHARSETS.items():
        spark.conf.set(key, value)


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding): the first of ENCODINGS in which all of a file is valid, null if it is none. The text reader gives the
    bytes of lines as they are, so large files are split; only one row for each file is made. An empty file has no row."""
    with_charsets(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("head"), F.col("value").cast("binary").alias("raw"))
    utf8 = F.is_valid_utf8(F.col("raw").cast("string"))
    gbk = ~F.contains(F.decode("raw", "GBK"), F.lit("\ufffd"))
    marked = F.col("head") & F.hex(F.substring("raw", 1, 2)).isin(MARKS)
    facts = lines.groupBy("path").agg(F.bool_and(utf8).alias("utf8"), F.bool_and(gbk).alias("gbk"), F.bool_or(marked).alias("marked"))
    found = F.when(F.col("utf8"), ENCODINGS[0]).when(F.col("gbk"), ENCODINGS[1]).when(F.col("marked"), ENCODINGS[2])
    return facts.select("path", found.alias("encoding"))


def by_encoding(spark: SparkSession, path: str, read: Callable[[list[str], str], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """What `read(paths, encoding)` makes of the files of each encoding, together, and (path, error) of those without one.
    Names and encodings of the files come to the driver, nothing of what is in them."""
    found = stored(file_encodings(spark, path))
    groups: dict[str, list[str]] = {}
    for r in found.where("encoding IS NOT NULL").collect():
        groups.setdefault(r["encoding"], []).append(r["path"])
    parts = [read(sorted(paths), encoding) for encoding, paths in sorted(groups.items())]
    errors = found.where("encoding IS NULL").select("path", F.lit(f"none of {', '.join(ENCODINGS)}").alias("error"))
    return (reduce(DataFrame.unionByName, parts) if parts else None), errors


def _text(spark: SparkSession, paths: list[str], encoding: str, whole: bool = False) -> DataFrame:
    """(path, value) of text files, by line or whole; a byte order mark at the beginning goes. Lines of UTF-16 are no lines of
    bytes: such a file is taken whole by one task."""
    with_charsets(spark)
    apart = whole or encoding == "UTF-16"
    rows = spark.read.text(paths, wholetext=apart).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("head"), F.decode(F.col("value").cast("binary"), encoding).alias("value"))
    rows = rows.withColumn("value", F.when(F.col("head"), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    if apart and not whole:
        rows = rows.withColumn("value", F.explode(F.split("value", "\n")))
    return rows.select("path", (F.col("value") if whole else F.regexp_replace("value", "\r$", "")).alias("value"))


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, value): the non-blank lines of files of any of ENCODINGS, each group of files read by Spark's own reader; and
    (path, error) of undecodable files."""
    lines, errors = by_encoding(spark, path, lambda paths, encoding: _text(spark, paths, encoding))
    empty = spark.createDataFrame([], "path string, value string")
    return (empty if lines is None else lines.where(F.col("value").rlike(r"(?U)\S"))), errors


def write_encoded(lines: DataFrame, path: str, encoding: str) -> None:
    lines.write.option("encoding", encoding).text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(input, error): one row per non-blank line; a line that is no JSON object has an error and no input."""
    return checked_lines(spark.read.text(path).where(F.col("value").rlike(r"\S"))).select("input", "error")


def checked_lines(lines: DataFrame) -> DataFrame:
    """lines with input and error in place of value."""
    good = F.json_object_keys("value").isNotNull()
    return lines.withColumns({"input": F.when(good, F.col("value")), "error": F.when(~good, F.lit("not a JSON object"))}).drop("value")


# The keys of a root object under which its rows may stand.
ROOT_KEYS = ["data", "rows"]


def read_json(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, idx, input, error): the elements of a root list, or of the first list under a root object's ROOT_KEYS, in order.
    A file that is no JSON, or has no such list, gives one row with an error and no idx; an element that is no object has
    an error and no input. A JSON text is one record, whatever its size, and is parsed by one task."""
    whole = _text(spark, [path], encoding, whole=True)
    held = F.from_json("value", f"struct<{', '.join(f'`{k}`: array<string>' for k in ROOT_KEYS)}>")
    is_object, is_list = F.json_object_keys("value").isNotNull(), F.json_array_length("value").isNotNull()
    rows = F.when(is_list, F.from_json("value", "array<string>")).when(is_object, F.coalesce(*[held[k] for k in ROOT_KEYS]))
    error = F.when(~is_object & ~is_list & F.try_parse_json("value").isNull(), "invalid JSON").when(F.col("rows").isNull(), "no list of objects")
    files = whole.withColumn("rows", rows).withColumn("error", error)
    listed = files.where("error IS NULL").select("path", F.posexplode("rows").alias("idx", "value"))
    good = F.json_object_keys("value").isNotNull()
    elements = listed.select("path", "idx", F.when(good, F.col("value")).alias("input"), F.when(~good, F.lit("not a JSON object")).alias("error"))
    return elements.unionByName(files.where("error IS NOT NULL").select("path", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("input"), "error"))


def read_delimited(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A file with a header, all columns as text."""
    return spark.read.csv(path, header=True, sep=separator, multiLine=True, inferSchema=False, encoding=encoding, escape='"')


def write_results(results: DataFrame, path: str) -> None:
    """Replace the rows of the experiments at hand and leave the others. Experiments share PARTS folders by their hash, so that
    folders and files do not grow with the experiments; of the parts that are touched the other experiments' rows are kept."""
    spark, columns = results.sparkSession, results.columns
    new = results.withColumn("part", F.pmod(F.xxhash64("experiment_id"), F.lit(PARTS)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        new = stored(new)
        given = new.select(F.col("experiment_id").alias("given")).distinct()
        touched = old.join(F.broadcast(new.select("part").distinct()), "part", "left_semi")
        kept = touched.join(given, F.col("experiment_id").eqNullSafe(F.col("given")), "left_anti")
        # a folder is not overwritten while it is read
        new = stored(new.unionByName(kept.select(*columns, "part")))
    new.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_bucketed(results: DataFrame, table: str, buckets: int = 16) -> None:
    """Results as a table bucketed and sorted by row_idx: joins of runs on their rows need no exchange, and there are `buckets`
    files whatever the number of experiments."""
    results.repartition(buckets, "row_idx").write.mode("overwrite").bucketBy(buckets, "row_idx").sortBy("row_idx").saveAsTable(table)


def read_page(spark: SparkSession, path: str, where: str, order: str, offset: int, limit: int) -> DataFrame:
    """A page of a partitioned table; the filter on partition columns prunes files."""
    return spark.read.parquet(path).where(where).orderBy(order).offset(offset).limit(limit)


def table_sums(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, checksum): rows and the sum of their hashes, which does not depend on their order."""
    return table.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def reconciled(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, n_source, n_target, same_rows) where the number of rows or what is in them differs."""
    columns = sorted(source.columns)
    a, b = table_sums(source, key, columns), table_sums(target, key, columns)
    both = a.withColumnsRenamed({"n": "n_source", "checksum": "c"}).join(b.withColumnsRenamed({"n": "n_target", "checksum": "d"}), key, "full")
    same = F.col("n_source").eqNullSafe(F.col("n_target")) & F.col("c").eqNullSafe(F.col("d"))
    return both.withColumn("same_rows", same).where(~same).select(key, "n_source", "n_target", "same_rows")


def copied(source: DataFrame, path: str, key: str) -> DataFrame:
    """Copy a table to another store and read it back: the keys that did not arrive whole."""
    source.write.mode("overwrite").parquet(path)
    return reconciled(source, source.sparkSession.read.schema(source.schema).parquet(path), key)
