"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base signals of a text come from its words `[^\\x20\\x09-\\x0D]+`. Four ratios are made of them, each larger for worse
text. A staircase of rules is fixed before any label is seen: its first step has every ratio's mildest cutoff, and each
further one tightens one ratio by one cutoff of its grid, in turn, so that each step rejects what the one before does and
more. In every stratum (language) the steps are tested in this order on the labelled holdout: with n good documents that
pass the base rules, of which the step's rules together reject k, it is safe if the exact binomial tail
P(Bin(n, ALPHA) <= k) is at most DELTA / strata. Testing ends at the first step that is not safe, so that a stratum's
steps need no correction among themselves (fixed-sequence testing), and the strata are corrected by Bonferroni. Of the
safe steps the one is used that catches the most bad documents, and of equals the mildest: with confidence 1 - DELTA the
rules falsely reject no more than ALPHA of the good documents of any stratum. Without enough labels a stratum has no safe
step and only the base rules act; with no false rejection 85 good labels are enough for four strata.

The trials of a tail are independent: of rows with one id the text of least hash counts, and of equal texts of a stratum,
whatever their ids, one; where their labels differ, the least.

Defined cases: a null text has no words and fails the base rules; a null language is a stratum of its own; labels with
null quality are ignored; repeated rows are judged alike; an empty table gives an empty result; the ids, text and
language are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stored

#: The part of a stratum's good documents that may be rejected, and the risk that it is more.
ALPHA, DELTA = 0.05, 0.05
MAX_BROADCAST_STRATA = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5
#: Ratios and their grids of cutoffs, mildest last: the bounds of what may be rejected at all.
GRID = {
    "symbol_ratio": [0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeat_ratio": [0.02, 0.05, 0.08, 0.12, 0.16],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """The words in order; a blank edge of the text leaves an empty string, which goes."""
    return F.array_remove(F.split(text, BLANK), "")


def base_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, text_hash, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) without any shuffle.

    The five-word windows of a text are hashed. Where some hash occurs twice, (hash, place) pairs are sorted within the
    row, the places of equal neighbours are the repeated windows, and their union is measured along the text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.sha2(body, 256).alias("text_hash"), F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), _words(body).alias("w"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)]))
    one = one.select(
        "doc_id",
        "stratum",
        "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, windows).alias("h"),
    )
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    one = one.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    places = F.filter("p", lambda x, j: (F.get("p", j - 1)["h"] == x["h"]) | (F.get("p", j + 1)["h"] == x["h"]))
    one = one.withColumn("s", F.sort_array(F.transform(places, lambda x: x["i"]))).drop("p")
    covered = F.aggregate(F.transform("s", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("s", i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s")


def with_ratios(signals: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return signals.withColumns({
        "base_failed": failed,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    })


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), exact up to rounding, by the recurrence of its terms in logarithms."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p / (1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(F.least(acc["s"], term) - top))).alias("s"))

    start = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))
    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["s"]))


def staircase() -> list[dict[str, float]]:
    """The rules in order: every grid's mildest cutoff, then one ratio after the other tightened by one."""
    at = {name: len(grid) - 1 for name, grid in GRID.items()}
    out = [{name: GRID[name][k] for name, k in at.items()}]
    while any(at.values()):
        for name in GRID:
            if at[name]:
                at[name] -= 1
                out.append({n: GRID[n][k] for n, k in at.items()})
    return out


def rejected(step: dict[str, float]) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.col(name) > cutoff for name, cutoff in step.items()]), F.lit(False))


def first_rejection(steps: list[dict[str, float]]) -> Column:
    """The first step that rejects a row, the number of steps if none does: each step rejects what those before it do."""
    out = F.lit(len(steps))
    for i, step in reversed(list(enumerate(steps))):
        out = F.when(rejected(step), i).otherwise(out)
    return out


def trials(rated: DataFrame) -> DataFrame:
    """(stratum, quality, first): one row of each id and of each text of a stratum that pass the base rules."""
    names = ["quality", "first"]
    held = rated.where("NOT base_failed AND quality IS NOT NULL").withColumn("first", first_rejection(staircase()))
    row = F.struct("text_hash", *names, "stratum")
    ids = held.groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return ids.groupBy("stratum", "text_hash").agg(F.min(F.struct(*names)).alias("row")).select("stratum", "row.*")


def safe_steps(rated: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step): the step of the staircase in use. rated: doc_id, stratum, text_hash, base_failed and ratios with
    quality 0/1 of the labelled holdout."""
    steps = len(staircase())
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    # a histogram of the first rejections; running sums of it are the rejections of every step
    shares = trials(rated).groupBy("stratum", "first").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    counts = stored(shares.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("bins")).where("n > 0"), "stratum-counts")
    strata = max(1, counts.count())
    until = lambda i, field: F.aggregate(F.filter("bins", lambda b: b["first"] <= i), F.lit(0).cast("long"), lambda a, b: a + b[field])
    rows = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("step"), until(i, "good").alias("k"), until(i, "bad").alias("hits")))
    # a rule that rejects more than its share can't be safe, so that the tail has n * alpha terms at most
    safe = lambda r: (r["k"] <= F.col("n") * alpha) & (log_binomial_tail(F.col("n"), F.least(r["k"], F.ceil(F.col("n") * alpha)), alpha) <= math.log(delta / strata))
    tested = counts.select("stratum", F.transform(rows, lambda r: F.struct(r["step"].alias("step"), r["hits"].alias("hits"), safe(r).alias("safe"))).alias("tested"))
    ended = F.array_position(F.transform("tested", lambda r: r["safe"]), False)
    led = F.when(ended == 0, F.col("tested")).otherwise(F.slice("tested", 1, F.greatest(ended - 1, F.lit(0)).cast("int")))
    best = F.array_max(F.transform(F.filter(led, lambda r: r["hits"] > 0), lambda r: F.struct(r["hits"].alias("hits"), (-r["step"]).alias("late"))))
    return tested.select("stratum", (-best["late"]).alias("step")).where("step IS NOT NULL")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, kept) of every document."""
    signals = stored(with_ratios(base_signals(docs)), "signals")
    rates = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    safe = safe_steps(signals.join(rates, "doc_id"), alpha, delta).select(F.col("stratum").alias("of"), "step")
    # a stratum with a safe step has dozens of labelled documents; the table is small unless strata are countless
    if safe.count() <= MAX_BROADCAST_STRATA:
        safe = F.broadcast(safe)
    out = signals.join(safe, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.coalesce(first_rejection(staircase()) <= F.col("step"), F.lit(False))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
