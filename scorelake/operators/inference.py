"""Batch inference: prompts in, answers out, by a function of the user's or by the offline model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.cleaning import stripped
from scorelake.functions.numbers import bound

#: What an answer adds to its row.
ANSWER = "answer string, prompt_tokens long, completion_tokens long, latency_ms long, error string"


def completed(rows: DataFrame, complete: Callable[[list[str]], list[dict]], tasks: int | None = None, prompt: str = "prompt") -> DataFrame:
    """rows with the columns of ANSWER. complete: prompts of a batch -> a dict for each, with `answer` and the others if
    known; a batch on which it fails has its error in every row and no answer, and is not asked again. tasks: how many
    batches are asked at once."""
    names = [f.split()[0] for f in ANSWER.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = complete(batch[prompt].fillna("").tolist())
            except Exception as e:  # noqa: BLE001  whatever the user's function raises belongs to its rows
                got = [{"error": str(e)[:500]}] * len(batch)
            answers = pd.DataFrame([[x.get(n) for n in names] for x in got], columns=names).astype({n: "Int64" for n in names[1:4]})
            yield pd.concat([batch.reset_index(drop=True), answers], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [ANSWER])
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(ask, schema)


def offline_answer(prompt: Column) -> Column:
    """A deterministic answer: simple arithmetic, one known fact, else the last line, at most 120 characters of it."""
    sum_ = r"(\d+)\s*([+\-*/])\s*(\d+)"
    a, b = (F.regexp_extract(prompt, sum_, i).try_cast("decimal(30,0)") for i in (1, 3))
    op = F.regexp_extract(prompt, sum_, 2)
    whole = F.when(op == "+", (a + b).cast("string")).when(op == "-", (a - b).cast("string")).when(op == "*", F.try_multiply(a.cast("decimal(19,0)"), b.cast("decimal(19,0)")).cast("string"))
    part = a.cast("double") / F.when(b == 0, None).otherwise(b.cast("double"))
    share = F.when(b == 0, "0").when(part == F.floor(part), F.floor(part).cast("string")).otherwise(part.cast("string"))
    lines = F.filter(F.transform(F.split(prompt, r"\r\n|[\n\r]"), stripped), lambda x: x != "")
    last = bound(lines, lambda x: F.substring(F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit("mock response")), 1, 120))
    return F.coalesce(F.when(op == "/", share).otherwise(whole), F.when(F.lower(prompt).contains("france"), "Paris"), last)


def offline_model(rows: DataFrame, model: Column, prompt: str = "prompt") -> DataFrame:
    """rows with the columns of ANSWER by the offline model; tokens are a quarter of the characters, and latency is
    between 50 and 349 ms by a hash of model and prompt. No Python is involved."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    tokens = lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")
    digest = F.sha2(F.concat(model.cast("string"), F.lit(":"), text), 256)
    out = rows.withColumn("answer", offline_answer(text))
    return out.withColumns({"prompt_tokens": tokens(text), "completion_tokens": tokens(F.col("answer")), "latency_ms": F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 300 + 50, "error": F.lit(None).cast("string")})
