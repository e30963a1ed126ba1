"""Judging by a model: prompts, one call per distinct question, verdicts and rubric scores."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import bound
from scorelake.operators.metrics import judge_key, judge_verdict
from scorelake.sources.storage import stored

# What a judge may answer, and how much of a prediction it is shown.
YES, NO = ["MATCH", "YES", "CORRECT", "TRUE"], ["NO_MATCH", "NO", "INCORRECT", "FALSE"]
SHOWN = 2000
#: Share of the rows from which a question's answer is broadcast.
HOT_SHARE = 1e-3
#: What is judged in each kind of task, and the rubric dimensions it has by default.
TASKS = {
    "qa": ("means the same as the expected answer", ["correctness", "completeness"]),
    "classification": ("names the expected class", ["correctness"]),
    "coding": ("solves the task as the expected solution does", ["correctness", "completeness", "quality"]),
    "generation": ("states the facts of the expected text", ["correctness", "completeness", "coherence"]),
    "agent": ("reaches the expected outcome", ["outcome", "completeness"]),
}


def judge_prompt(kind: str, expected: Column, prediction: Column) -> Column:
    """The question to a judge; unknown kinds are asked as qa."""
    what = TASKS.get(kind, TASKS["qa"])[0]
    return F.concat(F.lit(f"Decide whether the prediction {what}. Wording and layout do not matter.\n\nExpected: "), F.coalesce(expected, F.lit("")), F.lit("\nPrediction: "), F.substring(F.coalesce(prediction, F.lit("")), 1, SHOWN), F.lit("\n\nAnswer MATCH or NO_MATCH and nothing else."))


def rubric(dimensions: list[dict] | None, kind: str = "qa") -> list[dict]:
    """Dimensions with key, name, description and weight; the kind's own ones without any. ValueError on blank or
    repeated names and on weights that are not finite, negative, or all zero."""
    out: list[dict] = []
    for given in dimensions or [{"name": n} for n in TASKS.get(kind, TASKS["qa"])[1]]:
        name, weight = given.get("name"), given.get("weight", 1.0)
        key = re.sub("[^0-9a-z_]+", "_", name.strip().lower()).strip("_") if isinstance(name, str) else ""
        if not key or key in [d["key"] for d in out]:
            raise ValueError(f"rubric dimension {name!r} has no key of its own")
        weight = float(weight)
        if not 0 <= weight < math.inf:
            raise ValueError(f"weight of {name} must be finite and not negative")
        out.append({"key": key, "name": name.strip(), "description": given.get("description") or "", "weight": weight})
    if not sum(d["weight"] for d in out):
        raise ValueError("rubric dimensions need a positive total weight")
    return out


def rubric_prompt(dimensions: list[dict], scale: int, expected: Column, prediction: Column, rationale: bool = False) -> Column:
    lines = "\n".join(f"- {d['key']}: {d['description'] or d['name']}" for d in dimensions)
    shape = ", ".join(f'"{d["key"]}": 1-{scale}' for d in dimensions)
    tail = f"\n\nGive each dimension 1 to {scale} points, {scale} for no fault:\n{lines}\n\nAnswer with JSON only: {{\"scores\": {{{shape}}}" + (", \"rationale\": \"one sentence\"}" if rationale else "}")
    return F.concat(F.lit("Expected: "), F.coalesce(expected, F.lit("")), F.lit("\nPrediction: "), F.substring(F.coalesce(prediction, F.lit("")), 1, SHOWN), F.lit(tail))


def rubric_scores(text: Column, dimensions: list[dict], scale: int) -> Column:
    """(scores..., total) of a judge's answer: JSON {"scores": {...}}, flat JSON, or lines `key: n`. A dimension that is
    not there counts 0; total is the weighted mean, null if none was found. true and false are no points."""
    def values(body: Column) -> list[Column]:
        valid = F.try_parse_json(body).isNotNull()
        inner = F.coalesce(F.get_json_object(body, "$.scores").startswith("{"), F.lit(False))
        out = []
        for d in dimensions:
            said = F.when(valid, F.when(inner, F.get_json_object(body, f"$.scores.{d['key']}")).otherwise(F.get_json_object(body, f"$.{d['key']}")))
            line = F.nullif(F.regexp_extract(text, rf"{re.escape(d['key'])}\s*[:：=]\s*(\d+(?:\.\d+)?)", 1), F.lit(""))
            number = F.coalesce(said, line).try_cast("double")
            out.append(F.when(~F.isnan(number) & (F.abs(number) < math.inf), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / float(scale)))))
        return out

    def summed(found: Column) -> Column:
        zero = [F.coalesce(found[d["key"]], F.lit(0.0)) for d in dimensions]
        total = sum((z * d["weight"] for z, d in zip(zero, dimensions, strict=True)), F.lit(0.0)) / sum(d["weight"] for d in dimensions)
        some = F.coalesce(*[found[d["key"]] for d in dimensions]).isNotNull()
        return F.struct(*[z.alias(d["key"]) for z, d in zip(zero, dimensions, strict=True)], F.when(some, total).alias("total"))

    body = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return bound(bound(body, lambda b: F.struct(*[v.alias(d["key"]) for v, d in zip(values(b), dimensions, strict=True)])), summed)


def judged_once(rows: DataFrame, call: Callable[[DataFrame], DataFrame], model: str, provider: str, kind: str = "qa", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (prediction, expected) with judge_score, and the grown cache (judge_key, judge_score).

    Equal questions are asked once: their keys are made distinct, those of the cache go, and the answers come back by a
    join on the key. Questions of over HOT_SHARE of the rows, at most 1 / HOT_SHARE of them, get theirs by broadcast, so that
    a common short answer fills no task. call: (judge_key, prompt) -> (judge_key, answer). Answers that are no verdict are not cached.
    """
    keyed = rows.withColumn("judge_key", judge_key(F.col("prediction"), F.col("expected"), F.lit(model), F.lit(provider), F.lit(kind)))
    met = stored(keyed.groupBy("judge_key").agg(F.min(F.struct("expected", "prediction")).alias("q"), F.count("*").alias("n")))
    asked = met if cache is None else met.join(cache, "judge_key", "left_anti")
    answers = stored(call(asked.select("judge_key", judge_prompt(kind, F.col("q.expected"), F.col("q.prediction")).alias("prompt"))).select("judge_key", judge_verdict(F.col("answer"), YES, NO).alias("judge_score")))
    known = answers.where("judge_score IS NOT NULL")
    known = known if cache is None else known.unionByName(cache.select("judge_key", "judge_score"))
    total = met.agg(F.sum("n")).first()[0] or 0
    hot = met.where(F.col("n") > max(1, int(total * HOT_SHARE))).select("judge_key")
    if not hot.limit(1).count():
        return keyed.join(known, "judge_key", "left"), known
    often = F.broadcast(hot)
    told = keyed.join(F.broadcast(hot.join(known, "judge_key", "left")), "judge_key")
    return told.unionByName(keyed.join(often, "judge_key", "left_anti").join(known, "judge_key", "left")), known
