"""Prompt templates, message chains, token estimates, costs and the offline model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import bound, rounded

#: Models that are broadcast at most.
FEW = 10_000
#: {name}, {a.b} or {items.0}; doubled braces are literal.
VARIABLE = r"\{([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*)\}"


def variables(template: str) -> list[str]:
    """Distinct variables of a template in order."""
    bare = template.replace("{{", "").replace("}}", "")
    return list(dict.fromkeys(re.findall(VARIABLE, bare)))


def template_variables(prompts: DataFrame, template: str = "template") -> DataFrame:
    """Variables of each prompt of a table."""
    bare = F.replace(F.replace(F.col(template), F.lit("{{"), F.lit("")), F.lit("}}"), F.lit(""))
    return prompts.withColumn("variables", F.array_distinct(F.regexp_extract_all(bare, F.lit(VARIABLE), 1)))


def json_path(name: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in name.split("."))


def rendered(template: str, source: Column) -> Column:
    """The template, compiled once into a concatenation over a JSON column; missing variables are empty."""
    out, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|" + VARIABLE, template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        out.append(F.lit(m.group(0)[0]) if m.group(1) is None else F.coalesce(F.get_json_object(source, json_path(m.group(1))), F.lit("")))
    return F.concat(*out, F.lit(template[at:]))


def missing_variables(template: str, source: Column) -> Column:
    """Variables of the template whose root the row lacks."""
    roots = F.array(*[F.lit(v.split(".")[0]) for v in variables(template)])
    return F.array_distinct(F.array_except(roots, F.coalesce(F.json_object_keys(source), F.array().cast("array<string>"))))


def message_chains(turns: DataFrame) -> DataFrame:
    """Each conversation as an array of (role, content) in turn order; the chain's length and whether roles are known."""
    chain = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return chain.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.size("m").alias("n_turns"), F.forall("m", lambda x: F.coalesce(x["role"].isin("system", "user", "assistant"), F.lit(False))).alias("valid"))


def estimated_tokens(text: Column) -> Column:
    """One token for each CJK character, one for every four others, rounded up."""
    body = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(body, "[一-鿿]", ""))
    return (F.length(body) - other + F.ceil(other / 4)).cast("long")


def overflowing(rows: DataFrame, text: str, context: str, max_tokens: int) -> DataFrame:
    """Rows with an error where the estimate and the reply do not fit the model's context."""
    need = estimated_tokens(F.col(text)) + max_tokens
    return rows.withColumn("needed", need).withColumn("error", F.when(F.col(context).isNotNull() & (need > F.col(context)), "context overflow"))


def row_cost(prompt_tokens: Column, completion_tokens: Column, input_per_1k: Column, output_per_1k: Column) -> Column:
    """Cost by prices per thousand tokens, to six digits; 0 without a price."""
    zero = F.lit(0.0)
    return rounded(prompt_tokens / 1000 * F.coalesce(input_per_1k, zero) + completion_tokens / 1000 * F.coalesce(output_per_1k, zero))


def fan_out(models: DataFrame, plan: DataFrame) -> DataFrame:
    """One experiment for each model and planned (dataset, benchmark, prompt). Up to FEW models are broadcast; with more,
    both sides are dealt by a number, so that each task joins a share of the models."""
    if models.limit(FEW + 1).count() <= FEW:
        return plan.crossJoin(F.broadcast(models))
    shares = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = models.withColumn("_share", F.pmod(F.xxhash64(*models.columns), F.lit(shares)))
    return plan.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).join(dealt, "_share").drop("_share")


def cost_unknown(models: DataFrame, pricing: str = "pricing") -> DataFrame:
    """Whether a model's cost is unknown: not free, and no price in its pricing JSON."""
    known = F.coalesce(F.get_json_object(pricing, "$.input_per_1k"), F.get_json_object(pricing, "$.output_per_1k")).isNotNull()
    return models.withColumn("cost_unknown", ~F.coalesce(F.col("free"), F.lit(False)) & ~known)


def few_shot(examples: Column) -> Column:
    """Examples of a JSON list as text: strings as they are; objects as a Q line for each value but the answer, then an A
    line with the answer, which stands under the first known key."""
    # Keys of an answer, in order.
    keys = ["answer", "expected", "label", "output", "target", "ground_truth"]

    def block(x: Column) -> Column:
        def lines(pairs: Column) -> Column:
            own = F.coalesce(*[F.when(F.map_contains_key(pairs, k), F.lit(k)) for k in keys])
            asked = F.transform(F.map_values(F.map_filter(pairs, lambda k, v: ~k.eqNullSafe(own))), lambda v: F.concat(F.lit("Q: "), F.coalesce(v, F.lit(""))))
            told = F.when(own.isNotNull(), F.array(F.concat(F.lit("A: "), F.coalesce(F.element_at(pairs, F.coalesce(own, F.lit(""))), F.lit(""))))).otherwise(F.array().cast("array<string>"))
            return F.array_join(F.concat(asked, told), "\n")

        return F.when(x.startswith("{"), bound(F.from_json(x, "map<string,string>"), lines)).otherwise(x)

    return F.array_join(F.transform(F.from_json(examples, "array<string>"), block), "\n\n")


def path_missing(name: str, source: Column) -> Column:
    """Whether a JSON row lacks a nested path; a null at its end counts as there."""
    *above, last = name.split(".")
    parent = F.get_json_object(source, json_path(".".join(above)))
    inside = F.array_contains(F.coalesce(F.json_object_keys(parent), F.array().cast("array<string>")), last)
    return F.get_json_object(source, json_path(name)).isNull() & ~F.coalesce(inside, F.lit(False))


def rendered_or_dumped(template: str, source: Column) -> Column:
    """The rendered template; where a nested variable is missing, the template as it stands and the row's fields, one
    `key: value` line each. Missing plain variables are empty."""
    nested = [path_missing(v, source) for v in variables(template) if "." in v]
    if not nested:
        return rendered(template, source)
    lines = F.transform(F.map_entries(F.from_json(source, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    missing = nested[0]
    for m in nested[1:]:
        missing = missing | m
    return F.when(missing, F.concat(F.lit(template + "\n\n"), F.array_join(lines, "\n"))).otherwise(rendered(template, source))


def message_chain(template: str, source: Column) -> Column:
    """(messages, error) of a structured row: its `messages` as history, then a user turn of its examples and the rendered
    prompt. A message of unknown role or without a text is an error, and so are messages or examples that are no list."""
    history = F.from_json(F.get_json_object(source, "$.messages"), "array<struct<role:string,content:string>>")
    given, shots = F.get_json_object(source, "$.messages"), F.get_json_object(source, "$.examples")
    bad = F.exists(history, lambda m: m.isNull() | ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) | m["content"].isNull())
    error = F.when(given.isNotNull() & ~F.coalesce(given.startswith("["), F.lit(False)), "messages must be a list").when(F.coalesce(bad, F.lit(False)), "a message needs a known role and a text").when(shots.isNotNull() & ~F.coalesce(shots.startswith("["), F.lit(False)), "examples must be a list")
    prompt = rendered_or_dumped(template, source)
    last = F.when(F.coalesce(few_shot(shots), F.lit("")) != "", F.trim(F.concat(few_shot(shots), F.lit("\n\n"), prompt))).otherwise(prompt)
    turn = F.array(F.struct(F.lit("user").alias("role"), last.alias("content")))
    chain = F.concat(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), turn)
    return F.struct(F.when(error.isNull(), chain).alias("messages"), error.alias("error"))


def price_catalog(models: DataFrame, free_ids: list[str] = ()) -> DataFrame:
    """models (model_id, name, prompt_price, completion_price per token) with prices per thousand tokens and a flag for
    free ones, by the ending `:free` or by name, in order of name."""
    per_1k = lambda c: rounded(F.col(c).try_cast("double") * 1000, 9)
    free = F.col("model_id").endswith(":free") | F.col("model_id").isin(list(free_ids))
    return models.select("model_id", "name", per_1k("prompt_price").alias("input_per_1k"), per_1k("completion_price").alias("output_per_1k"), free.alias("free")).orderBy("name", "model_id")
