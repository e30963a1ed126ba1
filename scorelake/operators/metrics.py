"""The metric registry: functions (prediction, expected, policy, raw, **config) -> score column in [0, 1].

expected is the canonical answer or a whole answer set, raw the expected JSON as it was given. policy is a plain dict:
multi_answer (None, all, set), aliases, accepted_answers, valid_answers, strip_units, reject_extra, partial_credit. Its
lists become literals. config holds a metric's own settings, such as a threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.cleaning import case_folded, match_text, stripped
from scorelake.functions.numbers import bound, rounded
from scorelake.functions.vectorized import texts
from scorelake.operators.answers import AnswerSet, answer_set

METRICS: dict[str, Callable[..., Column]] = {}
# The metric that each task type takes by default.
DEFAULT_METRIC = {"qa": "exact_match_ci", "classification": "exact_match_ci", "coding": "contains", "generation": "f1_token", "agent": "contains"}
# Phrases around an option letter.
OPTION_PATTERNS = [r"(?:选项|选择|正确答案|答案|选)[^A-Za-z]{0,4}([A-Ea-e])", r"([A-Ea-e])[^A-Za-z]{0,4}(?:选项)", r"(?<![A-Za-z0-9一-鿿])([A-Ea-e])(?=\s|$|[.,;:!?。，；：）)]|[）)]\s*$)"]
# Chinese number units, longest first.
NUMBER_UNITS = {"万亿": 1e12, "千万": 1e7, "百万": 1e6, "亿": 1e8, "万": 1e4, "千": 1e3}
NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def register_metric(name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        METRICS[name] = f
        return f

    return add


def list_metrics() -> list[str]:
    return sorted(METRICS)


def one(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def split_answers(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?U)[,，、]\s*"), lambda v: F.trim(v)), lambda v: v != "")


def option_letter(x: Column) -> Column:
    """The option letter that a text states, or an empty string."""
    found = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in OPTION_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def several(policy: dict | None) -> bool:
    """Whether a policy asks for more than one answer."""
    return (policy or {}).get("multi_answer") in ("all", "set")


def matching_form(policy: dict | None, remove_whitespace: bool = True) -> Callable[[Column], Column]:
    units = (policy or {}).get("strip_units", True)
    return lambda x: match_text(x, units, remove_whitespace)


@register_metric("exact_match")
def exact_match(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> Column:
    aim = answer_set(expected, policy, raw).expected
    return one(aim.rlike(r"(?U)\S") & (prediction == aim))


@register_metric("exact_match_ci")
def exact_match_ci(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> Column:
    answers, form = answer_set(expected, policy, raw), matching_form(policy)
    if several(policy):
        score = _many(prediction, answers, policy or {}, form)
    else:
        def matched(accepted: Column) -> Column:
            rescued = lambda letter: F.exists(accepted, lambda c: c.rlike("^[a-z]$")) & (letter != "") & F.array_contains(accepted, F.lower(letter))
            return F.array_contains(accepted, form(prediction)) | bound(option_letter(prediction), rescued)

        score = one(bound(F.transform(F.array_distinct(answers.candidates), form), matched))
    return F.when(form(answers.expected) == "", F.lit(0.0)).otherwise(score)


def _many(prediction: Column, answers: AnswerSet, policy: dict, form: Callable[[Column], Column]) -> Column:
    """Required answers against given parts: the share found, or all or nothing."""
    required = F.array_distinct(F.transform(F.filter(answers.required, lambda x: x.rlike(r"(?U)\S")), form))

    def parts(required: Column) -> Column:
        split = F.array_distinct(F.transform(split_answers(prediction), form))
        spelled = lambda compact: F.when(F.forall(required, lambda r: r.rlike("^[a-z]$")) & compact.rlike("^[a-z]{2,}$"), F.array_distinct(F.filter(F.split(compact, ""), lambda p: p != ""))).otherwise(split)
        return bound(form(prediction), spelled)

    aliases = policy.get("aliases") or {}
    spellings = [(form(F.lit(str(k))), F.transform(F.array(*map(F.lit, texts(v))), form)) for k, v in aliases.items() if texts(v)] if isinstance(aliases, dict) else []

    def score(required: Column, parts: Column) -> Column:
        hit = lambda r: _any([F.array_contains(parts, r), *((r == k) & (k != "") & F.arrays_overlap(v, parts) for k, v in spellings)])
        matched = F.size(F.filter(required, hit))
        out = matched / F.size(required) if policy.get("partial_credit") else one(matched == F.size(required))
        if policy.get("reject_extra"):
            same = (F.size(F.array_except(parts, required)) == 0) & (F.size(F.array_except(required, parts)) == 0)
            out = F.when(same, out).otherwise(F.lit(0.0))
        return F.when(F.size(required) == 0, F.lit(0.0)).otherwise(out)

    both = bound(required, lambda r: F.struct(r.alias("required"), parts(r).alias("parts")))
    return bound(both, lambda x: score(x["required"], x["parts"]))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


@register_metric("contains")
def contains(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> Column:
    """Whether an accepted answer stands in the prediction as words of its own; of several required ones, all or their share."""
    answers, form = answer_set(expected, policy, raw), matching_form(policy, remove_whitespace=False)

    def found_in(text: Column, c: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        ascii_ = F.rlike(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))
        cjk = F.rlike(text, F.concat(F.lit(r"(?<![㐀-鿿])"), quoted, F.lit(r"(?![㐀-鿿])")))
        return F.when(c == "", False).when(c.rlike("^[a-z0-9]+(?:[ _-][a-z0-9]+)*$"), ascii_).when(c.rlike(r"[㐀-鿿]"), cjk).otherwise(F.contains(text, c))

    # what a helper may have made stands outside the function that reads it
    row = F.struct(form(prediction).alias("text"), F.transform(F.array_distinct(answers.candidates), lambda c: form(form(c))).alias("accepted"), F.transform(answers.required, form).alias("required"))

    def score(x: Column) -> Column:
        found = lambda forms: F.filter(forms, lambda c: found_in(x["text"], c))
        any_ = one(F.size(found(x["accepted"])) > 0)
        if not several(policy):
            return any_
        n, matched = F.size(x["required"]), F.size(found(x["required"]))
        share = matched.cast("double") / n if (policy or {}).get("partial_credit") else one(matched == n)
        return F.when(n > 1, share).otherwise(any_)

    return F.when(match_text(answers.expected, (policy or {}).get("strip_units", True)) == "", F.lit(0.0)).otherwise(bound(row, score))


def numbers(x: Column) -> Column:
    """The numbers of a text: with Chinese units first, then plain ones outside those."""
    unit = "|".join(NUMBER_UNITS)
    with_unit = rf"({NUMBER})\s*({unit})"
    factor = F.create_map(*[F.lit(v) for kv in NUMBER_UNITS.items() for v in kv])
    value = lambda t: F.regexp_replace(t, ",", "").try_cast("double")

    def found(text: Column) -> Column:
        large = F.transform(F.regexp_extract_all(text, F.lit(with_unit), 0), lambda m: value(F.regexp_extract(m, with_unit, 1)) * F.element_at(factor, F.regexp_extract(m, with_unit, 2)))
        rest = F.regexp_replace(text, with_unit, "\u0001")
        return F.array_compact(F.concat(large, F.transform(F.regexp_extract_all(rest, F.lit(NUMBER + r"(?:[eE][-+]?\d+)?"), 0), value)))

    # a text without a digit has no number; the patterns are then not tried
    return bound(F.coalesce(x, F.lit("")), lambda text: F.when(text.rlike(r"\d"), found(text)).otherwise(F.array().cast("array<double>")))


@register_metric("numeric_match")
def numeric_match(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None, tolerance: float = 1e-6) -> Column:
    if not 0 <= tolerance < float("inf"):
        raise ValueError("tolerance must be finite and non-negative")
    both = F.struct(numbers(prediction).alias("got"), F.array_distinct(F.flatten(F.transform(answer_set(expected, policy, raw).candidates, numbers))).alias("aims"))

    def score(x: Column) -> Column:
        got, aims = x["got"], x["aims"]
        near = lambda t: F.exists(got, lambda g: F.abs(g - t) <= tolerance)
        any_ = one(F.exists(aims, near))
        if not several(policy):
            return any_
        matched = F.size(F.filter(aims, near))
        many = F.try_divide(matched.cast("double"), F.size(aims)) if (policy or {}).get("partial_credit") else one(matched == F.size(aims))
        return F.when(F.size(aims) > 1, many).otherwise(any_)

    return bound(both, score)


@register_metric("fuzzy_match")
def fuzzy_match(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None, threshold: float = 0.8) -> Column:
    """Whether an accepted answer is near: one minus the edit distance over the longer length. White space and case do not count."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    form = matching_form(policy)
    squeezed = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", ""))

    def near(text: Column, c: Column) -> Column:
        return (c != "") & (1 - F.levenshtein(text, c) / F.greatest(F.length(text), F.length(c)) >= threshold)

    row = F.struct(squeezed(prediction).alias("text"), F.transform(F.array_distinct(answer_set(expected, policy, raw).candidates), lambda c: squeezed(form(c))).alias("accepted"))
    return bound(row, lambda x: one((x["text"] != "") & F.exists(x["accepted"], lambda c: near(x["text"], c))))


register_metric("fuzzy_match_ci")(fuzzy_match)


def judge_verdict(text: Column, yes: list[str], no: list[str]) -> Column:
    """1 or 0 by the exact verdict words of a judge, null if it said neither."""
    said = F.upper(F.trim(text))
    return F.when(said.isin(yes), 1.0).when(said.isin(no), 0.0)


def judge_key(prediction: Column, expected: Column, model: Column, provider: Column, kind: Column) -> Column:
    """The key under which equal judge calls are made once; blanks at the edges do not matter, and no kind is qa."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [stripped(text(prediction)), stripped(text(expected)), text(model), text(provider), F.coalesce(kind.cast("string"), F.lit("qa"))]
    return F.substring(F.sha2(F.concat_ws("|||", *parts), 256), 1, 32)


def canonical_expected(expected: Column) -> Column:
    """The answer that an expected JSON object states. Objects of texts and whole numbers stay in the engine; nested and
    other ones are handed to a helper, which sees nothing of the rest."""
    from scorelake.functions.vectorized import ANSWER_KEYS, nested_answers

    text = r'"(?:[^"\\]|\\.)*"'
    flat = expected.rlike(rf"^\s*\{{\s*(?:{text}\s*:\s*(?:{text}|-?\d+|null)\s*(?:,\s*|(?=\}})))*\}}\s*$")
    value = lambda c: F.nullif(stripped(c), F.lit(""))
    known = [value(F.get_json_object(expected, f"$.{k}")) for k in ANSWER_KEYS]
    first = value(F.get(F.map_values(F.from_json(expected, "map<string,string>")), F.lit(0)))
    return F.coalesce(F.when(flat, F.coalesce(*known, first)), nested_answers(F.when(~flat, expected)), F.lit(""))


def test_pass_rate(rows: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with pass_rate, the share of a row's test outcomes (keys, passed) that passed; 0 without any."""
    rates = outcomes.groupBy(*keys).agg(rounded(F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double"))).alias("pass_rate"))
    return rows.join(rates, keys, "left").withColumn("pass_rate", F.coalesce("pass_rate", F.lit(0.0)))


def guarded(score: Column) -> Column:
    """A score in [0, 1], else null."""
    return bound(score, lambda s: F.when(~F.isnan(s) & s.between(0.0, 1.0), s))


def quoted(x: Column) -> Column:
    """A text in quotes: single ones, or double ones where it holds a single but no double one."""
    body = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single, double = x.contains("'"), x.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def score_reason(metric: str, score: Column, cleaned: Column, expected: Column, components: dict[str, Column] | None = None, finish: Column | None = None) -> Column:
    """Why a row has its score. components: the metric scores of a weighted suite, by name; finish: why the model stopped,
    which is told of empty predictions."""
    # The wording of a reason.
    details = {"contains": "expected substring matched as a standalone text span", "agent": "expected substring matched as a standalone text span", "numeric_match": "first numeric values matched within tolerance", "fuzzy_match": "normalized Levenshtein similarity met the configured threshold", "fuzzy_match_ci": "normalized Levenshtein similarity met the configured threshold", "llm_judge": "LLM judge classified the prediction as semantically equivalent"}
    if components:
        parts = [F.concat(F.lit(f"{name}="), F.format_string("%.4f", value)) for name, value in components.items()]
        detail = F.concat(F.lit("weighted metric components: "), F.concat_ws(", ", *parts))
    elif metric in details:
        detail = F.lit(details[metric])
    else:
        detail = F.when(cleaned == expected, "cleaned prediction equals expected canonical answer").otherwise(F.concat(F.lit("cleaned prediction "), quoted(cleaned), F.lit(" vs expected "), quoted(expected)))
    note = F.lit("") if finish is None else F.when(cleaned == "", F.concat(F.lit("; empty_prediction finish_reason="), F.coalesce(finish, F.lit("None")))).otherwise("")
    return F.concat(F.lit(f"{metric}: "), F.when(score >= 1.0, "matched").otherwise("did not match"), F.lit("; "), detail, note)


def answer_tokens(text: Column) -> Column:
    """Latin words and numbers; for texts with CJK characters the characters and their neighbours in pairs."""
    # The tokens that scores depend on.
    latin, sign, cjk = "[a-z0-9]+(?:['’][a-z0-9]+)?", r"(?U)\S", "[　-鿿]"

    def pairs(chars: Column) -> Column:
        return F.concat(chars, F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))

    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(cjk), bound(F.regexp_extract_all(F.lower(text), F.lit(sign), 0), pairs)).otherwise(F.regexp_extract_all(case_folded(text), F.lit(latin), 0))


def numbered_tokens(tokens: Column) -> Column:
    """The tokens, each with its number among equal ones, so that sets of them compare as multisets. The sorted tokens are cut
    into runs of equal ones: the work grows with the text, not with its square."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.array_sort(tokens), " "), F.lit(" ")), F.lit(r"(\S++) (?:\1 )*+"), 0)
    spread = lambda run, token: F.transform(F.sequence(F.lit(1), (F.length(run) / (F.length(token) + 1)).cast("int")), lambda j: F.concat(token, F.lit(" "), j))
    return F.flatten(F.transform(runs, lambda run: bound(F.substring_index(run, " ", 1), lambda token: spread(run, token))))


@register_metric("f1_token")
def f1_token(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> Column:
    """Multiset token F1 with the best accepted answer, or with all required ones as one text."""
    answers = answer_set(expected, policy, raw)
    aims = F.array_distinct(answers.candidates)
    if several(policy):
        aims = F.when(F.size(answers.required) > 1, F.array(F.array_join(answers.required, " "))).otherwise(aims)

    row = F.struct(numbered_tokens(answer_tokens(prediction)).alias("got"), F.transform(aims, lambda a: numbered_tokens(answer_tokens(a))).alias("aims"))

    def best(x: Column) -> Column:
        got = x["got"]
        f1 = lambda aim: bound(F.size(F.array_intersect(got, aim)), lambda common: F.when(common > 0, 2.0 * common / (F.size(got) + F.size(aim))).otherwise(F.lit(0.0)))
        return F.array_max(F.transform(x["aims"], f1))

    return F.coalesce(bound(row, best), F.lit(0.0))


@register_metric("tool_call")
def tool_call(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> Column:
    """1, 0.5 or 0: whether the output calls the expected tool with the argument keys of the raw expected JSON."""
    from scorelake.functions.vectorized import tool_scores

    return tool_scores(prediction, answer_set(expected).expected, F.lit(None).cast("string") if raw is None else raw)


@register_metric("semantic_similarity")
def _semantic_similarity(prediction: Column, expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None, text_weight: float = 0.9) -> Column:
    from scorelake.functions.vectorized import semantic_similarity

    return semantic_similarity(prediction, answer_set(expected).expected, text_weight)
