"""The answer set of a row: what a metric compares a prediction with.

It is read once from the canonical answer, the raw expected JSON (a list, or an object with nested, listed or plain values)
and the answer policy, and then serves all metrics of a suite: `expected`, the canonical text; `candidates`, every spelling
that is accepted; `required`, the answers that all have to be given where a policy asks for several.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.numbers import bound
from scorelake.functions.vectorized import ANSWER_KEYS, nested_answer_sets, texts

#: JSON whose values are texts, whole numbers, nulls and lists of these: read without a helper.
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_PLAIN = rf"(?:{_TEXT}|-?\d++|null)"
_LIST = rf"\[\s*(?:{_PLAIN}\s*(?:,\s*{_PLAIN}\s*)*+)?\]"
_MEMBER = rf"{_TEXT}\s*:\s*(?:{_PLAIN}|{_LIST})\s*"
FLAT = rf"^\s*(?:{_LIST}|\{{\s*(?:{_MEMBER}(?:,\s*{_MEMBER})*+)?\}})\s*$"


class AnswerSet(NamedTuple):
    expected: Column
    candidates: Column
    required: Column

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in self._asdict().items()))

    @classmethod
    def of(cls, struct: str) -> AnswerSet:
        """The set in a column made by `struct`."""
        return cls(*(F.col(f"{struct}.{n}") for n in cls._fields))


def policy_values(policy: dict | None) -> list[str]:
    """All accepted spellings that a policy names."""
    out: list[str] = []
    for key in ("aliases", "accepted_answers", "valid_answers"):
        given = (policy or {}).get(key)
        out += [t for x in (given.values() if isinstance(given, dict) else [given]) for t in texts(x)]
    return [x for x in out if x.strip()]


def _flat_sets(raw: Column) -> Column:
    """struct(accepted, required) of flat JSON, which is parsed once; required is null if it names none."""
    is_list = raw.rlike(r"^\s*\[")
    has_answer = F.array_contains(F.json_object_keys(raw), "answer")

    def sets(json: Column) -> Column:
        listed = lambda path: F.array_compact(F.coalesce(F.try_variant_get(json, path, "array<string>"), F.array(F.try_variant_get(json, path, "string"))))
        members = F.flatten(F.array(*(listed(f"$.{k}") for k in (*ANSWER_KEYS, "aliases"))))
        return F.struct(F.when(is_list, listed("$")).otherwise(members).alias("accepted"), F.when(is_list, listed("$")).when(has_answer, listed("$.answer")).alias("required"))

    return bound(F.try_parse_json(raw), sets)


def answer_set(expected: Column | AnswerSet, policy: dict | None = None, raw: Column | None = None) -> AnswerSet:
    """The answer set of a canonical answer, a policy and the raw expected JSON; an answer set is returned as it is."""
    if isinstance(expected, AnswerSet):
        return expected
    text = F.coalesce(expected, F.lit(""))
    named = F.array(*map(F.lit, policy_values(policy))).cast("array<string>")
    if raw is None:
        accepted, required = F.array(text), F.array(text)
    else:
        flat = raw.rlike(FLAT) & F.try_parse_json(raw).isNotNull()  # a repeated key is left to the helper
        sets = F.coalesce(F.when(flat, _flat_sets(raw)), nested_answer_sets(F.when(~flat, raw)))
        accepted, required = F.concat(F.array(text), F.coalesce(sets["accepted"], F.array().cast("array<string>"))), F.coalesce(sets["required"], F.array(text))
    return AnswerSet(expected, F.filter(F.concat(accepted, named), lambda x: x.rlike(r"(?U)\S")), required)
