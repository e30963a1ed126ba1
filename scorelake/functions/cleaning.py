"""Answer cleaning and match normalisation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.numbers import bound

# Answer prefixes, labels, units and punctuation that scores depend on.
PREFIX = r"(?iU)^(?:最\s*终\s*答\s*案[：:\s]*|答\s*案(?:\s*是)?[：:\s]*|回\s*答[：:\s]*|答\s*题?[：:\s]*|answer[s]?[：:]?\s*|final\s+answer\s*[：:]?\s*|结\s*论[：:\s]*)"
LABELS = r"(?U)^(?:面积|周长|半周长|体积|质量|速度|时间|长度|宽度|高度)[=：:\s]*"
MONEY = r"(?:元|块|美元|人民币)$"
UNITS = "平方千米 平方公里 平方米 平方厘米 平方毫米 立方米 立方分米 立方厘米 立方毫米 公顷 千米 公里 米 厘米 毫米 毫升 升 千克 克 吨 秒 分钟 小时 天 年 万元 亿元 个 只 头 条 张 本 辆 架 倍 分 度 ℃ °C °F kg g mg ml L m cm mm km".split()
MATCH_UNITS = [*UNITS, *"元 块 美元 人民币".split()]
TRAILING = "[。,.!?！，、；：]+$"
GROUPED_NUMBER = r"^[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"


def stripped(x: Column) -> Column:
    """Without white space of any script at the edges."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_prediction(text: Column, split_commas: bool = True, normalize_whitespace: bool = True, strip_units: bool = True) -> Column:
    """The bare answer of a model output: its last line with an answer prefix, or its last line, without the noise."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), stripped), lambda x: x != "")

    def last_line(lines: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(PREFIX)), F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))

    def without_note(x: Column) -> Column:
        return F.when(x.rlike(r"^[（(][^）)]*[）)]$"), x).otherwise(F.regexp_replace(x, r"(?U)\s*[（(][^）)]*[）)]\s*$", ""))

    def without_parens(x: Column) -> Column:
        return F.when(x.rlike(r"(?s)^\(.*\)$|^（.*）$"), stripped(F.regexp_replace(x, r"(?s)^.|.$", ""))).otherwise(x)

    def first_part(x: Column) -> Column:
        first = lambda comma: stripped(F.split(x, comma)[0])
        return F.when(x.contains("，"), first("，")).when(x.contains(",") & ~x.rlike(GROUPED_NUMBER), first(",")).otherwise(x)

    last = stripped(F.regexp_replace(bound(lines, last_line), PREFIX, ""))
    last = stripped(F.regexp_replace(F.regexp_replace(last, r'^"+|"+$', ""), r"^'+|'+$", ""))
    last = bound(bound(last, without_note), without_parens)
    if split_commas:
        last = bound(last, first_part)
    last = F.regexp_replace(last, LABELS, "")
    if strip_units:
        last = F.regexp_replace(F.regexp_replace(last, MONEY, ""), rf"(?U)(?<=\d)\s*(?:{'|'.join(UNITS)})$", "")
    last = F.regexp_replace(last, TRAILING, "")
    return stripped(F.regexp_replace(last, r"(?U)\s+", "" if normalize_whitespace else " "))


def extract_code(text: Column) -> Column:
    """The joined contents of fenced blocks, else the text without stray fences."""
    fence = r"(?m)^[ \t]*```[ \t]*\w*[ \t]*$"
    parts = F.filter(F.transform(F.slice(F.split(text, fence), 2, 1 << 30), stripped), lambda x: x != "")
    joined = stripped(F.array_join(parts, "\n\n"))
    found = F.when(text.rlike(fence), F.when(joined != "", joined).otherwise(stripped(text))).otherwise(stripped(F.replace(text, F.lit("```"), F.lit(""))))
    return F.coalesce(found, F.lit(""))


def half_width(x: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as their plain forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return bound(x, lambda t: F.when(t.rlike("[！-～　]"), F.translate(t, wide, plain)).otherwise(t))


#: Folds that lower-casing does not make: sharp s, final sigma, the long s and Latin ligatures.
FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def case_folded(x: Column) -> Column:
    """Lower case with the folds of FOLDS; other special folds are left as lower-casing makes them."""

    def folded(low: Column) -> Column:
        out = F.translate(low, "ςſ", "σs")
        for sign, letters in FOLDS.items():
            if len(letters) > 1:
                out = F.replace(out, F.lit(sign), F.lit(letters))
        return F.when(low.rlike(f"[{''.join(FOLDS)}]"), out).otherwise(low)

    return bound(F.lower(x), folded)


def match_text(x: Column, strip_units: bool = True, remove_whitespace: bool = True) -> Column:
    """The form in which answers are compared."""

    def without_unit(text: Column) -> Column:
        def chosen(compact: Column) -> Column:
            bare = F.regexp_replace(compact, rf"(?iu)(?<=\d)(?:{'|'.join(MATCH_UNITS)})$", "")
            return bound(bare, lambda b: F.when(b != compact, b).otherwise(text))

        return bound(F.regexp_replace(text, r"(?U)\s+", ""), chosen)

    text = half_width(stripped(F.coalesce(x, F.lit(""))))
    if strip_units:
        text = bound(text, without_unit)
    text = bound(text, lambda t: F.when(t.rlike(r"(?s)^\(.*\)$"), stripped(F.regexp_replace(t, r"(?s)^.|.$", ""))).otherwise(t))
    text = F.regexp_replace(text, TRAILING, "")
    return case_folded(F.regexp_replace(text, r"(?U)\s+", "" if remove_whitespace else " "))
