"""Normalisation of physical-plan text, so that plans differing only in generated ids compare equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a generated id and how it is rewritten, in this order.  The first
# column is text a match always contains; most plan text contains none of it.
REWRITES = (
    ("#", r"#\d+L?", ""),
    ("[plan_id=", r"\s*\[plan_id=\d+\]", ""),
    ("codegen id", r"\s*\[codegen id\s*:\s*\d+\]|codegen id\s*:\s*\d+", ""),
    ("WholeStageCodegen (", r"WholeStageCodegen \(\d+\)", "WholeStageCodegen"),
    ("QueryStage", r"\b(ShuffleQueryStage|ResultQueryStage)\s+\d+\b", "$1"),
)
SPACING = (
    (r"\s+,", ","),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
)
_SPACED = r"\s[\s,)]|\(\s|[\t\n\x0B\f\r]"
_BLANKS = "".join(chr(c) for c in range(0x21))
FILTER_LABEL = "PushedFilters: ["
# Text without any of these characters is not touched by a rewrite.
_TOUCHED = r"[#\[(),0-9\x00-\x20]"

# Entries whose brackets are balanced and nest at most three deep are split by one regular expression.
_FLAT = r"[^()\[\]]++"
_DEPTH_1 = rf"(?:{_FLAT}|\((?:{_FLAT})?\)|\[(?:{_FLAT})?\])"
_DEPTH_2 = rf"(?:{_FLAT}|\({_DEPTH_1}*\)|\[{_DEPTH_1}*\])"
_DEPTH_3 = rf"(?:{_FLAT}|\({_DEPTH_2}*\)|\[{_DEPTH_2}*\])"
_SIMPLE_LIST = rf"^{_DEPTH_3}*\]"
_SIMPLE_ENTRY = rf"((?:[^,()\[\]]++|\({_DEPTH_2}*\)|\[{_DEPTH_2}*\])+)"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _tidy(entries: Column) -> Column:
    """Entries trimmed, empties dropped, in text order, joined again."""
    trimmed = F.transform(entries, _trim)
    return F.array_join(F.array_sort(F.filter(trimmed, lambda e: e != "")), ", ")


def _walk(tail: Column) -> Column:
    """Character walk for lists the regular expression cannot describe: where it ends, where to cut."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(1).alias("square"), F.lit(0).alias("round"),
        F.lit(0).alias("end"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, char: Column) -> Column:
        at = state["at"] + 1
        open_ = state["end"] == 0
        square = state["square"] + F.when(char == "[", 1).when(char == "]", -1).otherwise(0)
        round_ = F.greatest(F.lit(0), state["round"] + F.when(char == "(", 1).when(char == ")", -1).otherwise(0))
        cut = open_ & (char == ",") & (state["square"] == 1) & (state["round"] == 0)
        return F.struct(
            at.alias("at"),
            F.when(open_, square).otherwise(state["square"]).alias("square"),
            F.when(open_, round_).otherwise(state["round"]).alias("round"),
            F.when(open_ & (square == 0), at).otherwise(state["end"]).alias("end"),
            F.when(cut, F.concat(state["cuts"], F.array(at))).otherwise(state["cuts"]).alias("cuts"))

    return F.aggregate(F.split(tail, ""), start, step)


def sort_pushed_filters(text: Column) -> Column:
    """Order the entries of the first ``PushedFilters: [..]`` list; an unclosed list is left alone."""

    def split(tail: Column) -> Column:
        head = F.substr(text, F.lit(1), F.length(text) - F.length(tail))

        def simple(matched: Column) -> Column:
            entries = F.regexp_extract_all(
                F.substr(matched, F.lit(1), F.length(matched) - 1), F.lit(_SIMPLE_ENTRY), F.lit(1))
            return F.when(matched == "", _bind(_walk(tail), walked)).otherwise(
                F.concat(head, _tidy(entries), F.substr(tail, F.length(matched))))

        def walked(state: Column) -> Column:
            body = F.substr(tail, F.lit(1), state["end"] - 1)
            bounds = F.concat(F.array(F.lit(0)), state["cuts"], F.array(state["end"]))
            entries = F.transform(
                F.sequence(F.lit(1), F.size(bounds) - 1),
                lambda i: F.substr(body, F.element_at(bounds, i) + 1,
                                   F.element_at(bounds, i + 1) - F.element_at(bounds, i) - 1))
            return F.when(state["end"] == 0, text).otherwise(
                F.concat(head, _tidy(entries), F.substr(tail, state["end"])))

        return _bind(F.regexp_extract(tail, _SIMPLE_LIST, 0), simple)

    after = F.substr(text, F.instr(text, FILTER_LABEL) + len(FILTER_LABEL))
    return F.when(text.contains(FILTER_LABEL), _bind(after, split)).otherwise(text)


def _rewritten(rewrite: tuple[str, str, str], text: Column) -> Column:
    marker, pattern, replacement = rewrite
    return F.when(text.contains(marker), F.regexp_replace(text, pattern, replacement)).otherwise(text)


def normalize_plan_text(text: Column) -> Column:
    value = sort_pushed_filters(text)
    for rewrite in REWRITES:
        value = _bind(value, partial(_rewritten, rewrite))

    def tidy_spacing(v: Column) -> Column:
        spaced = v
        for pattern, replacement in SPACING:
            spaced = F.regexp_replace(spaced, pattern, replacement)
        spaced = F.regexp_replace(_trim(spaced), r"\s+", " ")
        return F.when(v.rlike(_SPACED), spaced).otherwise(_trim(v))

    return (
        F.when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), F.lit(""))
        .when(~text.rlike(_TOUCHED), text)
        .otherwise(_bind(value, tidy_spacing))
    )
