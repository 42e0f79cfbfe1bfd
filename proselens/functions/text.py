"""Characters, spans and excerpts as Column expressions. A span is struct<s int, e int> in characters, e exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The counted characters: iteration marks, hiragana, katakana, unified ideographs.
JA = r"\x{3005}\x{3006}\x{3041}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}"
#: Unicode White_Space; Spark's own trim knows U+0020 only.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TERMINATORS = "。！？"
EXCERPT = 40
SPANS = "array<struct<s:int,e:int>>"


_KEPT: dict = {}


def kept(name: str, lists, make: Callable):
    """make(), built once a name and word lists: thousands of calls to the JVM go into the rules' expressions, and they hold no data."""
    import json

    from pyspark import SparkContext

    key = (SparkContext._gateway, name, json.dumps(lists, sort_keys=True, ensure_ascii=False))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def has_japanese(text: Column) -> Column:
    return text.rlike(f"[{JA}]")


def ja_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{JA}]", ""))


def is_terminated(text: Column) -> Column:
    return F.coalesce(F.right(text, F.lit(1)).isin(*TERMINATORS), F.lit(False))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def cut(text: Column, x: Column) -> Column:
    return F.substring(text, x["s"] + 1, x["e"] - x["s"])


def excerpt(text: Column, x: Column) -> Column:
    """A span's text, runs of spaces as one, at most forty characters."""
    return F.left(F.regexp_replace(cut(text, x), " +", " "), F.lit(EXCERPT))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and standing once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk(text: Column, phrase: Column) -> Column:
    """The spans of a phrase from left to right, none over another: what splitting at it leaves gives their places."""
    parts, n = F.split(text, F.concat(F.lit("\\Q"), phrase, F.lit("\\E")), F.lit(-1)), F.char_length(phrase)
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(acc: Column, part: Column) -> Column:
        s = acc["at"] + F.char_length(part)
        return F.struct((s + n).alias("at"), F.concat(acc["found"], F.array(span(s, s + n))).alias("found"))

    return let(parts, lambda ps: F.aggregate(F.slice(ps, F.lit(1), F.size(ps) - 1), start, step)["found"])


def occurrences(text: Column, phrase: str) -> Column:
    return any_occurrence(text, [phrase])


def any_occurrence(text: Column, phrases: Iterable[str]) -> Column:
    """All phrases' spans; one pass of an alternation spares texts that have none."""
    phrases = [p for p in phrases if p]
    if not phrases:
        return no_spans()
    every = F.flatten(F.transform(F.array(*map(F.lit, phrases)), lambda p: F.when(F.contains(text, p), _walk(text, p)).otherwise(no_spans())))
    return F.when(text.rlike("|".join(map(re.escape, phrases))), every).otherwise(no_spans())


def disjoint(spans: Column) -> Column:
    """By start, the longest first; each that begins before the last kept one ends is dropped."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"))))
    start = F.struct(F.lit(0).alias("end"), no_spans().alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["end"] <= x["s"]
        return F.struct(F.when(ok, -x["back"]).otherwise(acc["end"]).cast("int").alias("end"), F.when(ok, F.concat(acc["kept"], F.array(span(x["s"], -x["back"])))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(order, start, step)["kept"]


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))


def widened(text: Column, x: Column, by: int) -> Column:
    return span(F.greatest(x["s"] - by, F.lit(0)), F.least(x["e"] + by, F.char_length(text)))


def touches(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two inclusive ranges have a line in common."""
    return (start <= other_end) & (other_start <= end)
