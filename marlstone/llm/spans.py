"""Regex spans with code-point positions, from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,s:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def placed(gaps: Column, found: Column) -> Column:
    """Spans of the strings ``found`` that stand between the strings ``gaps`` of a split text."""
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, zero, add, lambda a: a["out"])


def matches(text: Column, pattern: str, need: str | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, as an array of (start, end, s).

    The text is cut at the matches, so the lengths of the pieces give the positions. A text
    without a match costs one scan, or a quicker one if each match contains the string ``need``.
    ``pattern`` must not match the empty string.
    """
    test = text.rlike(pattern) if need is None else text.contains(need) & text.rlike(pattern)
    return F.when(test, placed(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(no_spans())


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """The spans as (start, rank, kind, end), which sorts by start and then by kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined with commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
