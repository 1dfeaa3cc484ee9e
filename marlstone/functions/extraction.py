"""What plain text says of levels, seasons and activities, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import let, strings

_LEVEL = r"(?:pre-?k|pk|kindergarten|k|[0-9]{1,2})(?:st|nd|rd|th)?"
_JOIN = r"\s*(?:,\s*and|,\s*or|,|&|/|and|or|to|through|-|–)\s*"
_LIST = rf"{_LEVEL}(?:{_JOIN}{_LEVEL})*"


def levels(text: Column, vocabulary: Sequence[str]) -> Column:
    """The levels of the ordered ``vocabulary`` that a text names beside the word grade(s) or level(s), in its order.

    Lists (``grades 1, 2 and 4``), ranges (``grades K-2``, ``2nd through 4th grade``) and ordinals count; a
    range runs along the vocabulary, and one that runs backwards or has an end that isn't in it names its ends only. Numbers
    without the word don't count. Null and empty texts name none.
    """
    plain = F.lower(F.coalesce(text, F.lit("")))
    after = F.regexp_extract_all(plain, F.lit(rf"\b(?:grades?|levels?)\s+({_LIST})\b"), 1)
    before = F.regexp_extract_all(plain, F.lit(rf"\b({_LIST})[\s-]+(?:grades?|graders?)\b"), 1)
    known = F.array(*[F.lit(v) for v in vocabulary])
    lowered = F.array(*[F.lit(v.lower()) for v in vocabulary])

    def name(token: Column) -> Column:
        bare = F.regexp_replace(F.btrim(token), "(?<=[0-9])(st|nd|rd|th)$", "")
        return F.when(bare.rlike("^pre-?k$"), "pk").when(bare == "kindergarten", "k").otherwise(bare)

    def part(p: Column) -> Column:
        def between(ends: Column) -> Column:
            first, last = F.array_position(lowered, ends[0]), F.array_position(lowered, F.element_at(ends, -1))
            one = F.filter(F.array(first, last), lambda at: at > 0)
            whole = F.when((first > 0) & (last >= first), F.sequence(first, last)).otherwise(one)
            return F.transform(whole, lambda at: F.element_at(known, at.cast("int")))

        return let(F.transform(F.split(p, "~"), name), between)

    def parts(found: Column) -> Column:
        # pre-k keeps its hyphen; every other hyphen or word between two ends is a range
        ranged = F.regexp_replace(F.regexp_replace(found, "pre-k", "pk"), r"\s*(?:\bto\b|\bthrough\b|-|–)\s*", "~")
        listed = F.regexp_replace(ranged, r"\s*(?:,\s*and\b|,\s*or\b|,|&|/|\band\b|\bor\b)\s*", ",")
        return F.flatten(F.transform(F.split(listed, ","), part))

    named = F.flatten(F.transform(F.concat(after, before), parts))
    return F.array_intersect(known, named)


def phrases(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """The names whose phrases a text has as whole words in any case, in the order of ``patterns``."""
    plain = F.coalesce(text, F.lit(""))
    found = [F.when(plain.rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), F.lit(name)) for name, words in patterns.items()]
    return F.array_compact(F.array(*found)) if found else strings()


def frequent(text: Column, words: Mapping[str, Sequence[str]], least: int = 3) -> Column:
    """The names whose words occur ``least`` times or more altogether, in any case and as whole words."""
    plain = F.coalesce(text, F.lit(""))
    found = [F.when(F.regexp_count(plain, F.lit(rf"(?i)\b(?:{'|'.join(w)})\b")) >= least, F.lit(name)) for name, w in words.items()]
    return F.array_compact(F.array(*found)) if found else strings()
