"""From what a person types to a search request: filler words go, school levels become a filter."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from marlstone.operators.search import Request

# Levels in their order, how they are written, and words that carry no meaning in a query.
LEVELS = ("3K", "PK", "K", "1", "2", "3", "4", "5", "6", "7", "8")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth")
SHORT_ORDINALS = ("1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight")
FILLERS = frozenset({"lesson", "lessons", "for", "about", "a", "an", "the"})

_NAMES = {x: str(k + 1) for names in (ORDINALS, SHORT_ORDINALS, NUMBERS) for k, x in enumerate(names)} | {x.lower(): x for x in LEVELS}
_EDGE = r"[^a-z0-9\s]*"
_ANY, _NTH = "|".join(sorted(_NAMES, key=len, reverse=True)), "|".join((*ORDINALS, *SHORT_ORDINALS))
_GAP = rf"{_EDGE}\s+{_EDGE}"
#: A level with an explicit cue; a bare number is none. A second level makes a range.
_CUE = re.compile(
    rf"(?<!\S){_EDGE}(?:(?P<kinder>kindergarten)|(?P<before>pre-?k(?:indergarten)?)|(?P<three>3k)|(?P<nth>{_NTH}){_GAP}grade(?:s|rs?)?"
    rf"|grades?{_GAP}(?P<low>{_ANY})(?:(?:-|{_GAP}(?:to|through|thru){_GAP}|{_EDGE}\s+[-–]+\s+{_EDGE})(?P<high>{_ANY}))?){_EDGE}(?!\S)",
    re.IGNORECASE,
)


def parsed(query: str | None) -> tuple[str, list[str]]:
    """(the query without fillers and level cues, the levels in order).

    A query of fillers alone stays as it is; one of levels alone becomes empty.
    """
    plain = " ".join((query or "").split())
    found: set[str] = set()
    for m in _CUE.finditer(plain):
        if m["kinder"] or m["before"] or m["three"]:
            found.add("K" if m["kinder"] else "PK" if m["before"] else "3K")
        elif m["nth"]:
            found.add(_NAMES[m["nth"].lower()])
        else:
            low = LEVELS.index(_NAMES[m["low"].lower()])
            high = LEVELS.index(_NAMES[m["high"].lower()]) if m["high"] else low
            found.update(LEVELS[min(low, high) : max(low, high) + 1])
    words = [w for w in _CUE.sub(" ", plain).split() if re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w.lower()) not in FILLERS]
    return " ".join(words) if words or found else plain, [x for x in LEVELS if x in found]


def request_of(query: str | None, facets: Mapping[str, Sequence[str]], levels: str, **rest) -> Request:
    """The request of a typed query; levels that were chosen by hand beat those that the words name."""
    words, found = parsed(query)
    chosen = dict(facets)
    if not chosen.get(levels):
        chosen[levels] = found
    return Request(words, chosen, **rest)
