"""Row tests and filter lists of the catalogue; lists are expanded on the driver, rows only compared."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a wanted place or cooking method also matches, in lower case.
PLACES = {"indoor": ("indoor", "both"), "outdoor": ("outdoor", "both"), "both": ("both",)}
METHODS = {"basic prep only": ("basic prep only", "basic-prep", "basic prep")}
ROLES = ("user", "assistant", "system")


def with_aliases(wanted: Iterable[str], table: dict[str, Sequence[str]], fold: bool = False) -> list[str]:
    """Wanted values with the spellings that the table gives for them; others pass through."""
    out = []
    for w in wanted:
        key = w.lower() if fold else w
        out += table.get(key, (key,))
    return list(dict.fromkeys(out))


def strings_lit(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def any_of(column: Column, wanted: Sequence[str], fold: bool = False) -> Column:
    """Whether an array shares a value with the wanted; nothing wanted is no filter, null never matches."""
    if not wanted:
        return F.lit(True)
    values = F.transform(column, F.lower) if fold else column
    return F.coalesce(F.arrays_overlap(values, strings_lit(wanted)), F.lit(False))


def groups_test(groups: Sequence[Sequence[Column]]) -> Column:
    """All groups hold; a group holds if one of its tests does. Null counts as false."""
    out = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for test in group:
            one = one | F.coalesce(test, F.lit(False))
        out = out & one
    return out


def rank_of(role: Column, ladder: Sequence[str]) -> Column:
    """Place of a role in the ladder from 1; unknown roles get 0."""
    return F.coalesce(F.array_position(strings_lit(ladder), role), F.lit(0)).cast("int")


def safe_name(name: Column) -> Column:
    """Whether a name is trimmed, 1 to 120 characters, and without controls, @ and addresses."""
    ok = (F.btrim(name) == name) & F.length(name).between(1, 120) & ~name.rlike(r"\p{Cntrl}|@|(?i:https?:|www\.)")
    return F.coalesce(ok, F.lit(False))


def overlay(old: Column, new: Column) -> Column:
    """A map of arrays with the non-empty entries of ``new`` in place of those of ``old``; nulls are dropped."""
    kept = F.map_filter(new, lambda _, v: F.size(v) > 0)
    rest = F.map_filter(old, lambda k, v: v.isNotNull() & ~F.map_contains_key(kept, k))
    return F.map_concat(rest, kept)
