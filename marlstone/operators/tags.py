"""Tag normalisation against closed vocabularies, as column functions of tag arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.filters import strings_lit


def without_generic(values: Column, generic: str, specific: Sequence[str]) -> Column:
    """The generic value goes if a specific one is there."""
    return F.when(F.arrays_overlap(values, strings_lit(specific)), F.array_remove(values, generic)).otherwise(values)


def implied(values: Column, rules: dict[str, str]) -> Column:
    """Values followed by what each implies, if missing."""
    return T.with_parents(values, rules)


def both_of(values: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The pairs of synonyms of which a row has both, as ``a+b``."""
    found = [F.when(F.array_contains(values, a) & F.array_contains(values, b), F.lit(f"{a}+{b}")) for a, b in pairs]
    return F.array_compact(F.array(*found))


def floor(values: Column, drops: Sequence[str], aliases: dict[str, str], vocabulary: Sequence[str]) -> Column:
    """Array of (value, origin) in the order of first sight: drops go, aliases fold, junk goes.

    Origin is ``exact`` if any of the value's sources was it, else ``alias``.
    """
    kept = F.filter(values, lambda v: ~v.isin(list(drops)))
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    pairs = F.transform(kept, lambda v: F.struct(F.coalesce(F.try_element_at(table, F.lower(F.btrim(v))), v).alias("value"), v.alias("from")))
    good = F.filter(pairs, lambda p: p["value"].isin(list(vocabulary)))
    names = F.array_distinct(F.transform(good, lambda p: p["value"]))
    return F.transform(names, lambda n: F.struct(n.alias("value"), F.when(F.array_contains(values, n), "exact").otherwise("alias").alias("origin")))


def reconcile(current: Column, drop: Column, add: Column, locked: Sequence[str]) -> Column:
    """Current values without the drops, followed by the adds that aren't locked; what is named nowhere stays."""
    new = F.array_except(F.filter(add, lambda v: ~v.isin(list(locked))), drop)
    return F.array_distinct(F.concat(F.array_except(current, drop), new))


def title_case(slug: Column) -> Column:
    """``some-slug`` as ``Some Slug``."""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


# What seasons are called.
SEASONS = {"fall": ("Fall",), "autumn": ("Fall",), "winter": ("Winter",), "spring": ("Spring",), "summer": ("Summer",), } | dict.fromkeys(("year-round", "all year", "all-year"), ("Fall", "Winter", "Spring", "Summer"))


def seasons(values: Column) -> Column:
    """Season names, one spelling each; year-round is all four; others go."""
    table = F.create_map(*[x for k, v in SEASONS.items() for x in (F.lit(k), strings_lit(v))])
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.coalesce(F.try_element_at(table, F.lower(F.btrim(v))), T.strings()))))


def plural_or_singular(plural: Column, singular: Column) -> Column:
    """The plural key's array unless it is null or empty, then the singular key's."""
    return F.when(F.size(plural) > 0, plural).otherwise(F.coalesce(singular, T.strings()))


def synced(columns: dict[str, Column], stored: Column) -> Column:
    """A map of arrays in step with columns: a non-null column wins, else the stored entry stays."""
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*columns.values()))
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k)), new)


def shipped(floor: Column, model: Column, vocabulary: list[str], locked: list[str]) -> Column:
    """The values of the floor, then those of the model that are in the vocabulary and not locked, each once, in order.

    A locked value is there only if the floor has it. Null sets are empty.
    """
    none = F.array().cast("array<string>")
    known = F.array(*[F.lit(v) for v in vocabulary if v not in locked])
    return F.array_distinct(F.concat(F.coalesce(floor, none), F.filter(F.coalesce(model, none), lambda v: F.array_contains(known, v))))


def with_subjects(integration: Column, concepts: Column) -> Column:
    """The array ``integration`` followed by the keys of the map ``concepts`` that it lacks and whose list isn't empty; null stays null."""
    filled = F.map_keys(F.map_filter(concepts, lambda _, v: F.coalesce(F.size(v), F.lit(0)) > 0))
    return F.when(concepts.isNull(), integration).otherwise(F.concat(integration, F.array_except(filled, integration)))
