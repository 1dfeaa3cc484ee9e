"""Column functions for titles, bodies, tags and vectors; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def strings() -> Column:
    return F.array().cast(NO_STRINGS)


def plain(text: Column) -> Column:
    """The words of a text with one blank between each two; null gives an empty text."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives none."""
    return F.when(plain(text) == "", strings()).otherwise(F.split(plain(text), " ", -1))


def trigrams(text: Column) -> Column:
    """The set of 3-grams of each word with two blanks before and one after it."""
    grams = F.transform(words(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """|a and b| / |a or b| of two sets; two empty sets give ``both_empty``, one gives 0."""

    def body(p: Column) -> Column:
        both, either = F.size(F.array_intersect(p["a"], p["b"])), F.size(F.array_union(p["a"], p["b"]))
        return F.when(either == 0, F.lit(both_empty)).otherwise(both / either)

    return let(F.struct(F.coalesce(a, strings()).alias("a"), F.coalesce(b, strings()).alias("b")), body)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def normal_title(title: Column) -> Column:
    """Lower case, with runs of white space and control characters as one blank, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(title), r"[\s\p{Cntrl}]+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - F.levenshtein(a, b)) / longer)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for different lengths and for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.95, "exact").when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")


def contains_ci(text: Column, needle: str) -> Column:
    r"""Case-insensitive containment; ``\``, ``%`` and ``_`` in the needle are plain characters."""
    for c in "\\%_":
        needle = needle.replace(c, "\\" + c)
    return text.ilike(f"%{needle}%")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def outside(values: Column, vocabulary: list[str]) -> Column:
    """The values that a closed vocabulary lacks; null has none."""
    return F.array_except(F.coalesce(values, strings()), F.array(*[F.lit(v) for v in vocabulary]))


def folded(values: Column, aliases: dict[str, str]) -> Column:
    """Values mapped by their trimmed lower-case form, the first of equal ones kept, in order."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.array_distinct(F.transform(values, lambda v: F.coalesce(F.element_at(table, F.lower(F.btrim(v))), v)))


def with_parents(values: Column, parents: dict[str, str]) -> Column:
    """Values followed by the parents of any of them that are missing."""
    table = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    found = F.filter(F.transform(values, lambda v: F.element_at(table, v)), lambda p: p.isNotNull())
    return F.concat(values, F.array_except(found, values))


def json_strings(value: Column) -> Column:
    """A JSON array of strings as an array; null and ``null`` give none; a scalar is one value."""
    listed = F.from_json(value, NO_STRINGS)
    bare = F.regexp_replace(F.btrim(value), '^"|"$', "")
    return F.when(value.isNull() | (F.btrim(value) == "null"), strings()).when(F.btrim(value).startswith("["), F.coalesce(listed, strings())).otherwise(F.array(bare))


def index_percentile(values: Column, share: float) -> Column:
    """Element number floor(n * share), at most the last, of the sorted values."""
    return let(F.sort_array(values), lambda v: F.get(v, F.least(F.floor(F.size(v) * F.lit(share)).cast("int"), F.size(v) - 1)))


def nearest_rank(values: Column, share: float) -> Column:
    """Element number ceil(n * share) - 1, at least the first, of the sorted values."""
    return let(F.sort_array(values), lambda v: F.get(v, F.greatest(F.ceil(F.size(v) * F.lit(share)).cast("int") - 1, F.lit(0))))


def labelled(parts: list[tuple[Column, Column]]) -> Column:
    """``label: value`` of the parts that have a value, one a line."""
    return F.concat_ws("\n", *[F.when(F.btrim(v) != "", F.concat(n, F.lit(": "), v)) for n, v in parts])


def set_diff(old: Column, new: Column) -> Column:
    """Struct of adds, drops and casing: values of one set alone, and those that differ in case only."""

    def lowered(values: Column) -> Column:
        return F.transform(values, F.lower)

    def body(p: Column) -> Column:
        extra, gone = F.array_except(p["n"], p["o"]), F.array_except(p["o"], p["n"])
        known = lambda values, v: F.array_contains(lowered(values), F.lower(v))
        return F.struct(
            F.filter(extra, lambda v: ~known(p["o"], v)).alias("adds"), F.filter(gone, lambda v: ~known(p["n"], v)).alias("drops"),
            F.filter(extra, lambda v: known(p["o"], v)).alias("casing"),
        )

    return let(F.struct(old.alias("o"), new.alias("n")), body)


def changed_keys(old: Column, new: Column) -> Column:
    """Sorted keys of two maps whose values differ or that only one of them has."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))


def parsed_date(raw: Column) -> Column:
    """A date written month/day/year or in ISO order, else null."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit("M/d/yyyy")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).cast("date")
