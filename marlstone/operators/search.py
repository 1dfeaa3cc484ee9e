"""Faceted full-text search: query expansion, strict and relaxed matching, ranking, paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.plans.scratch import small, written

# Words that no query group is made of, and the weights of the text sections.
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with".split())
SECTION_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Fewer strict results than this relax the query to any of its groups.
ENOUGH = 10
FUZZY = 0.3


@dataclass
class Request:
    """A search: words, wanted values by facet column (empty: no filter), order and page."""

    query: str = ""
    facets: dict[str, Sequence[str]] = field(default_factory=dict)
    order: str = "relevance"
    size: int = 20
    offset: int = 0


def expand(query: str, synonyms: Sequence[tuple[str, Sequence[str], str]] = ()) -> list[list[list[str]]]:
    """Groups of alternatives, each a list of words that must all occur.

    A word brings its synonyms if it is their term; if it is one of the synonyms of a
    ``bidirectional`` entry, also the term and the other synonyms. Stop words make no group.
    """
    for c in "&|!():*<>'\"":
        query = query.replace(c, " ")
    groups = []
    for word in query.lower().split():
        if word in STOP_WORDS:
            continue
        found = [word]
        for term, others, kind in synonyms:
            if term == word:
                found += others
            elif kind == "bidirectional" and word in others:
                found += [*others, term]
        groups.append([x.lower().split() for x in dict.fromkeys(found)])
    return groups


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Rows (id, texts ...) with one row an id: the texts of a repeated id are put together.

    Only ids are counted by a shuffle, and only rows of repeated ids are grouped.
    """
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("again"))
    again = written(again)
    if again.isEmpty():
        return rows
    same, again = F.col("id").eqNullSafe(F.col("again")), small(again)
    texts = [F.concat_ws(" ", F.collect_list(c)).alias(c) for c in rows.columns if c != "id"]
    return rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").groupBy("id").agg(*texts).select(rows.columns))


def postings(items: DataFrame, id_col: str, sections: dict[str, Column]) -> DataFrame:
    """(id, word, weight): the heaviest section that each word of an item occurs in. Words are told apart within their row; none is shuffled."""
    names = sorted(sections, key=lambda s: -SECTION_WEIGHTS[s])
    rows = one_row_an_id(items.select(F.col(id_col).alias("id"), *[sections[s].alias(s) for s in names]))
    rows = rows.select("id", *[T.words(F.col(s)).alias(s) for s in names])
    parts = []
    for k, name in enumerate(names):
        heavier = F.concat(T.strings(), *[F.col(s) for s in names[:k]])
        parts.append(F.struct(F.array_except(F.col(name), heavier).alias("words"), F.lit(SECTION_WEIGHTS[name]).alias("weight")))
    return rows.select("id", F.inline(F.array(*parts))).select("id", F.explode("words").alias("word"), "weight")


def _scores(groups: list[list[list[str]]], weight) -> Column:
    """(hits, score): how many groups match, and the sum of their best alternatives' weights.

    ``weight`` gives a word's weight, or null where it doesn't occur. An alternative matches if
    all of its words occur, and weighs as much as the lightest of them.
    """

    def best(group: list[list[str]]) -> Column:
        alternatives = []
        for alt in group:
            values = [weight(x) for x in alt]
            whole = values[0].isNotNull()
            for v in values[1:]:
                whole = whole & v.isNotNull()
            alternatives.append(F.when(whole, F.least(*values) if len(values) > 1 else values[0]).otherwise(F.lit(0.0)))
        return F.greatest(*alternatives) if len(alternatives) > 1 else alternatives[0]

    def body(scores: Column) -> Column:
        return F.struct(F.size(F.filter(scores, lambda x: x > 0)).alias("hits"), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x).alias("score"))

    return T.let(F.array(*[best(g) for g in groups]), body)


def wanted_words(groups: list[list[list[str]]]) -> list[str]:
    return sorted({w for g in groups for alt in g for w in alt})


def matched(posts: DataFrame, groups: list[list[list[str]]]) -> DataFrame:
    """(id, hits, score) of the items of an index that match a group.

    The query's words are a literal array in the filter, so the postings are scanned once and
    only their matching rows are shuffled. Strict matching is hits = number of groups.
    """
    own = posts.filter(F.col("word").isin(wanted_words(groups))).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("w"))
    return own.select("id", _scores(groups, lambda x: F.try_element_at("w", F.lit(x))).alias("m")).select("id", "m.hits", "m.score").filter("hits > 0")


def row_scores(sections: dict[str, Column], groups: list[list[list[str]]]) -> Column:
    """(hits, score) of a row without an index: its texts are cut into words once, nothing is shuffled."""
    wanted = F.array(*[F.lit(w) for w in wanted_words(groups)])
    names = sorted(sections, key=lambda s: -SECTION_WEIGHTS[s])
    held = F.struct(*[F.array_intersect(T.words(sections[s]), wanted).alias(s) for s in names])

    def body(p: Column) -> Column:
        def weight(word: str) -> Column:
            out = F.lit(None).cast("double")
            for s in reversed(names):
                out = F.when(F.array_contains(p[s], word), F.lit(SECTION_WEIGHTS[s])).otherwise(out)
            return out

        return _scores(groups, weight)

    return T.let(held, body)


def facet_filter(request: Request) -> list[Column]:
    """One overlap test per facet with wanted values; a null facet never matches."""
    return [F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values])) for c, values in request.facets.items() if values]


#: What a summary's similarity counts beside a title's.
SUMMARY = 0.8


def search(
    items: DataFrame, request: Request, id_col: str, title: str, sections: dict[str, Column], synonyms=(), live: Column | None = None,
    summary: str | None = None, rules: dict[str, tuple[list[list[list[str]]], Sequence[str]]] | None = None,
) -> DataFrame:
    """A page of (id, title, rank, total): matches of the query within the facets.

    All groups must match, or the title be similar by trigrams; if fewer than ENOUGH items
    are left, any group will do. The rank is the largest of the text score, the title's
    similarity and SUMMARY times that of the ``summary`` column; ties end with title and id. A
    query that is a phrase of ``rules`` looks for the groups of its rule in the sections of its
    rule instead, and neither titles nor a relaxed match add to them. A page past the end has no rows. The items are
    scanned once: what matches at all is written, and the counts and the page read that.
    """
    held = items
    for test in [*facet_filter(request), *([live] if live is not None else [])]:
        held = held.filter(test)
    rule = (rules or {}).get(" ".join(request.query.lower().split()))
    groups = rule[0] if rule else expand(request.query, synonyms)
    if rule:
        sections = {s: sections[s] for s in rule[1]}
    if groups:
        alike = T.trigram_similarity(F.col(title), F.lit(request.query))
        scored = held.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.coalesce(alike, F.lit(0.0)).alias("alike"), row_scores(sections, groups).alias("m"),
            *([F.lit(SUMMARY) * F.coalesce(T.trigram_similarity(F.col(summary), F.lit(request.query)), F.lit(0.0))] if summary else [F.lit(0.0)]))
        scored = scored.toDF("id", "title", "alike", "m", "told")
        near = F.lit(False) if rule else F.col("alike") >= FUZZY
        scored = written(scored.select("id", "title", "alike", "told", "m.hits", "m.score").filter((F.col("hits") > 0) | near))
        return page_of(scored, len(groups), request, rule is not None)
    return page_of_ranked(held.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.lit(0.0).alias("rank")), request)


def page_of(scored: DataFrame, n_groups: int, request: Request, strict_only: bool = False) -> DataFrame:
    """The page of all matches (id, title, alike, told, hits, score): strict ones, or any if these are fewer than ENOUGH."""
    strict = scored.filter(F.col("hits") == n_groups) if strict_only else scored.filter((F.col("hits") == n_groups) | (F.col("alike") >= FUZZY))
    found = strict if strict_only or strict.limit(ENOUGH).count() == ENOUGH else scored
    return page_of_ranked(found.select("id", "title", F.greatest("score", "alike", "told").alias("rank")), request)


def page_of_ranked(ranked: DataFrame, request: Request) -> DataFrame:
    keys = {"title": []}.get(request.order, [F.col("rank").desc()])
    total = ranked.count()
    return ranked.withColumn("total", F.lit(total).cast("long")).orderBy(*keys, "title", "id").offset(request.offset).limit(request.size)


def prefix_terms(query: str) -> list[str]:
    """The words of a query as prefixes; one of more than four letters that ends in s loses it."""
    return list(dict.fromkeys(w[:-1] if len(w) > 4 and w.endswith("s") else w for w in query.lower().split()))


#: Words that are suggested for a query without results.
SUGGESTED = 5


def suggestions(query: str, synonyms: Sequence[tuple[str, Sequence[str], str]] = ()) -> list[str]:
    """The first words that a query without results suggests: its words, their synonyms, and other endings of words of more than four letters."""
    found: list[str] = []
    for word in query.lower().split():
        found.append(word)
        for term, others, kind in synonyms:
            if term.lower() == word:
                found += [o.lower() for o in others]
        for term, others, kind in synonyms:
            if kind == "bidirectional" and word in (o.lower() for o in others):
                found += [term.lower(), *(o.lower() for o in others)]
        if len(word) > 4:
            found += [word[:-1], word + "s"]
    return list(dict.fromkeys(found))[:SUGGESTED]


def page_or_suggestions(page: DataFrame, query: str, synonyms: Sequence[tuple[str, Sequence[str], str]] = ()) -> DataFrame:
    """The rows (id, title, ...) of a page with a null suggestion, or a row a suggestion if the page has none."""
    words = suggestions(query, synonyms)
    empty = page.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.explode(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")).alias("suggestion"))
    rows = page.select("id", "title", F.lit(None).cast("string").alias("suggestion"))
    return rows.unionByName(empty, allowMissingColumns=True)
