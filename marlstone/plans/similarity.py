"""Text and vector similarity, and the duplicate pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import duplicates as D
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.joins import KEYS, SPACE, blocked_pairs
from marlstone.plans.scratch import written
from marlstone.sources.tables import table

@query("t11_trigram_sets", f"WITH {V.PAGES} SELECT id, len({V.trigrams_sql('title')}) AS n, md5(array_to_string(list_sort({V.trigrams_sql('title')}), ',')) AS digest FROM titled")
def t11_trigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of trigrams of each title."""
    g = F.array_sort(T.trigrams(F.col("title")))
    return V.titled_pages(spark, sf_dir).select("id", F.size(g).cast("long").alias("n"), F.md5(F.array_join(g, ",")).alias("digest"))


@query("t13_normal_titles", f"WITH {V.PAGES} SELECT id, trim(regexp_replace(lower(title), '[\\s\\p{{Cc}}]+', ' ', 'g')) AS title FROM titled")
def t13_normal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.titled_pages(spark, sf_dir).select("id", T.normal_title(F.col("title")).alias("title"))


@query(
    "t14_word_overlap",
    f"WITH {V.ITEMS}, w AS (SELECT id, title, list_distinct({V.words_sql('title')}) AS g, ['red', 'widget', 'old'] AS h FROM items) SELECT id, round({V.jaccard_sql('g', 'h')}, 6) AS sim, contains('red widget old', title) AS within FROM w WHERE {V.jaccard_sql('g', 'h')} >= 0.3 OR contains('red widget old', title)",
)
def t14_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that share words with a given one, or are part of it."""
    given = F.lit("red widget old")
    i = V.items(spark, sf_dir).select("id", T.word_jaccard(F.col("title"), given).alias("s"), given.contains(F.col("title")).alias("within"))
    return i.filter("s >= 0.3 OR within").select("id", F.round("s", 6).alias("sim"), "within")


@query("t16_edit_ratio", "SELECT p_partkey AS id, round(CASE WHEN greatest(length(p_name), 10) = 0 THEN 1.0 ELSE (greatest(length(p_name), 10) - levenshtein(p_name, 'red widget')) / greatest(length(p_name), 10) END, 6) AS ratio FROM part")
def t16_edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(T.edit_ratio(F.col("p_name"), F.lit("red widget")), 6).alias("ratio"))


@query("t19_content_hash", f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN sha256(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))) ELSE 'META_' || sha256(concat_ws('|', lang, source)) END AS hash FROM documents")
def t19_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a body, or of its metadata if there is none."""
    meta = F.concat(F.lit("META_"), F.sha2(F.concat_ws("|", "lang", "source"), 256))
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.trim(F.coalesce(t, F.lit(""))) != "", T.content_hash(t)).otherwise(meta).alias("hash"))


#: Seven sets of an item, as Spark and as SQL expressions, what they are compared with, and their weights.
OVERLAPS = [
    ("tags", "coalesce(tags, [])", ["red", "ring"], 0.25), ("kinds", "kinds", ["SMALL"], 0.2), ("brands", "brands", ["Brand#2"], 0.15),
    ("split(kinds[0], ' ')", "string_split(kinds[1], ' ')", ["SMALL", "STEEL"], 0.15), ("array(cast(size div 10 AS STRING))", "[(size // 10)::VARCHAR]", ["1"], 0.1),
    ("slice(coalesce(tags, cast(array() AS array<string>)), 1, 1)", "coalesce(tags, [])[1:1]", ["red"], 0.1), ("array(cast(cast(floor(price / 500) AS INT) AS STRING))", "[floor(price / 500)::INT::VARCHAR]", ["2"], 0.05),
]
_GIVEN = ["[" + ", ".join(f"'{v}'" for v in given) + "]" for _, _, given, _ in OVERLAPS]
_PARTS = " + ".join(f"{w} * {V.jaccard_sql(sql, given, 1.0)}" for (_, sql, _, w), given in zip(OVERLAPS, _GIVEN, strict=True))


@query("t20_tag_overlap", f"WITH {V.ITEMS} SELECT id, round(({_PARTS}) / {sum(o[3] for o in OVERLAPS)!r}, 6)::DOUBLE AS overlap FROM items")
def t20_tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overlap of seven sets of an item with given ones; two empty sets agree, one empty set doesn't."""
    pairs = [(F.expr(name), F.array(*[F.lit(v) for v in given]), w) for name, _, given, w in OVERLAPS]
    return V.items(spark, sf_dir).select("id", F.round(D.weighted_overlap(pairs), 6).alias("overlap"))


@query(
    "t22_extraction",
    "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, array_to_string(regexp_extract_all(url, '([0-9]+)', 1), ',') AS numbers, regexp_matches(html, '(?i)script') AS has_script FROM pages",
)
def t22_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata drawn from text by patterns: a value, a frequency, a list and a flag."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("n_paragraphs"),
        F.array_join(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)), ",").alias("numbers"), h.rlike("(?i)script").alias("has_script"),
    )


# Duplicates --------------------------------------------------------------------------------


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.groups(blocked_pairs(spark, sf_dir).select("x", "y").distinct())


GROUPS = f"WITH RECURSIVE {KEYS}, ends AS (SELECT DISTINCT x AS a, y AS b FROM links UNION SELECT y, x FROM links), reach AS (SELECT a AS id, a AS r FROM ends UNION SELECT id, b FROM reach JOIN ends ON r = a), groups AS (SELECT id, min(r) AS label FROM reach GROUP BY id)"


@query("d3_components", f"{GROUPS} SELECT id, label FROM groups")
def d3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked documents, named by their smallest id."""
    return grouped(spark, sf_dir)


@query(
    "d10_resolved_groups",
    f"{GROUPS} SELECT DISTINCT label, CASE WHEN label IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'archived' WHEN label IN (SELECT item_id FROM benchmark) THEN 'dismissed' ELSE 'none' END AS state FROM groups",
)
def d10_resolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a group was archived, dismissed, or neither."""
    g = written(grouped(spark, sf_dir).select("label").distinct())
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("label"), F.lit("archived").alias("a")).distinct()
    off = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label"), F.lit("dismissed").alias("b")).distinct()
    return g.join(gone, "label", "left").join(off, "label", "left").select("label", F.coalesce("a", "b", F.lit("none")).alias("state"))
