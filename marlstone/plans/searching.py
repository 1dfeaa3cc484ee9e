"""Search, facets and the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import facets, hierarchy
from marlstone.operators import search as S
from marlstone.operators import search_index as X
from marlstone.operators.requests import request_of
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.scratch import scratch_folder, small, written
from marlstone.sources.tables import table

SYNONYMS = [("thble", ["thsh", "thre thnt"], "bidirectional"), ("ernt", ["erst"], "oneway"), ("thng", ["thing"], "typo_correction")]
#: The SQL of a full-text search over the texts; {groups} are rows (group, alternative, word).
SEARCH = (
    f"WITH {V.TEXTS}, posts AS ("
    f"SELECT id, word, max(weight) AS weight FROM (SELECT id, unnest({V.words_sql('title')}) AS word, 1.0 AS weight FROM texts WHERE {{live}} "
    f"UNION ALL SELECT id, unnest({V.words_sql('body')}), 0.1 FROM texts WHERE {{live}}) GROUP BY id, word), "
    "wanted(g, alt, word) AS (VALUES {groups}), need AS (SELECT g, alt, count(*) AS n FROM wanted GROUP BY g, alt), "
    "alts AS (SELECT id, g, alt, min(weight) AS w FROM posts JOIN wanted USING (word) GROUP BY id, g, alt "
    "HAVING count(*) = (SELECT n FROM need WHERE need.g = wanted.g AND need.alt = wanted.alt)), "
    "best AS (SELECT id, g, max(w) AS w FROM alts GROUP BY id, g), "
    "hit AS (SELECT id, count(*) AS hits, sum(w) AS score FROM best GROUP BY id), "
    f"scored AS (SELECT t.id, t.title, hits, score, {V.jaccard_sql(V.trigrams_sql('t.title'), V.trigrams_sql('{query}'))} AS alike "
    "FROM (SELECT * FROM texts WHERE {live}) t LEFT JOIN hit ON t.id = hit.id), "
    "strict AS (SELECT * FROM scored WHERE coalesce(hits, 0) = {n} OR alike >= 0.3), "
    "kept AS (SELECT * FROM strict WHERE (SELECT count(*) FROM strict) >= 10 UNION ALL "
    "SELECT * FROM scored WHERE (hits IS NOT NULL OR alike >= 0.3) AND (SELECT count(*) FROM strict) < 10), "
    "ranked AS (SELECT id, title, greatest(coalesce(score, 0.0), alike) AS rank FROM kept) "
    "SELECT id, title, round(rank, 6) AS rank, (SELECT count(*) FROM ranked) AS total FROM ranked ORDER BY {order} LIMIT {size} OFFSET {offset}"
)


def _groups(q: str, synonyms=()) -> tuple[str, int]:
    groups = S.expand(q, synonyms)
    return ", ".join(f"({g}, {a}, '{w}')" for g, alts in enumerate(groups) for a, alt in enumerate(alts) for w in dict.fromkeys(alt)), len(groups)


def _search_sql(q: str, synonyms=(), live: str = "true", order: str = "rank DESC, title, id", size: int = 20, offset: int = 0) -> str:
    groups, n = _groups(q, synonyms)
    quoted = "'" + q.replace("'", "''") + "'"
    return SEARCH.replace("{groups}", groups).replace("{n}", str(n)).replace("{live}", live).replace("{query}", quoted).replace("'" + quoted + "'", quoted).replace("{order}", order).replace("{size}", str(size)).replace("{offset}", str(offset))


def _search(spark: SparkSession, sf_dir: str, request: S.Request, synonyms=(), live=None) -> DataFrame:
    rows = V.texts(spark, sf_dir).withColumn("langs", F.array("lang"))
    found = S.search(rows, request, "id", "title", {"A": F.col("title"), "D": F.col("body")}, synonyms, live)
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query("search_facets_synonyms", _search_sql("the thble ernt", SYNONYMS, "lang IN ('en', 'de')"))
def search_facets_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search with synonyms within a facet."""
    return _search(spark, sf_dir, S.Request("the thble ernt", {"langs": ["en", "de"]}), SYNONYMS)


@query("t8_relaxed_search", _search_sql("thble erst thzzqx thti", (), "source IS NOT NULL"))
def t8_relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose words never meet, so that any of them will do."""
    return _search(spark, sf_dir, S.Request("thble erst thzzqx thti"), (), F.col("source").isNotNull())


@query("o2_title_page", _search_sql("thnt thing", (), order="title, id", size=15, offset=15))
def o2_title_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search in order of title."""
    return _search(spark, sf_dir, S.Request("thnt thing", order="title", size=15, offset=15))


@query(
    "t6_phrase_rule",
    f"WITH {V.TEXTS}, ranked AS (SELECT id, title, 1.0::DOUBLE AS rank FROM texts WHERE list_contains({V.words_sql('title')}, 'thha') OR list_contains({V.words_sql('title')}, 'thre')) "
    "SELECT id, title, rank, (SELECT count(*) FROM ranked) AS total FROM ranked ORDER BY rank DESC, title, id LIMIT 20",
)
def t6_phrase_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase with a rule of its own looks for its concept in the heavy sections only."""
    rules = {"thha thre": ([[["thha"], ["thre"]]], ("A",))}
    found = S.search(V.texts(spark, sf_dir), S.Request("Thha  thre"), "id", "title", {"A": F.col("title"), "D": F.col("body")}, rules=rules)
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


def _indexed(spark: SparkSession, rows: DataFrame, sections: dict, facets=(), summary: str | None = None) -> str:
    folder = scratch_folder(spark)
    X.build(rows, "id", "title", sections, folder, facets, summary)
    return folder


@query("t1_index_search", _search_sql("the thble ernt", SYNONYMS, "lang IN ('en', 'de')"))
def t1_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search from a stored index of all documents, without reading their texts again."""
    rows = V.texts(spark, sf_dir).withColumn("langs", F.array("lang"))
    folder = _indexed(spark, rows, {"A": F.col("title"), "D": F.col("body")}, ["langs"])
    found = X.search(spark, folder, S.Request("the thble ernt", {"langs": ["en", "de"]}), SYNONYMS)
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query("t8_index_relaxed", _search_sql("thble erst thzzqx thti", (), "source IS NOT NULL"))
def t8_index_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from the index whose words never meet, so that any of them will do."""
    folder = _indexed(spark, V.texts(spark, sf_dir), {"A": F.col("title"), "D": F.col("body")}, ["source"])
    found = X.search(spark, folder, S.Request("thble erst thzzqx thti"), (), F.col("source").isNotNull())
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query(
    "t3_index_top",
    f"WITH {V.TEXTS}, p AS (SELECT id, word, max(weight) AS weight FROM (SELECT id, unnest({V.words_sql('title')}) AS word, 1.0::DOUBLE AS weight FROM texts UNION ALL SELECT id, unnest({V.words_sql('body')}), 0.1::DOUBLE FROM texts) WHERE word IN ('thble', 'erst', 'tion') GROUP BY id, word) "
    "SELECT id, round(sum(weight), 6) AS score FROM p GROUP BY id HAVING count(*) = 3 ORDER BY round(sum(weight), 6) DESC, id LIMIT 30",
)
def t3_index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty heaviest matches of three words; blocks of the index that can't hold any aren't read."""
    folder = _indexed(spark, V.texts(spark, sf_dir), {"A": F.col("title"), "D": F.col("body")})
    return X.top_matches(spark, folder, "thble erst tion", 30).select("id", F.round("score", 6).alias("score"))


#: The search over four sections, whose summary is the second line, with the summary's leg of the rank.
FOUR_SECTIONS = (
    SEARCH.replace("text AS body", "split_part(text, chr(10), 2) AS summary, text AS body")
    .replace("UNION ALL SELECT id, unnest", f"UNION ALL SELECT id, unnest({V.words_sql('summary')}), 0.4 FROM texts WHERE {{live}} UNION ALL SELECT id, unnest({V.words_sql('source')}), 0.2 FROM texts WHERE {{live}} UNION ALL SELECT id, unnest", 1)
    .replace("AS alike FROM", f"AS alike, 0.8 * {V.jaccard_sql(V.trigrams_sql('t.summary'), V.trigrams_sql('{query}'))} AS told FROM")
    .replace("greatest(coalesce(score, 0.0), alike)", "greatest(coalesce(score, 0.0), alike, told)")
)


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = V.texts(spark, sf_dir).withColumn("summary", F.coalesce(F.get(F.split("body", "\n", 3), F.lit(1)), F.lit("")))
    rows = rows.withColumn("levels", F.array(F.regexp_extract("source", "([0-9]+)", 1)))
    return rows, {"A": F.col("title"), "B": F.col("summary"), "C": F.col("source"), "D": F.col("body")}


def _sections_sql(words: str, live: str = "true") -> str:
    groups, n = _groups(words)
    out = FOUR_SECTIONS.replace("{groups}", groups).replace("{n}", str(n)).replace("{live}", live).replace("'{query}'", f"'{words}'").replace("{query}", f"'{words}'")
    return out.replace("{order}", "rank DESC, title, id").replace("{size}", "20").replace("{offset}", "0")


@query("t9_summary_rank", _sections_sql("thble src3 erst"))
def t9_summary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over titles, summaries, tags and bodies, each with its weight; a like summary lifts the rank."""
    rows, sections = _sections(spark, sf_dir)
    found = S.search(rows, S.Request("thble src3 erst"), "id", "title", sections, summary="summary")
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query("t9_index_rank", _sections_sql("thble src3 erst"))
def t9_index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over four sections with the summary's leg, from a stored index."""
    rows, sections = _sections(spark, sf_dir)
    folder = _indexed(spark, rows, sections, (), "summary")
    return X.search(spark, folder, S.Request("thble src3 erst"), summary=True).select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query("p22_typed_query", _sections_sql("thble erst", "regexp_extract(source, '([0-9]+)', 1) IN ('2', '3', '4')"))
def p22_typed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed query: fillers go, and its range of levels is a filter."""
    rows, sections = _sections(spark, sf_dir)
    found = S.search(rows, request_of("the thble lessons for grades 2 to 4, erst", {}, "levels"), "id", "title", sections, summary="summary")
    return found.select("id", "title", F.round("rank", 6).alias("rank"), "total")


@query(
    "t10_prefix_terms",
    f"WITH {V.TEXTS}, w AS (SELECT DISTINCT id, unnest({V.words_sql('body')}) AS word FROM texts) "
    "SELECT id, count(*) AS n_words FROM w WHERE starts_with(word, 'thtio') OR starts_with(word, 'erbl') GROUP BY id",
)
def t10_prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with words that start with one of the terms; a long plural is searched by its singular."""
    terms = S.prefix_terms("thtios erbl")
    rows = V.texts(spark, sf_dir)
    words = rows.select("id", F.explode(F.array_distinct(T.words(F.col("body")))).alias("word"))
    test = F.lit(False)
    for t in terms:
        test = test | F.col("word").startswith(t)
    return words.filter(test).groupBy("id").agg(F.count(F.lit(1)).alias("n_words"))


@query(
    "t2_concept_flatten",
    "SELECT user_id, string_agg(DISTINCT s, ',' ORDER BY s) AS concepts FROM (SELECT user_id, event_type AS s FROM events "
    "UNION ALL SELECT user_id, json_extract_string(props, '$.k') FROM events) WHERE s IS NOT NULL GROUP BY user_id",
)
def t2_concept_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and values of a map of arrays as one sorted set, from {event type: [k, ...]} per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    per = e.groupBy("user_id", "event_type").agg(F.collect_set("k").alias("ks"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ks"))).alias("m"))  # five event types
    flat = F.array_distinct(F.concat(F.map_keys("m"), F.flatten(F.map_values("m"))))
    return maps.select("user_id", F.array_join(F.array_sort(flat), ",").alias("concepts"))


# Facets ------------------------------------------------------------------------------------

ACTIVE = {"tags": ["red", "gizmo"], "brands": ["Brand#2", "Brand#17", "Brand#4", "Brand#9"], "kinds": []}


@query(
    "a11_facet_counts",
    f"WITH {V.ITEMS}, bits AS (SELECT *, coalesce(list_has_any(tags, ['red', 'gizmo']), false) AS t, "
    "coalesce(list_has_any(brands, ['Brand#2', 'Brand#17', 'Brand#4', 'Brand#9']), false) AS b FROM items) "
    "SELECT 'tags' AS category, v AS value, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS v FROM bits WHERE b) GROUP BY v "
    "UNION ALL SELECT 'brands', v, count(*) FROM (SELECT unnest(brands) AS v FROM bits WHERE t) GROUP BY v "
    "UNION ALL SELECT 'kinds', v, count(*) FROM (SELECT unnest(kinds) AS v FROM bits WHERE t AND b) GROUP BY v",
)
def a11_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per category and value that leave the category's own filter out."""
    return facets.true_counts(V.items(spark, sf_dir), ["tags", "brands", "kinds"], ACTIVE)


@query(
    "a12_tree_rollup",
    f"WITH {V.TREE}, {V.TAGS} SELECT ancestor AS key, count(DISTINCT id) AS n FROM tags JOIN chain USING (key) GROUP BY ancestor",
)
def a12_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders per node of the tree or below it."""
    return facets.rolled_up(V.tags(spark, sf_dir), small(written(hierarchy.closure(V.tree(spark, sf_dir))), 300_000))


# Tree --------------------------------------------------------------------------------------


@query(
    "h1_descendants",
    f"WITH {V.TREE} SELECT DISTINCT t.label FROM tree r JOIN chain c ON c.ancestor = r.key JOIN tree t ON t.key = c.key "
    "WHERE r.key IN ('R1', 'N7', 'ASIA', 'elsewhere') OR r.label IN ('R1', 'N7', 'ASIA', 'elsewhere') UNION SELECT 'elsewhere'",
)
def h1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below keys or labels; what isn't a node passes through."""
    t = V.tree(spark, sf_dir)
    return hierarchy.descendants(t, hierarchy.closure(t), ["R1", "N7", "ASIA", "elsewhere"])


@query("h2_closure", f"WITH {V.TREE} SELECT key, ancestor, steps FROM chain")
def h2_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(V.tree(spark, sf_dir))


@query("h3_dangling", f"WITH {V.TREE}, cut AS (SELECT * FROM tree WHERE key <> 'R2') SELECT key, parent FROM cut WHERE parent IS NOT NULL AND parent NOT IN (SELECT key FROM cut)")
def h3_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose parent is missing, of a tree without one of its roots."""
    return hierarchy.dangling(V.tree(spark, sf_dir).filter("key <> 'R2'")).select("key", "parent")


@query(
    "h4_leaves",
    f"WITH {V.TREE}, {V.TAGS} SELECT id, key FROM tags t WHERE NOT EXISTS ("
    "SELECT 1 FROM tags o JOIN chain c ON c.key = o.key AND c.steps > 0 WHERE o.id = t.id AND c.ancestor = t.key)",
)
def h4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of orders without those above another tag of the order."""
    return hierarchy.leaves(V.tags(spark, sf_dir), small(written(hierarchy.closure(V.tree(spark, sf_dir))), 300_000))


@query(
    "h5_chain_labels",
    f"WITH {V.TREE} SELECT c.key, max(steps)::INT AS depth, string_agg(t.label, ' -> ' ORDER BY steps DESC) AS path FROM chain c JOIN tree t ON t.key = c.ancestor GROUP BY c.key",
)
def h5_chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tree(spark, sf_dir)
    return hierarchy.chain_labels(t, hierarchy.closure(t))


@query(
    "o8_tree_order",
    f"WITH {V.TREE}, {V.TAGS}, n AS (SELECT ancestor AS key, count(DISTINCT id) AS n FROM tags JOIN chain USING (key) GROUP BY ancestor), "
    "d AS (SELECT key, max(steps) AS depth FROM chain GROUP BY key) SELECT d.key, depth::INT AS depth, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (key)",
)
def o8_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by depth, then by how many orders they hold, then by key."""
    chain = written(hierarchy.closure(V.tree(spark, sf_dir)))
    n = facets.rolled_up(V.tags(spark, sf_dir), small(chain, 300_000))
    depth = chain.groupBy("key").agg(F.max("steps").alias("depth"))
    return depth.join(n, "key", "left").na.fill(0, ["n"]).orderBy("depth", F.desc("n"), "key")
