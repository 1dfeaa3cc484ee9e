"""Ship policies, gates by field, nested options, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import hierarchy
from marlstone.operators import search as S
from marlstone.operators import tags as N
from marlstone.plans import views as V
from marlstone.plans.catalog import query

VOCABULARY, LOCKED = ["gear", "ring", "rod", "red", "old"], ["rod"]


@query(
    "n9_shipped",
    f"WITH {V.ITEMS}, s AS (SELECT id, list_filter(coalesce(tags, []), lambda t: t <> 'red') AS f, string_split(title, ' ')[2] AS m FROM items) "
    "SELECT id, array_to_string(list_concat(f, list_filter(list_concat([m], list_filter(['gear', 'rod', 'new', 'ring'], lambda v: v <> m)), lambda v: v IN ('gear', 'ring', 'red', 'old') AND NOT list_contains(f, v))), ',') AS tags FROM s",
)
def n9_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shipped: the floor, and what a model adds within the vocabulary; a locked value comes from the floor alone."""
    i = V.items(spark, sf_dir)
    model = F.array(F.split("title", " ")[1], F.lit("gear"), F.lit("rod"), F.lit("new"), F.lit("ring"))
    return i.select("id", F.array_join(N.shipped(F.filter("tags", lambda t: t != "red"), model, VOCABULARY, LOCKED), ",").alias("tags"))


@query(
    "n5_subjects",
    f"WITH {V.ITEMS} SELECT id, array_to_string(list_concat(brands, list_concat(CASE WHEN len(tags) > 0 AND NOT list_contains(brands, kinds[1]) THEN kinds ELSE [] END, CASE WHEN size > 25 THEN ['Size'] ELSE [] END)), ',') AS integration FROM items",
)
def n5_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that concepts name are added to those of an item; subjects without a concept aren't."""
    none = F.array().cast("array<string>")
    large = F.when(F.col("size") > 25, F.array(F.lit("large"))).otherwise(none)
    concepts = F.create_map(F.col("kinds")[0], F.coalesce("tags", none), F.lit("Size"), large, F.lit("Art"), none)
    return V.items(spark, sf_dir).select("id", F.array_join(N.with_subjects(F.col("brands"), concepts), ",").alias("integration"))


_FIELDS = f"""{V.ITEMS}, truth AS (SELECT DISTINCT 'tags' AS field, id, unnest(tags) AS value FROM items UNION SELECT 'kind', id, kinds[1] FROM items
), winner AS (SELECT DISTINCT 'tags' AS field, id, unnest(CASE WHEN size < 20 THEN [string_split(title, ' ')[1], 'gear'] ELSE [string_split(title, ' ')[2]] END) AS value FROM items UNION SELECT 'kind', id, CASE WHEN size < 30 THEN kinds[1] ELSE 'OTHER' END FROM items
), base AS (SELECT DISTINCT 'tags' AS field, id, string_split(title, ' ')[1] AS value FROM items UNION SELECT 'kind', id, CASE WHEN size < 40 THEN kinds[1] ELSE 'OTHER' END FROM items
), w AS (SELECT coalesce(p.field, t.field) AS field, coalesce(p.value, t.value) AS value, count(*) FILTER (WHERE p.id IS NOT NULL AND t.id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.id IS NULL) AS fp, count(*) FILTER (WHERE p.id IS NULL) AS fn
  FROM winner p FULL JOIN truth t ON p.id = t.id AND p.value = t.value AND p.field = t.field GROUP BY 1, 2
), b AS (SELECT coalesce(p.field, t.field) AS field, count(*) FILTER (WHERE p.id IS NOT NULL AND t.id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.id IS NULL) AS fp, count(*) FILTER (WHERE p.id IS NULL) AS fn
  FROM base p FULL JOIN truth t ON p.id = t.id AND p.value = t.value AND p.field = t.field GROUP BY 1
), f AS (SELECT field, 2 * sum(tp) / sum(2 * tp + fp + fn) AS f1, (SELECT 2 * tp / (2 * tp + fp + fn) FROM b WHERE b.field = w.field) AS base FROM w GROUP BY field)"""


@query(
    "a35_field_gates",
    f"WITH {_FIELDS} SELECT 'baseline' AS gate, field, NULL AS value, round(f1, 6) AS measured, round(base, 6) AS floor FROM f WHERE f1 < base "
    "UNION ALL SELECT 'macro', NULL, NULL, round(avg(f1), 6), 0.9 FROM f HAVING avg(f1) < 0.9 UNION ALL SELECT 'recall', field, value, round(tp / (tp + fn), 6), 0.6 FROM w WHERE tp + fn >= 2 AND tp / (tp + fn) < 0.6 "
    "UNION ALL SELECT 'singleton', field, value, 0, NULL FROM w WHERE tp = 0 AND fn = 1",
)
def a35_field_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields against a baseline, floors of their mean and of each value's recall, missed singletons."""
    i = V.items(spark, sf_dir)
    words, kind = F.split("title", " "), F.col("kinds")[0]
    sets = lambda tags, k: i.select(F.lit("tags").alias("field"), "id", F.explode(tags).alias("value")).union(i.select(F.lit("kind"), "id", k))
    winner = sets(F.when(F.col("size") < 20, F.array(words[0], F.lit("gear"))).otherwise(F.array(words[1])), F.when(F.col("size") < 30, kind).otherwise("OTHER"))
    base = sets(F.array(words[0]), F.when(F.col("size") < 40, kind).otherwise("OTHER"))
    gates = E.field_gates(winner, base, sets(F.col("tags"), kind), macro=0.9, recall=0.6)
    return gates.select("gate", "field", "value", F.round("measured", 6).alias("measured"), F.round("floor", 6).alias("floor"))


_NODE = "replace(to_json({'key': key, 'label': label, 'n': n})::VARCHAR || '|', '}|', ',\"children\":[' || {below} || ']}')"


def _node_sql(below: str) -> str:
    return _NODE.replace("{below}", below)


@query(
    "h5_nested_options",
    "WITH leaf AS (SELECT p_brand || '/' || p_type || '/' || p_size AS key, 'size ' || p_size AS label, count(*) AS n, p_brand || '/' || p_type AS parent FROM part GROUP BY p_brand, p_type, p_size), "
    f"l AS (SELECT parent, n, key, {_node_sql(chr(39) + chr(39))} AS o FROM leaf), "
    "mid AS (SELECT p_brand || '/' || p_type AS key, p_type AS label, count(*) AS n, p_brand AS parent FROM part GROUP BY p_brand, p_type), "
    f"m AS (SELECT parent, n, key, {_node_sql('(SELECT string_agg(o, ' + chr(39) + ',' + chr(39) + ' ORDER BY l.n DESC, l.key) FROM l WHERE l.parent = mid.key)')} AS o FROM mid), "
    "top AS (SELECT p_brand AS key, lower(p_brand) AS label, count(*) AS n FROM part GROUP BY p_brand) "
    f"SELECT key, {_node_sql('(SELECT string_agg(o, ' + chr(39) + ',' + chr(39) + ' ORDER BY m.n DESC, m.key) FROM m WHERE m.parent = top.key)')} AS options FROM top",
)
def h5_nested_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of brands, kinds and sizes as nested options with their counts, folded level by level (H5)."""
    i = V.items(spark, sf_dir).select(F.col("brands")[0].alias("brand"), F.col("kinds")[0].alias("kind"), F.col("size").cast("string").alias("size"))
    n = F.count(F.lit(1)).alias("n")
    leaf = i.groupBy("brand", "kind", "size").agg(n).select(F.concat_ws("/", "brand", "kind", "size").alias("key"), F.concat(F.lit("size "), "size").alias("label"), F.concat_ws("/", "brand", "kind").alias("parent"), "n")
    mid = i.groupBy("brand", "kind").agg(n).select(F.concat_ws("/", "brand", "kind"), "kind", "brand", "n")
    top = i.groupBy("brand").agg(n).select("brand", F.lower("brand"), F.lit(None).cast("string"), "n")
    return hierarchy.nested_options(leaf.union(mid).union(top), 2)


@query("t10_suggestions", f"WITH {V.TEXTS}, found AS (SELECT id FROM texts WHERE list_contains({V.words_sql('body')}, 'zzthing')) SELECT NULL::BIGINT AS id, NULL::VARCHAR AS title, s AS suggestion FROM (VALUES ('zzthing'), ('thble'), ('zzthin'), ('zzthings'), ('qqq')) v(s) WHERE NOT EXISTS (FROM found)")
def t10_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that finds nothing suggests its words, their synonyms and other endings."""
    synonyms = [("zzthing", ["thble"], "oneway")]
    found = S.search(V.texts(spark, sf_dir), S.Request("zzthing qqq"), "id", "title", {"A": F.col("title"), "D": F.col("body")})
    return S.page_or_suggestions(found, "zzthing qqq", synonyms)
