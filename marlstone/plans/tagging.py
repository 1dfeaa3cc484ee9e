"""Tag normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import tags as N
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.sources.tables import table


def _joined(rows: DataFrame, value, name: str = "tags") -> DataFrame:
    return rows.select("id", F.array_join(value, ",").alias(name))


@query("n1_alias_fold", "SELECT p_partkey AS id, CASE WHEN string_split(p_name, ' ')[1] IN ('hot', 'cold') THEN 'temp' ELSE upper(string_split(p_name, ' ')[1]) END || ',' || CASE WHEN string_split(p_name, ' ')[2] IN ('rod', 'bolt') THEN 'bar' ELSE string_split(p_name, ' ')[2] END AS tags FROM part")
def n1_alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags folded by their trimmed lower-case form; unknown ones stay as they are."""
    words = F.split("p_name", " ")
    raw = F.array(F.concat(F.lit(" "), F.upper(words[0])), words[1], words[1])
    folded = T.folded(raw, {"hot": "temp", "cold": "temp", "rod": "bar", "bolt": "bar"})
    return _joined(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.transform(folded, lambda v: F.btrim(v)).alias("t")), F.col("t"))


@query("n2_parents", f"WITH {V.ITEMS} SELECT id, array_to_string(list_concat(tags, CASE WHEN list_has_any(tags, ['ring', 'bolt']) THEN ['hardware'] ELSE [] END), ',') AS tags FROM items WHERE tags IS NOT NULL")
def n2_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of specific tags appended where missing."""
    return _joined(V.items(spark, sf_dir).filter("tags IS NOT NULL"), N.implied(F.col("tags"), {"ring": "hardware", "bolt": "hardware"}))


@query("n3_generic_value", f"WITH {V.ITEMS} SELECT id, array_to_string(CASE WHEN list_has_any(tags, ['ring', 'rod']) THEN list_filter(tags, lambda t: t <> 'red') ELSE tags END, ',') AS tags FROM items WHERE tags IS NOT NULL")
def n3_generic_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(V.items(spark, sf_dir).filter("tags IS NOT NULL"), N.without_generic(F.col("tags"), "red", ["ring", "rod"]))


@query("n4_cleared", f"WITH {V.ITEMS} SELECT id, CASE WHEN kinds[1] = 'SMALL' THEN array_to_string(tags, ',') ELSE '' END AS tags FROM items WHERE tags IS NOT NULL")
def n4_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that only one kind of item may have."""
    return _joined(V.items(spark, sf_dir).filter("tags IS NOT NULL"), F.when(F.array_contains("kinds", "SMALL"), F.col("tags")).otherwise(T.strings()))


@query("n6_synonym_lint", f"WITH {V.ITEMS} SELECT id, 'red+ring' AS bad FROM items WHERE list_contains(tags, 'red') AND list_contains(tags, 'ring') UNION ALL SELECT id, 'old+gear' FROM items WHERE list_contains(tags, 'old') AND list_contains(tags, 'gear')")
def n6_synonym_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have both of a pair of synonyms."""
    found = N.both_of(F.col("tags"), [("red", "ring"), ("old", "gear")])
    return V.items(spark, sf_dir).select("id", F.explode(found).alias("bad"))


@query("n7_floor", f"WITH {V.ITEMS}, e AS (SELECT id, generate_subscripts(tags, 1) AS pos, unnest(tags) AS t FROM items), m AS (SELECT id, pos, t, CASE t WHEN 'hot' THEN 'cold' WHEN 'new' THEN 'old' ELSE t END AS v FROM e WHERE t <> 'red'), g AS (SELECT id, v, min(pos) AS pos, max((t = v)::INT) AS exact FROM m WHERE v IN ('cold', 'old', 'ring', 'gear', 'bolt', 'blue') GROUP BY id, v) SELECT id, string_agg(v || ':' || CASE WHEN exact = 1 THEN 'exact' ELSE 'alias' END, ',' ORDER BY pos) AS tags FROM g GROUP BY id")
def n7_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops, aliases and the vocabulary applied in turn, with where each value came from."""
    f = N.floor(F.col("tags"), ["red"], {"hot": "cold", "new": "old"}, ["cold", "old", "ring", "gear", "bolt", "blue"])
    rows = V.items(spark, sf_dir).select("id", f.alias("f")).filter(F.size("f") > 0)
    return _joined(rows, F.transform("f", lambda x: F.concat_ws(":", x["value"], x["origin"])))


@query("n8_reconcile", f"WITH {V.ITEMS}, r AS (SELECT id, tags, CASE WHEN size < 25 THEN ['red', 'ring'] ELSE ['old'] END AS drops, ['gear', 'ring', 'locked'] AS adds FROM items WHERE tags IS NOT NULL) SELECT id, array_to_string(list_concat(list_filter(tags, lambda t: NOT list_contains(drops, t)), list_filter(adds, lambda t: t <> 'locked' AND NOT list_contains(drops, t) AND NOT list_contains(tags, t))), ',') AS tags FROM r")
def n8_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep, drop and add decisions: drop wins, what nobody names stays, locked values aren't added."""
    drop = F.when(F.col("size") < 25, F.array(F.lit("red"), F.lit("ring"))).otherwise(F.array(F.lit("old")))
    add = F.array(F.lit("gear"), F.lit("ring"), F.lit("locked"))
    return _joined(V.items(spark, sf_dir).filter("tags IS NOT NULL"), N.reconcile(F.col("tags"), drop, add, ["locked"]))


@query("n10_synced_json", f"WITH {V.ITEMS} SELECT id, coalesce(array_to_string(tags, ','), 'stored') AS tags, 'kept' AS note FROM items")
def n10_synced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored map in step with its columns, of which the non-null win."""
    stored = F.create_map(F.lit("tags"), F.array(F.lit("stored")), F.lit("note"), F.array(F.lit("kept")))
    m = V.items(spark, sf_dir).select("id", N.synced({"tags": F.col("tags"), "kinds": F.col("kinds")}, stored).alias("m"))
    return m.select("id", F.array_join(F.col("m")["tags"], ",").alias("tags"), F.array_join(F.col("m")["note"], ",").alias("note"))


@query("n11_same_multiset", f"WITH {V.ITEMS} SELECT id, list_sort(tags) = list_sort(string_split(title, ' ')) AS same FROM items")
def n11_same_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a column and its JSON array hold the same values, repeats counted."""
    stored = F.from_json(F.to_json(F.split("title", " ")), "array<string>")
    return V.items(spark, sf_dir).select("id", (F.array_sort("tags") == F.array_sort(stored)).alias("same"))


@query("n12_json_arrays", "SELECT event_id, CASE event_type WHEN 'view' THEN 'a,b' WHEN 'click' THEN '' WHEN 'error' THEN 'one' ELSE '' END AS tags FROM events")
def n12_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as arrays of strings: an array, null, a scalar, and no value."""
    t = F.col("event_type")
    raw = F.when(t == "view", '["a", "b"]').when(t == "click", "null").when(t == "error", '"one"')
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.json_strings(raw), ",").alias("tags"))


@query("n14_legacy_values", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE o_orderpriority END AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def n14_legacy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy values of several fields, each with a table of its own."""
    tables = {"priority": ("o_orderpriority", {"1-URGENT": "now", "2-HIGH": "soon"}), "status": ("o_orderstatus", {"O": "open"})}
    mapped = [F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c)), F.col(c)).alias(n) for n, (c, m) in tables.items()]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *mapped)


@query("n15_title_case", "SELECT p_partkey AS id, upper(substr(string_split(p_name, ' ')[1], 1, 1)) || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) AS theme FROM part")
def n15_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.title_case(slug).alias("theme"))


@query("n16_seasons", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Fall' WHEN 'click' THEN 'Fall,Winter,Spring,Summer' WHEN 'error' THEN 'Summer,Fall' ELSE '' END AS seasons FROM events")
def n16_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season spellings as season names."""
    t, a = F.col("event_type"), lambda *v: F.array(*[F.lit(x) for x in v])
    raw = F.when(t == "view", a("Autumn", " fall")).when(t == "click", a("Year-Round", "winter")).when(t == "error", a("summer", "AUTUMN", "mud")).otherwise(a("never"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(N.seasons(raw), ",").alias("seasons"))


@query("n17_repair_check", f"WITH {V.ITEMS} SELECT count(*) AS left_over FROM items WHERE list_contains(list_transform(tags, lambda t: CASE t WHEN 'old' THEN 'aged' ELSE t END), 'old')")
def n17_repair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows still have a value after the rewrite that replaces it."""
    fixed = T.folded(F.col("tags"), {"old": "aged"})
    return V.items(spark, sf_dir).select(fixed.alias("t")).filter(F.array_contains("t", "old")).agg(F.count(F.lit(1)).alias("left_over"))


@query("n18_key_fallback", f"WITH {V.ITEMS} SELECT id, array_to_string(CASE WHEN len(tags) > 0 THEN tags ELSE kinds END, ',') AS tags FROM items")
def n18_key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plural key, or the singular one where that is null or empty."""
    return _joined(V.items(spark, sf_dir), N.plural_or_singular(F.col("tags"), F.col("kinds")))


@query("n19_review_form", f"WITH {V.ITEMS} SELECT id AS \"lessonId\", title AS \"lessonTitle\", coalesce(array_to_string(tags, ','), '') AS \"tagList\" FROM items")
def n19_review_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the field names of the review form; missing lists are empty."""
    return V.items(spark, sf_dir).select(F.col("id").alias("lessonId"), F.col("title").alias("lessonTitle"), F.array_join(F.coalesce("tags", T.strings()), ",").alias("tagList"))
