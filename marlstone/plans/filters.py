"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import filters as P
from marlstone.functions import text as T
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.sources.tables import table


@query("p1_facet_overlap", f"WITH {V.ITEMS} SELECT id FROM items WHERE list_has_any(tags, ['red', 'old']) AND list_has_any(kinds, ['ECONOMY', 'SMALL'])")
def p1_facet_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share a value with every active facet; an empty facet is no filter."""
    return V.items(spark, sf_dir).filter(P.any_of(F.col("tags"), ["red", "old"]) & P.any_of(F.col("kinds"), ["ECONOMY", "SMALL"]) & P.any_of(F.col("brands"), [])).select("id")


@query("p3_live_rows", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 1 AS retired FROM labels WHERE quality = 0) r ON d.doc_id = r.doc_id WHERE retired IS NULL")
def p3_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't retired."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(gone, "doc_id", "left_anti")


@query(
    "p4_places",
    "SELECT p_partkey FROM part WHERE CASE p_type WHEN 'ECONOMY' THEN 'indoor' WHEN 'SMALL' THEN 'outdoor' WHEN 'LARGE' THEN 'both' ELSE lower(p_type) END IN ('indoor', 'both', 'promo')",
)
def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place filter also finds what suits both; case is ignored."""
    place = F.when(F.col("p_type") == "ECONOMY", "Indoor").when(F.col("p_type") == "SMALL", "OUTDOOR").when(F.col("p_type") == "LARGE", "Both").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").filter(P.any_of(F.array(place), P.with_aliases(["Indoor", "PROMO"], P.PLACES, fold=True), fold=True)).select("p_partkey")


@query("p5_methods", f"WITH {V.ITEMS} SELECT id FROM items WHERE list_has_any(tags, ['hot', 'cold', 'small'])")
def p5_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method filter with several spellings of one value."""
    wanted = P.with_aliases(["Any Heat", "small"], {"any heat": ("hot", "cold")}, fold=True)
    return V.items(spark, sf_dir).filter(P.any_of(F.col("tags"), wanted, fold=True)).select("id")


@query("p7_aliases", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p7_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of a filter stand for slug and label; unknown values pass."""
    wanted = P.with_aliases(["building", "MACHINERY"], {"building": ("building", "BUILDING")})
    return table(spark, sf_dir, "customer").filter(P.any_of(F.array("c_mktsegment"), wanted)).select("c_custkey")


@query("p10_fuzzy_titles", f"WITH {V.ITEMS} SELECT id, round({V.jaccard_sql(V.trigrams_sql('title'), V.trigrams_sql(chr(39) + 'smal rings' + chr(39)))}, 6) AS sim FROM items WHERE {V.jaccard_sql(V.trigrams_sql('title'), V.trigrams_sql(chr(39) + 'smal rings' + chr(39)))} >= 0.3")
def p10_fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles like a misspelled query."""
    sim = T.trigram_similarity(F.col("title"), F.lit("smal rings"))
    return V.items(spark, sf_dir).select("id", sim.alias("sim")).filter("sim >= 0.3").select("id", F.round("sim", 6).alias("sim"))


@query(
    "p11_builder_tests",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice > 1000 AND o_custkey IS NOT NULL",
)
def p11_builder_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, list, range and null tests; the date range is half open. All reach the scan."""
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") != "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_custkey").isNotNull() & (F.col("o_totalprice") > 1000))
    return o.filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@query("p12_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'a_b') OR contains(lower(text), '100%') OR contains(lower(source), 'src1')")
def p12_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment in any case, with the wildcards as plain characters."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter(T.contains_ci(t, "A_b") | T.contains_ci(t, "100%") | T.contains_ci(F.col("source"), "SRC1")).select("doc_id")


@query("p13_title_picker", f"WITH {V.ITEMS} SELECT id, title FROM items WHERE contains(title, 'ring') AND size < 40 ORDER BY title, id LIMIT 20")
def p13_title_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty titles with a word."""
    return V.items(spark, sf_dir).filter(T.contains_ci(F.col("title"), "RING") & (F.col("size") < 40)).select("id", "title").orderBy("title", "id").limit(20)


@query("p14_same_set", "SELECT p_partkey FROM part WHERE list_sort(list_distinct(string_split(p_name, ' '))) = ['red', 'widget']")
def p14_same_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(T.same_set(F.split("p_name", " "), P.strings_lit(["widget", "red", "red"]))).select("p_partkey")


VOCABULARY = ["red", "blue", "small", "large", "ring", "bolt", "widget", "gear"]


@query("p15_off_vocabulary", f"WITH {V.ITEMS} SELECT id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: NOT list_contains({VOCABULARY}, t)))), ',') AS bad FROM items WHERE len(list_filter(tags, lambda t: NOT list_contains({VOCABULARY}, t))) > 0")
def p15_off_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with tags that the closed vocabulary lacks; null tags pass."""
    bad = T.outside(F.col("tags"), VOCABULARY)
    return V.items(spark, sf_dir).select("id", bad.alias("bad")).filter(F.size("bad") > 0).select("id", F.array_join(F.array_sort("bad"), ",").alias("bad"))


@query("p16_exists", f"WITH {V.ITEMS} SELECT id FROM items WHERE len(list_filter(tags, lambda t: starts_with(t, 'g'))) > 0")
def p16_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an element that passes a test."""
    return V.items(spark, sf_dir).filter(F.exists("tags", lambda t: t.startswith("g"))).select("id")


@query(
    "p17_previews",
    f"WITH {V.TEXTS} SELECT id, body LIKE '%|%|%' AS is_table, trim(title) <> '' AS has_title, coalesce(length(body), 0) AS n, md5(substr(body, 1, 500)) AS preview FROM texts",
)
def p17_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a body is a table and a title is there, the length, and a 500-character preview's digest."""
    preview = F.md5(F.substring("body", 1, 500))
    return V.texts(spark, sf_dir).select("id", F.col("body").like("%|%|%").alias("is_table"), (F.trim("title") != "").alias("has_title"), F.coalesce(F.length("body"), F.lit(0)).alias("n"), preview.alias("preview"))


@query(
    "p18_overlay",
    f"WITH {V.ITEMS} SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') ELSE 'old' END AS tags, kinds[1] AS kinds, CASE WHEN size > 25 THEN 'big' END AS note FROM items",
)
def p18_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns laid over a stored map: only non-empty ones win, null entries go."""
    old = F.create_map(F.lit("tags"), F.array(F.lit("old")), F.lit("kinds"), F.array(F.lit("older")), F.lit("note"), F.when(F.col("size") > 25, F.array(F.lit("big"))))
    new = F.create_map(F.lit("tags"), F.coalesce("tags", T.strings()), F.lit("kinds"), F.col("kinds"))
    m = V.items(spark, sf_dir).select("id", P.overlay(old, new).alias("m"))
    return m.select("id", F.array_join(F.col("m")["tags"], ",").alias("tags"), F.array_join(F.col("m")["kinds"], ",").alias("kinds"), F.array_join(F.try_element_at("m", F.lit("note")), ",").alias("note"))


@query("p19_or_all", f"WITH {V.ITEMS} SELECT id FROM items WHERE list_has_any(tags, ['red']) OR list_contains(kinds, 'STANDARD')")
def p19_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted value or the value that stands for all."""
    return V.items(spark, sf_dir).filter(P.any_of(F.col("tags"), ["red"]) | F.array_contains("kinds", "STANDARD")).select("id")


@query(
    "p20_test_groups",
    f"WITH {V.ITEMS} SELECT id FROM items WHERE (contains(title, 'old') OR contains(title, 'new')) AND (coalesce(list_contains(tags, 'gear'), false) OR coalesce(list_contains(brands, 'Brand#4'), false) OR len(list_filter(tags, lambda t: contains(t, 'ing'))) > 0)",
)
def p20_test_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups must hold, each by one of its tests: containment, membership, containment in an element."""
    title = F.col("title")
    groups = [[T.contains_ci(title, "OLD"), T.contains_ci(title, "new")], [F.array_contains("tags", "gear"), F.array_contains("brands", "Brand#4"), F.exists("tags", lambda t: t.contains("ing"))]]
    return V.items(spark, sf_dir).filter(P.groups_test(groups)).select("id")


@query("p24_valid_at", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-06-01'")
def p24_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open invitations that haven't run out at a given time."""
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.expr("TIMESTAMP '1998-06-01' - INTERVAL 7 DAY"))).select("o_orderkey")


@query("p26_role_ladder", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 WHEN 'system' THEN 3 ELSE 0 END AS rank FROM conversations WHERE role IN ('assistant', 'system')")
def p26_role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose role is at or above a step of the ladder."""
    rank = P.rank_of(F.col("role"), P.ROLES)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rank.alias("rank")).filter("rank >= 2")


@query("p27_id_lists", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def p27_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on one list and not on another."""
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(lab.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").join(lab.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(
    "p28_safe_names",
    f"WITH {V.PAGES} SELECT id, trim(title) = title AND length(title) BETWEEN 1 AND 120 AND NOT regexp_matches(title, '[[:cntrl:]]|@|(?i:https?:|www\\.)') AS safe FROM titled",
)
def p28_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.titled_pages(spark, sf_dir).select("id", P.safe_name(F.col("title")).alias("safe"))


@query(
    "p29_gate",
    f"WITH {V.PAGES} SELECT id, starts_with(html, '<!DOCTYPE html>') AND contains(html, '<article>') AND length(title) BETWEEN 1 AND 120 AND trim(title) = title "
    "AND NOT regexp_matches(title, '[[:cntrl:]]|@|(?i:https?:|www\\.)') AS shown FROM titled",
)
def p29_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown only if kind, source and name all pass."""
    h = F.col("html")
    return V.titled_pages(spark, sf_dir).select("id", (h.startswith("<!DOCTYPE html>") & h.contains("<article>") & P.safe_name(F.col("title"))).alias("shown"))
