"""The catalogue's tables as views of the driver's tables, in Spark and as SQL text.

Parts are the tagged items, documents the texts, pages the titled pages, orders the submissions
of customers, conversations the reviews, events the audit log, and region, nation and customer
a tree of three levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, tags, brands, kinds, size, price); tags are null for size 50, empty for 49."""
    tags = F.when(F.col("p_size") == 50, F.lit(None)).when(F.col("p_size") == 49, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), tags.alias("tags"), F.array("p_brand").alias("brands"), F.array("p_type").alias("kinds"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


ITEMS = """items AS (
  SELECT p_partkey AS id, p_name AS title,
         CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN []::VARCHAR[] ELSE string_split(p_name, ' ') END AS tags,
         [p_brand] AS brands, [p_type] AS kinds, p_size AS size, p_retailprice AS price FROM part)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, body, lang, source) of the documents; the title is the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang", "source")


TEXTS = "texts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, lang, source FROM documents)"


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, html) of the pages."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")


PAGES = "titled AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, parent) of regions, nations and customers."""
    r = table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS key", "r_name AS label", "CAST(NULL AS STRING) AS parent")
    n = table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey)", "n_name", "concat('R', n_regionkey)")
    c = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey)", "c_name", "concat('N', c_nationkey)")
    return r.union(n).union(c)


TREE = """tree AS (
  SELECT 'R' || r_regionkey AS key, r_name AS label, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey FROM customer),
chain AS (
  SELECT key, key AS ancestor, 0 AS steps FROM tree
  UNION ALL SELECT t.key, p.key, 1 FROM tree t JOIN tree p ON t.parent = p.key
  UNION ALL SELECT t.key, g.key, 2 FROM tree t JOIN tree p ON t.parent = p.key JOIN tree g ON p.parent = g.key)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key): each order has its customer's key, and every second one of the nation above as well."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = F.expr("if(o_orderpriority < '3', array(concat('C', c_custkey), concat('N', c_nationkey)), array(concat('C', c_custkey)))")
    return o.select(F.col("o_orderkey").alias("id"), F.explode(keys).alias("key"))


TAGS = """tags AS (
  SELECT o_orderkey AS id, 'C' || o_custkey AS key FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 'N' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority < '3')"""


def words_sql(text: str) -> str:
    """The SQL of functions.text.words."""
    plain = f"trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"(CASE WHEN {plain} = '' THEN []::VARCHAR[] ELSE string_split({plain}, ' ') END)"


def trigrams_sql(text: str) -> str:
    """The SQL of functions.text.trigrams."""
    return f"list_distinct(flatten(list_transform({words_sql(text)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str, both_empty: float = 0.0) -> str:
    """The SQL of functions.text.jaccard for two sets."""
    either = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {either} = 0 THEN {both_empty} ELSE len(list_intersect({a}, {b})) / {either} END)"
