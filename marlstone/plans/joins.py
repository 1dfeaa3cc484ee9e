"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import duplicates, workflow
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.scratch import small
from marlstone.sources.tables import table


def _latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("role")])


@query("j1_left_chain", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left joins in a row; rows without a partner stay."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    left = o.join(c.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return left.join(small(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("j2_unpublished", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def j2_unpublished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.unpublished(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "j3_latest_review",
    "SELECT doc_id, (SELECT role FROM conversations c WHERE c.conv_id = d.doc_id ORDER BY turn DESC, role DESC LIMIT 1) AS role FROM documents d",
)
def j3_latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the role of its last review, if any."""
    last = _latest_turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "role")
    return table(spark, sf_dir, "documents").select("doc_id").join(last, "doc_id", "left")


@query("j4_bridge", "SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48")
def j4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a large line, through the bridge of orders."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    who = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(who, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "j5_lookups",
    "SELECT c_custkey, n_name, coalesce(array_to_string(ks, ','), '') AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, list_sort(list(o_orderkey)) AS ks FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def j5_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, names and related ids looked up for each row."""
    keys = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))
    n = small(table(spark, sf_dir, "nation"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(keys, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit("")).alias("orders"))


COSINE_SQL = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"


@query(
    "j7_title_pairs",
    f"WITH {V.PAGES}, t AS (SELECT title, min(id) AS id, {V.trigrams_sql('title')} AS g FROM titled GROUP BY title) "
    f"SELECT a.id AS x, b.id AS y, round({V.jaccard_sql('a.g', 'b.g')}, 6) AS sim FROM t a JOIN t b ON a.id < b.id WHERE len(a.g) > 0 AND {V.jaccard_sql('a.g', 'b.g')} >= 0.55",
)
def j7_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different page titles that are alike by trigrams."""
    pairs = duplicates.trigram_pairs(V.titled_pages(spark, sf_dir), "id", "title")
    return pairs.select("x", "y", F.round("sim", 6).alias("sim"))


def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, reason) links of documents with equal normal titles, content or (language, source, length)."""
    t = V.texts(spark, sf_dir)
    title = T.normal_title(F.col("title"))
    by_title = duplicates.same_key_pairs(t, "id", F.when(title != "", title), "title")
    by_hash = duplicates.same_key_pairs(t, "id", T.content_hash(F.col("body")), "hash")
    by_tags = duplicates.same_key_pairs(t, "id", F.concat_ws("|", "lang", "source", F.length("body")), "tags")
    return by_title.union(by_hash).union(by_tags)


#: White space of Java's \s, which RE2's lacks in part.
SPACE = r"[ \t\n\x0b\x0c\r]+"
KEYS = (
    f"{V.TEXTS}, keys AS (SELECT id, 'title' AS reason, nullif(trim(regexp_replace(lower(title), '[\\s\\p{{Cc}}]+', ' ', 'g')), '') AS k FROM texts "
    f"UNION ALL SELECT id, 'hash', sha256(trim(regexp_replace(lower(body), '{SPACE}', ' ', 'g'))) FROM texts "
    "UNION ALL SELECT id, 'tags', concat_ws('|', lang, source, length(body)) FROM texts), "
    "firsts AS (SELECT reason, k, min(id) AS x FROM keys WHERE k IS NOT NULL GROUP BY reason, k), "
    "links AS (SELECT f.x, keys.id AS y, reason FROM keys JOIN firsts f USING (reason, k) WHERE f.x < keys.id)"
)


@query("j8_blocked_pairs", f"WITH {KEYS} SELECT x, y, string_agg(reason, ',' ORDER BY reason) AS reasons FROM links GROUP BY x, y")
def j8_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by equal keys with their reasons; a group is a star, so its links grow with its rows."""
    pairs = blocked_pairs(spark, sf_dir)
    return pairs.groupBy("x", "y").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("j11_mapped_tags", f"WITH {V.ITEMS}, e AS (SELECT id, generate_subscripts(tags, 1) - 1 AS pos, unnest(tags) AS t FROM items) SELECT id, pos::INT AS pos, coalesce(m.b, t) AS tag FROM e LEFT JOIN (VALUES ('red', 'crimson'), ('old', 'aged')) m(a, b) ON t = m.a")
def j11_mapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with their position, mapped by a table of aliases."""
    e = V.items(spark, sf_dir).select("id", F.posexplode("tags").alias("pos", "t"))
    m = spark.createDataFrame([("red", "crimson"), ("old", "aged")], "t string, b string")
    return e.join(F.broadcast(m), "t", "left").select("id", "pos", F.coalesce("b", "t").alias("tag"))


@query("j12_map_elements", "SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def j12_map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a map of arrays, then elements of each, counted."""
    e = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.array(F.get_json_object("props", "$.k"))).alias("m"))
    e = e.select("user_id", F.explode("m").alias("event_type", "ks")).select("user_id", "event_type", F.explode("ks").alias("k"))
    return e.groupBy("user_id", "event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("j13_update_from", "SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey AND s_acctbal > 0")
def j13_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of another table in place of the own ones where there are any."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    rows = table(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return rows.select("c_custkey", F.coalesce("s_name", "c_name").alias("name"), F.coalesce("s_acctbal", "c_acctbal").alias("balance"))


@query("j14_candidate_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def j14_candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a list of candidates."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(small(ids), "doc_id", "left_semi")


@query(
    "j15_three_ways",
    "SELECT CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN c.conv_id IS NULL THEN 'missing' ELSE 'compared' END AS outcome, count(*) AS n FROM documents d FULL JOIN (SELECT DISTINCT conv_id FROM conversations) c ON d.doc_id = c.conv_id GROUP BY 1",
)
def j15_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids are in both tables, in the first only, in the second only."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("b", F.lit(1))
    outcome = F.when(F.col("a").isNull(), "unknown").when(F.col("b").isNull(), "missing").otherwise("compared")
    return d.join(c, "doc_id", "full").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("j16_gold_predictions", "SELECT l.doc_id, quality AS gold, coalesce(p, 0) AS predicted FROM labels l LEFT JOIN (SELECT doc_id, 1 AS p FROM documents WHERE length(text) > 400) d ON l.doc_id = d.doc_id")
def j16_gold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows with the prediction of a rule; a missing one is empty."""
    p = table(spark, sf_dir, "documents").filter(F.length("text") > 400).select("doc_id", F.lit(1).alias("p"))
    return table(spark, sf_dir, "labels").join(p, "doc_id", "left").select("doc_id", F.col("quality").alias("gold"), F.coalesce("p", F.lit(0)).alias("predicted"))


@query("j17_counts_with_zeros", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 1000 GROUP BY n_name")
def j17_counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("j18_link_groups", "SELECT coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), 'none') AS file, count(*) AS n, string_agg(page_id, ',' ORDER BY page_id) AS pages FROM pages GROUP BY 1")
def j18_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a file, whose id stands in the link."""
    file = F.coalesce(F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")), F.lit("none"))
    return table(spark, sf_dir, "pages").groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("pages"))
