"""Curation workflow and batch scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import workflow as K
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.scratch import scratch_folder, small
from marlstone.sources.tables import table
from marlstone.streaming.derive import keep_postings

BLANK = r"regexp_matches(trim(x), '^(-{3,}|\[.*\]|(?i:summary:).*)$')"


@query(
    "k1_publish",
    f"SELECT doc_id, coalesce(nullif(role, ''), 'none') AS decision, md5(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT {BLANK})[1])) AS title FROM documents d "
    "LEFT JOIN (SELECT DISTINCT ON (conv_id) conv_id, role FROM conversations ORDER BY conv_id, turn DESC, role DESC) c ON conv_id = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def k1_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved and unpublished rows with their latest review and a title from the body's first real line."""
    d = K.unpublished(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id")
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max(F.struct("turn", "role"))["role"].alias("role"))
    return d.join(last, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("role", F.lit("")), F.lit("none")).alias("decision"), F.md5(K.first_line(F.col("text"))).alias("title"))


@query(
    "k2_decisions",
    "SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance, CASE WHEN s_suppkey IS NULL THEN 1 WHEN c_custkey IS NULL THEN 1 ELSE 2 END AS version, "
    "CASE WHEN s_suppkey IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS status FROM customer FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey",
)
def k2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved submissions inserted, or merged over the row they update as its next version."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))
    new = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return K.decided(old, new, "key", ["name", "balance"])


@query(
    "k3_resolve_group",
    f"WITH {V.ITEMS}, r AS (SELECT *, min(id) OVER (PARTITION BY title) AS keep FROM items) SELECT keep AS id, count(*) - 1 AS archived, coalesce((SELECT string_agg(DISTINCT b, ',' ORDER BY b) FROM (SELECT unnest(brands) AS b FROM r x WHERE x.keep = r.keep)), '') AS brands FROM r GROUP BY keep",
)
def k3_resolve_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by title: the first row stays with the brands of all, the others go to the archive."""
    i = V.items(spark, sf_dir)
    keep = i.groupBy("title").agg(F.min("id").alias("keep"), (F.count(F.lit(1)) - 1).alias("archived"))
    tags = K.merged_tags(i, "title", "brands")
    return keep.join(tags, "title", "left").select(F.col("keep").alias("id"), "archived", F.array_join(F.coalesce("brands", T.strings()), ",").alias("brands"))


@query("k4_retire", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS retired, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' END AS retired_reason FROM documents")
def k4_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.retired(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels").filter("toxic = 1"), "toxic")


@query("k5_canonical", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical FROM part")
def k5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that each item was resolved to, or its own."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("canonical"))
    resolved = p.join(first, ["p_name", "p_brand"]).filter("p_partkey > canonical").select(F.col("p_partkey").alias("id"), "canonical")
    return K.canonical(p.select(F.col("p_partkey").alias("id")), resolved)


@query(
    "k7_review_details",
    f"WITH {V.TEXTS} SELECT c.conv_id, c.turn, md5(substr(body, 1, 500)) AS preview, body LIKE '%|%|%' AS is_table, coalesce(length(body), 0) AS n FROM conversations c LEFT JOIN texts ON conv_id = id",
)
def k7_review_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a 500-character preview of the text that they are about."""
    b = F.col("body")
    t = V.texts(spark, sf_dir).select(F.col("id").alias("conv_id"), F.md5(F.substring(b, 1, 500)).alias("preview"), b.like("%|%|%").alias("is_table"), F.length(b).alias("len"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").join(t, "conv_id", "left").select("conv_id", "turn", "preview", "is_table", F.coalesce("len", F.lit(0)).alias("n"))


@query(
    "k8_attribution",
    "WITH a AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS made, count(*) FILTER (WHERE event_type = 'signup') AS n, count(DISTINCT CASE WHEN event_type = 'signup' THEN value > 10 END) AS kinds, max(CASE WHEN event_type = 'purchase' THEN ts END) AS edited FROM events GROUP BY user_id) "
    "SELECT user_id, CASE WHEN n = 0 THEN 'no_create' WHEN n > 1 AND kinds > 1 THEN 'ambiguous' WHEN edited IS NULL THEN 'no_edit' WHEN edited <= made THEN 'edit_before' ELSE 'attributed' END AS outcome FROM a",
)
def k8_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered table of reasons that refuse an attribution; what none refuses is attributed (K8, K9)."""
    kind = F.col("event_type")
    sign = kind == "signup"
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.when(sign, F.col("ts"))).alias("made"), F.count_if(sign).alias("n"), F.countDistinct(F.when(sign, F.col("value") > 10)).alias("kinds"),
        F.max(F.when(kind == "purchase", F.col("ts"))).alias("edited"),
    )
    rules = [("no_create", F.col("n") == 0), ("ambiguous", (F.col("n") > 1) & (F.col("kinds") > 1)), ("no_edit", F.col("edited").isNull()), ("edit_before", F.col("edited") <= F.col("made"))]
    return a.select("user_id", K.first_reason(rules, "attributed").alias("outcome"))


@query("k12_run_identity", "SELECT o_orderkey, sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || '|' || length(o_orderstatus) || ':' || o_orderstatus) AS run FROM orders")
def k12_run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", K.run_identity([F.col("o_orderkey"), F.col("o_orderstatus")]).alias("run"))


# Batch scripts -----------------------------------------------------------------------------


@query("x1_content_triage", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN contains(text, '|') THEN 'table' WHEN length(text) < 200 THEN 'short' WHEN contains(lower(text), 'http') THEN 'links' ELSE 'full' END AS class FROM documents")
def x1_content_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered tests that put each body into one class."""
    t = F.col("text")
    rules = [("empty", t.isNull() | (F.trim(t) == "")), ("table", t.contains("|")), ("short", F.length(t) < 200), ("links", F.lower(t).contains("http"))]
    return table(spark, sf_dir, "documents").select("doc_id", K.first_reason(rules, "full").alias("class"))


@query("x2_first_lines", f"WITH {V.TEXTS} SELECT md5(title) AS line, count(*) AS n FROM texts GROUP BY 1 ORDER BY n DESC, line LIMIT 5")
def x2_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest first lines."""
    return V.texts(spark, sf_dir).groupBy(F.md5("title").alias("line")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "line").limit(5)


@query("x4_restore_missing", "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT conv_id, 'restored' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def x4_restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the rows that only its source still has."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    kept = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").join(lab, "id", "left_semi")
    source = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return kept.union(source.join(lab, "id", "left_anti").withColumn("lang", F.lit("restored")))


@query(
    "x6_hash_audit",
    "WITH h AS (SELECT doc_id, md5(lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))) AS old, md5(lang || text) AS new FROM documents) SELECT 'resolved' AS kind, count(*) AS n FROM (SELECT old FROM h GROUP BY old HAVING count(DISTINCT new) > 1) UNION ALL SELECT 'new', count(*) FROM (SELECT new FROM h GROUP BY new HAVING count(DISTINCT old) > 1)",
)
def x6_hash_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a new hash of text and language splits, and groups that it makes of those of a hash of letters; whole texts."""
    h = table(spark, sf_dir, "documents").select(F.md5(F.lower(F.regexp_replace("text", "[^a-zA-Z]", ""))).alias("old"), F.md5(F.concat("lang", "text")).alias("new"))
    count = lambda by, other, kind: h.groupBy(by).agg(F.countDistinct(other).alias("k")).filter("k > 1").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("old", "new", "resolved").union(count("new", "old", "new"))


@query("x9_vocabulary", "WITH v AS (SELECT p_brand AS label, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS norm FROM part) SELECT norm, count(DISTINCT label) AS labels, count(*) AS n FROM v GROUP BY norm HAVING count(*) > 1")
def x9_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of a vocabulary's labels, with those that collide."""
    v = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "").alias("norm"))
    return v.groupBy("norm").agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("x11_decisions", "SELECT verdict, count(*) AS n, sum(retired)::BIGINT AS retired FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderstatus AS verdict, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS retired FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) GROUP BY verdict")
def x11_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after later ones replaced earlier ones, and how many rows they retire."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))["o_orderstatus"].alias("verdict"))
    retired = F.when(F.col("verdict") == "F", 2).when(F.col("verdict") == "P", 1).otherwise(0)
    return last.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(retired).alias("retired"))


@query("x12_changed_keys", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '7' THEN '' ELSE 'k,' END || 'type' AS changed FROM events WHERE event_type <> 'view'")
def x12_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two JSON objects whose values differ, a missing one included."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    old, new = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")), F.create_map(F.lit("k"), F.lit("7"))
    return e.select("event_id", F.array_join(T.changed_keys(old, new), ",").alias("changed"))


@query("x13_title_summary", f"WITH {V.TEXTS} SELECT id, md5(title) AS title, md5(substr(split_part(body, chr(10) || chr(10), 1), 1, 500)) AS summary FROM texts")
def x13_title_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title from the first line and a summary from the first 500 characters of the first paragraph."""
    return V.texts(spark, sf_dir).select("id", F.md5("title").alias("title"), F.md5(F.substring(F.substring_index("body", "\n\n", 1), 1, 500)).alias("summary"))


@query("x14_dates", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def x14_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in two formats; others are null."""
    s = F.col("o_orderstatus")
    raw = F.when(s == "O", F.date_format("o_orderdate", "M/d/yyyy")).when(s == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parsed_date(raw).alias("day"))


@query("x15_prefill", "SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_type ELSE p_name END AS title FROM part")
def x15_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft fills only what is empty or blank."""
    own = F.when(F.col("p_size") > 45, F.lit("  ")).when(F.col("p_size") > 40, F.lit(None)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.when(F.btrim(own) != "", own), F.col("p_type")).alias("title"))


@query("x18_cell_tags", "SELECT page_id, array_to_string(list_filter(['en', 'fr', 'de', 'es', 'page', 'ref'], lambda v: list_contains(regexp_extract_all(split_part(url, '//', 2), '[a-z]+'), v)), ',') AS tags FROM pages")
def x18_cell_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a closed vocabulary that stand as words in a labelled section."""
    words = F.regexp_extract_all(F.split("url", "//")[1], F.lit("[a-z]+"), F.lit(0))
    vocabulary = F.array(*[F.lit(v) for v in ("en", "fr", "de", "es", "page", "ref")])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.filter(vocabulary, lambda v: F.array_contains(words, v)), ",").alias("tags"))


@query("stream_postings", f"WITH {V.TEXTS} SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(list_concat({V.words_sql('title')}, {V.words_sql('body')})) AS word FROM texts) GROUP BY word")
def stream_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings kept up to date by a stream of new rows; an extension, as the reference has triggers instead."""
    source, target, state = (scratch_folder(spark) for _ in range(3))
    V.texts(spark, sf_dir).select("id", "title", "body").write.parquet(source)
    keep_postings(spark, source, "id long, title string, body string", target, state).awaitTermination()
    return spark.read.parquet(target).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
