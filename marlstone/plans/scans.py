"""Scans, readers and writers. What a query writes goes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import workflow
from marlstone.plans.catalog import query
from marlstone.plans.scratch import scratch_folder, small, written
from marlstone.sources import readers
from marlstone.sources.tables import table


@query("s1_facet_projection", "SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size FROM part")
def s1_facet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet columns of all items, without a row cap."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


@query("s2_flattened_json", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def s2_flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON keys as columns; a missing key is null."""
    p = F.from_json("props", "k bigint, none string")
    return table(spark, sf_dir, "events").withColumn("p", p).select("event_id", "event_type", "p.k", F.col("p.none").alias("missing"))


@query("s3_active_profiles", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0")
def s3_active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe columns of the active profiles."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")


@query("s4_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 420 ORDER BY o_orderkey LIMIT 50")
def s4_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty orders after a cursor."""
    return readers.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 420, 50)


@query(
    "s5_corpus_export",
    r"""SELECT doc_id AS id, b.text IS NOT NULL AS overridden, length(t) AS n, sha256(t) AS digest FROM (
    SELECT doc_id, b.text AS bt, replace(replace(coalesce(b.text, d.text), chr(11), ''), chr(13) || chr(10), chr(10)) AS t
    FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id) x LEFT JOIN benchmark b ON x.doc_id = b.item_id""",
)
def s5_corpus_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies, overridden where there is a better one, written as JSON lines and read back."""
    better = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("better"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(small(better), "id", "left")
    path = scratch_folder(spark)
    d.select("id", F.col("better").isNotNull().alias("overridden"), readers.plain_body(F.coalesce("better", "text")).alias("body")).write.json(path)
    back = readers.json_lines(spark, path, "id long, overridden boolean, body string", ["id"])
    return back.select("id", "overridden", F.length("body").alias("n"), F.sha2("body", 256).alias("digest"))


@query("s6_json_array", "SELECT n_nationkey, n_name FROM nation")
def s6_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one JSON array: the nations, which are few."""
    path = scratch_folder(spark)
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))).coalesce(1).write.text(path)
    return readers.json_array(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("s7_json_lines", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')")
def s7_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log whose broken lines and lines without a type are skipped."""
    path = scratch_folder(spark)
    whole = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), F.col("event_type"))).when(F.col("event_type") == "click", F.to_json(F.struct("event_id"))).otherwise(whole)
    table(spark, sf_dir, "events").select(broken).write.text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string", ["event_id", "event_type"])


@query("s8_worksheets", "SELECT p_name || ' \"' || p_size || '\"' AS title, min(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def s8_worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted CSV files merged by key, without the keys whose rows differ."""
    paths = [scratch_folder(spark), scratch_folder(spark)]
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit('"')).alias("title"), F.col("p_brand").alias("brand"))
    for p in paths:
        rows.write.option("quoteAll", True).option("escape", '"').csv(p, header=True)
    return readers.worksheets(spark, paths, "title", ["title", "brand"])[0].select("title", "brand")


@query(
    "s9_document_trees",
    "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn) || chr(10) || '---' || chr(10) || 'turns | ' || count(*) || chr(10)) AS digest FROM conversations GROUP BY conv_id",
)
def s9_document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of document trees: a paragraph a turn, a rule, and a table with the number of turns."""
    run = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(F.struct(F.array(F.struct(F.struct(t["text"].alias("content")).alias("textRun"))).alias("elements")).alias("paragraph")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(run).alias("runs"), F.count(F.lit(1)).alias("n"))
    cell = lambda x: F.concat(F.lit('{"content":[{"paragraph":{"elements":[{"textRun":{"content":"'), x, F.lit('"}}]}}]}'))
    grid = F.concat(F.lit('{"table":{"tableRows":[{"tableCells":['), cell(F.lit("turns")), F.lit(","), cell(F.col("n").cast("string")), F.lit("]}]}}"))
    tree = F.concat(F.lit('{"body":{"content":'), F.expr("left(runs, length(runs) - 1)"), F.lit(',{"sectionBreak":{"sectionStyle":"s"}},'), grid, F.lit("]}}"))
    return c.select("conv_id", F.sha2(readers.tree_text(tree), 256).alias("digest"))


@query("s10_inline_table", "SELECT event_id, label FROM events JOIN (VALUES ('view', 'seen'), ('click', 'used'), ('purchase', 'bought')) v(t, label) ON event_type = t")
def s10_inline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join with a table of literal values."""
    names = spark.createDataFrame([("view", "seen"), ("click", "used"), ("purchase", "bought")], "event_type string, label string")
    return table(spark, sf_dir, "events").join(F.broadcast(names), "event_type").select("event_id", "label")


@query(
    "s11_upsert",
    "SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name, s_suppkey IS NOT NULL AS fresh FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
)
def s11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded rows replace the kept rows of their key; rows without a key or name are dropped."""
    kept = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(False).alias("fresh"))
    loaded = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(True).alias("fresh"))
    return workflow.upserted(kept, loaded.na.drop(subset=["key", "name"]).dropDuplicates(["key"]), "key")


@query("s12_appended_results", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def s12_appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended twice to one table."""
    path = scratch_folder(spark)
    for _ in range(2):
        table(spark, sf_dir, "events").select("event_id", "event_type").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s14_report_lines", """SELECT '{"source":"' || source || '","n":' || count(*) || '}' AS line FROM documents GROUP BY source""")
def s14_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with one JSON object a line."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.to_json(F.struct("source", "n")).alias("line"))


@query("s16_pre_image", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def s16_pre_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a rewrite will touch, written before it."""
    touched = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    return written(table(spark, sf_dir, "documents").join(touched, "doc_id", "left_semi")).select("doc_id", F.md5("text").alias("digest"))


@query("x7_labelled_text", "SELECT event_id, event_type || ': ' || json_extract_string(props, '$.k') AS line FROM events")
def x7_labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled parts joined into one text, without the missing ones."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.labelled([(F.col("event_type"), F.get_json_object("props", "$.k")), (F.lit("none"), F.get_json_object("props", "$.none"))]).alias("line"))
