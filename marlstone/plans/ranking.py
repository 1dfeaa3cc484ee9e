"""Latest and best rows, top-k lists, set operations, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import duplicates, sampling, workflow
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.joins import COSINE_SQL
from marlstone.sources.tables import table


@query("w1_earlier_reviews", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE rn > 1")
def w1_earlier_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the latest review, for the archive."""
    return workflow.earlier(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("role")]).select("conv_id", "turn")


@query("w2_latest_version", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def w2_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, by a partial maximum instead of a sort."""
    last = F.max(F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last["o_orderkey"].alias("o_orderkey"))


@query("w3_preferred_source", "SELECT DISTINCT ON (key) key, name, source FROM (SELECT s_suppkey AS key, s_name AS name, 'primary' AS source, 0 AS p FROM supplier UNION ALL SELECT c_custkey, c_name, 'fallback', 1 FROM customer) ORDER BY key, p")
def w3_preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key: from the first source that has it."""
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "'primary' AS source", "0 AS p")
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "'fallback'", "1")
    return a.union(b).groupBy("key").agg(F.min_by(F.struct("name", "source"), "p").alias("s")).select("key", "s.name", "s.source")


@query("w5_top_match", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber")
def w5_top_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each submission."""
    best = F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("l_partkey"))


@query("w6_best_of_group", "SELECT DISTINCT ON (p_name) p_name AS title, p_partkey AS id FROM part ORDER BY p_name, p_retailprice DESC, p_size DESC, CASE WHEN p_size > 5 THEN p_size END DESC NULLS LAST, p_partkey")
def w6_best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item to keep of each group: score, completeness, date (undated last), id."""
    dated = F.when(F.col("size") > 5, F.col("size"))
    return duplicates.best_of(V.items(spark, sf_dir), "title", [F.desc("price"), F.desc("size"), dated.desc_nulls_last(), F.col("id")]).select("title", "id")


@query("w7_rank_position", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS position FROM customer")
def w7_rank_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).alias("position"))


@query("o4_top_similar", f"WITH {V.ITEMS}, s AS (SELECT id, {V.jaccard_sql(V.trigrams_sql('title'), V.trigrams_sql(chr(39) + 'red widget' + chr(39)))} AS a, {V.jaccard_sql(V.trigrams_sql('kinds[1]'), V.trigrams_sql(chr(39) + 'economy' + chr(39)))} AS b FROM items) SELECT id, round(greatest(a, b), 6) AS sim FROM s WHERE greatest(a, b) >= 0.45 ORDER BY greatest(a, b) DESC, id LIMIT 20")
def o4_top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty items most alike in title or kind, above a floor."""
    sim = F.greatest(T.trigram_similarity(F.col("title"), F.lit("red widget")), T.trigram_similarity(F.col("kinds")[0], F.lit("economy")))
    top = V.items(spark, sf_dir).select("id", sim.alias("s")).filter("s >= 0.45").orderBy(F.desc("s"), "id").limit(20)
    return top.select("id", F.round("s", 6).alias("sim"))


@query("o6_nearest_vectors", f"SELECT y.vec_id, round({COSINE_SQL}, 6) AS cosine, CASE WHEN {COSINE_SQL} >= 0.95 THEN 'exact' WHEN {COSINE_SQL} >= 0.85 THEN 'high' WHEN {COSINE_SQL} >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM embeddings x JOIN embeddings y ON x.vec_id = 7 ORDER BY {COSINE_SQL} DESC, y.vec_id LIMIT 25")
def o6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to a given one, against all rows, with their similarity band."""
    e = table(spark, sf_dir, "embeddings")
    given = e.filter("vec_id = 7").limit(1).select(F.col("embedding").alias("given"))
    sim = T.cosine(F.col("given"), F.col("embedding"))
    near = e.join(F.broadcast(given)).select("vec_id", sim.alias("s")).orderBy(F.desc("s"), "vec_id").limit(25)  # given is one row
    return near.select("vec_id", F.round("s", 6).alias("cosine"), T.similarity_band(F.col("s")).alias("band"))


@query("u2_distinct_union", "SELECT p_brand AS v FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer")
def u2_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    return p.selectExpr("p_brand AS v").union(p.select("p_type")).union(c.select("c_mktsegment")).distinct()


@query("u3_array_algebra", f"WITH {V.ITEMS} SELECT id, array_to_string(list_filter(tags, lambda t: t NOT IN ('red', 'gear')), ',') AS rest, array_to_string(list_filter(tags, lambda t: t IN ('red', 'gear')), ',') AS shared, array_to_string(list_concat(tags, list_filter(['red', 'gear'], lambda t: NOT list_contains(tags, t))), ',') AS union FROM items WHERE tags IS NOT NULL")
def u3_array_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union, difference and intersection of arrays."""
    other = F.array(F.lit("red"), F.lit("gear"))
    parts = {"rest": F.array_except("tags", other), "shared": F.array_intersect("tags", other), "union": F.array_distinct(F.concat("tags", other))}
    return V.items(spark, sf_dir).filter(F.col("tags").isNotNull()).select("id", *[F.array_join(c, ",").alias(n) for n, c in parts.items()])


@query("m1_seeded_order", "SELECT p_partkey, md5(p_partkey || ':11') AS draw FROM part ORDER BY draw, p_partkey")
def m1_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items in an order drawn by a seed, with their draws."""
    rows = table(spark, sf_dir, "part").select("p_partkey", sampling.draw("p_partkey", 11).alias("draw"))
    return sampling.shuffled(rows, "p_partkey", 11)


@query(
    "m2_strata",
    "WITH d AS (SELECT doc_id, lang, length(text) AS n FROM documents), q AS (SELECT lang, quantile_disc(n, 0.25) AS a, quantile_disc(n, 0.5) AS b, quantile_disc(n, 0.75) AS c FROM d GROUP BY lang) "
    "SELECT lang || ':' || (1 + (n > a)::INT + (n > b)::INT + (n > c)::INT) AS stratum, count(*) AS n FROM d JOIN q USING (lang) GROUP BY 1",
)
def m2_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of language and length quartile, with their sizes."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    cuts = d.groupBy("lang").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    part = 1 + sum(((F.col("n") > F.col(f"q{i}")).cast("int") for i in range(3)), F.lit(0))
    rows = d.join(F.broadcast(cuts), "lang")  # a row a language
    return rows.groupBy(F.concat("lang", F.lit(":"), part.cast("string")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def _stratified_sql(rows: str, id_col: str, stratum: str, size: str, seed: int) -> str:
    """The SQL of sampling.stratified."""
    return (
        f"(SELECT {id_col}, {stratum} FROM (SELECT {id_col}, {stratum}, nth, (nth > round(n * {size} / greatest(total, 1)))::INT AS late FROM ("
        f"SELECT {id_col}, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({id_col} || ':{seed}'), {id_col}) AS nth, count(*) OVER (PARTITION BY {stratum}) AS n, count(*) OVER () AS total "
        f"FROM {rows}) WHERE nth <= {size}) ORDER BY late, nth, {id_col} LIMIT {size})"
    )


@query("m3_stratified_sample", f"SELECT * FROM {_stratified_sql('documents', 'doc_id', 'lang', '120', 1)}")
def m3_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 120 documents in proportion to their languages."""
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 120)


@query(
    "m4_layered_sample",
    f"WITH RECURSIVE {V.ITEMS}, r AS (SELECT * FROM items WHERE len(tags) > 0), "
    "k AS (SELECT id, kinds[1] AS kind, row_number() OVER (PARTITION BY kinds[1] ORDER BY md5(id || ':1'), id) AS nth FROM r WHERE size > 47), "
    "hard AS (SELECT id FROM k WHERE nth <= 60 ORDER BY nth, kind LIMIT 20), have AS (SELECT list(v) AS vs FROM (SELECT unnest(list_distinct(tags)) AS v FROM r WHERE id IN (SELECT id FROM hard))), "
    "rest AS (SELECT id, list_distinct(tags) AS vs, md5(id || ':2') AS draw FROM r WHERE id NOT IN (SELECT id FROM hard)), "
    "pick AS (SELECT 0 AS step, 0 AS id, 0 AS gain, '' AS draw, coalesce((SELECT vs FROM have), []) AS held, []::BIGINT[] AS ids UNION ALL "
    "SELECT step + 1, b.id, b.gain, b.draw, list_concat(held, b.vs), list_append(ids, b.id) FROM (SELECT p.step, p.held, p.ids, "
    "arg_min(struct_pack(id := rest.id, vs := rest.vs, draw := rest.draw, gain := len(list_filter(rest.vs, lambda v: len(list_filter(p.held, lambda x: x = v)) < 2))), "
    "struct_pack(g := -len(list_filter(rest.vs, lambda v: len(list_filter(p.held, lambda x: x = v)) < 2)), d := rest.draw, i := rest.id)) AS b "
    "FROM pick p JOIN rest ON NOT list_contains(p.ids, rest.id) GROUP BY ALL) WHERE b.gain > 0), "
    "cover AS (SELECT id FROM pick WHERE step > 0 ORDER BY gain DESC, draw, id LIMIT (SELECT 60 - count(*) FROM hard)), "
    "taken AS (SELECT id, 'hard' AS layer FROM hard UNION ALL SELECT id, 'cover' FROM cover), left_over AS (SELECT id, size FROM r WHERE id NOT IN (SELECT id FROM taken)) "
    "SELECT id, layer FROM taken UNION ALL SELECT id, 'fill' FROM " + _stratified_sql("left_over", "id", "size", "(SELECT greatest(0, 60 - count(*)) FROM taken)", 3),
)
def m4_layered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard cases in turn, then a greedy cover until each value is there twice, then a stratified fill (M4)."""
    return sampling.layered(V.items(spark, sf_dir).filter(F.size("tags") > 0), "id", "tags", F.when(F.col("size") > 47, F.col("kinds")[0]), "size", 60)


@query("m5_bucket_sizes", f"WITH {V.ITEMS} SELECT bucket, least(10, count(*)) AS n FROM (SELECT CASE WHEN tags IS NULL OR len(tags) = 0 THEN 'edge' WHEN size >= 30 THEN 'heavy' ELSE 'light' END AS bucket FROM items) GROUP BY bucket")
def m5_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot checks: ten rows of each bucket, counted."""
    bucket = F.when(F.coalesce(F.size("tags"), F.lit(-1)) <= 0, "edge").when(F.col("size") >= 30, "heavy").otherwise("light")
    return sampling.per_bucket(V.items(spark, sf_dir).select("id", bucket.alias("bucket")), "id", "bucket", 10).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
