"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import evaluation as E
from marlstone.plans import views as V
from marlstone.plans.catalog import query
from marlstone.plans.scratch import small
from marlstone.sources.tables import table


@query("a1_filtered_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE length(text) > 1000) AS long FROM documents")
def a1_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counts in one scan."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.length("text") > 1000).alias("long"))


@query("a2_distinct_guard", "SELECT count(*) AS n, count(DISTINCT text) AS different FROM documents")
def a2_distinct_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and different texts; digests are counted, so no text is shuffled."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("text")).alias("different"))


@query("a3_merged_tags", f"WITH {V.ITEMS} SELECT brands[1] AS brand, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT brands, unnest(tags) AS t FROM items) GROUP BY 1")
def a3_merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the tags of each brand's items."""
    e = V.items(spark, sf_dir).select(F.col("brands")[0].alias("brand"), F.explode("tags").alias("t")).distinct()
    return e.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("tags"))


@query("a5_ordered_dedupe", f"WITH {V.ITEMS}, e AS (SELECT id, generate_subscripts(tags, 1) AS pos, unnest(tags) AS t FROM items), m AS (SELECT id, CASE WHEN t IN ('red', 'blue') THEN 'colour' WHEN t IN ('ring', 'bolt') THEN 'colour' ELSE t END AS t, min(pos) AS pos FROM e GROUP BY ALL) SELECT id, string_agg(t, ',' ORDER BY pos) AS tags FROM m GROUP BY id")
def a5_ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped tags without repeats, in the order of first sight."""
    m = T.folded(F.col("tags"), {"red": "colour", "blue": "colour", "ring": "colour", "bolt": "colour"})
    return V.items(spark, sf_dir).filter(F.size("tags") > 0).select("id", F.array_join(m, ",").alias("tags"))


@query("a6_object_of_arrays", "SELECT user_id, string_agg(event_type || '=' || ks, ';' ORDER BY event_type) AS m FROM (SELECT user_id, event_type, string_agg(DISTINCT k, '+' ORDER BY k) AS ks FROM (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE value > 10) WHERE k IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def a6_object_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of sorted arrays per user, without emptied entries."""
    e = table(spark, sf_dir, "events").filter("value > 10").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    per = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("k")).alias("ks")).filter(F.size("ks") > 0)
    entry = F.concat("event_type", F.lit("="), F.array_join("ks", "+"))
    return per.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("m"))


@query(
    "a7_user_activity",
    "SELECT user_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent, count(*) FILTER (WHERE event_type = 'signup') AS signups, greatest(max(CASE WHEN event_type = 'view' THEN ts END), max(CASE WHEN event_type = 'purchase' THEN ts END)) AS last FROM events GROUP BY user_id",
)
def a7_user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last days and the latest of several times, as of a given time."""
    kind, ts = F.col("event_type"), F.col("ts")
    recent = F.count_if(ts > F.expr("TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"))
    last = F.greatest(F.max(F.when(kind == "view", ts)), F.max(F.when(kind == "purchase", ts)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(recent.alias("recent"), F.count_if(kind == "signup").alias("signups"), last.alias("last"))


@query("a9_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a9_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a10_live_count", "SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def a10_live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


# Labels: what a rule predicts of the tags of parts against what their names say.
PAIRS = (
    f"{V.ITEMS}, truth AS (SELECT DISTINCT id, unnest(tags) AS value FROM items), "
    "pred AS (SELECT DISTINCT id, v AS value FROM (SELECT id, unnest(CASE WHEN size < 20 THEN [string_split(title, ' ')[1], 'gear'] ELSE [string_split(title, ' ')[2]] END) AS v FROM items)), "
    "m AS (SELECT coalesce(p.value, t.value) AS value, count(*) FILTER (WHERE p.id IS NOT NULL AND t.id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.id IS NULL) AS fp, count(*) FILTER (WHERE p.id IS NULL) AS fn "
    "FROM pred p FULL JOIN truth t ON p.id = t.id AND p.value = t.value GROUP BY 1), "
    "r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m)"
)


def label_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = V.items(spark, sf_dir)
    words = F.split("title", " ")
    rule = F.when(F.col("size") < 20, F.array(words[0], F.lit("gear"))).otherwise(F.array(words[1]))
    return i.select("id", F.explode(rule).alias("value")), i.select("id", F.explode("tags").alias("value"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_metrics(*label_sets(spark, sf_dir))


@query("a13_label_metrics", f"WITH {PAIRS} SELECT value, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def a13_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 per value."""
    return _metrics(spark, sf_dir).select("value", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a13_label_averages", f"WITH {PAIRS} SELECT round(avg(f1), 6) AS macro_f1, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall, round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1 FROM r")
def a13_label_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means and pooled rates."""
    a = E.averages(_metrics(spark, sf_dir))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query("a14_gate", f"WITH {PAIRS} SELECT value, 'f1' AS rule FROM r WHERE f1 < 0.7 UNION ALL SELECT value, 'recall' FROM r WHERE tp + fn >= 2 AND recall < 0.5 UNION ALL SELECT value, 'absent' FROM r WHERE tp + fn = 0 AND fp > 0")
def a14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under the floors, and predictions of values that no truth has."""
    return E.violations(_metrics(spark, sf_dir), f1=0.7, recall=0.5, support=2)


@query("a33_subset_rates", "WITH " + PAIRS.replace("FROM items)", "FROM items WHERE size > 10)", 1).replace("ELSE [string_split(title, ' ')[2]] END) AS v FROM items)", "ELSE [string_split(title, ' ')[2]] END) AS v FROM items WHERE size > 10)") + " SELECT round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1 FROM r")
def a33_subset_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled F1 over the rows of a subset."""
    keep = V.items(spark, sf_dir).filter("size > 10").select("id")
    p, t = (x.join(keep, "id", "left_semi") for x in label_sets(spark, sf_dir))
    return E.averages(E.label_metrics(p, t)).select(F.round("micro_f1", 6).alias("micro_f1"))


# Ranked lists: a query per nation, ranking its customers by balance; clusters are market segments of rich customers.
RANKS = (
    "ranked AS (SELECT c_nationkey AS query, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), "
    "gold AS (SELECT c_nationkey AS query, c_mktsegment AS cluster, c_custkey AS id FROM customer WHERE c_acctbal > 8000 OR c_acctbal < 0), "
    "hit AS (SELECT g.query, cluster, r.id, rank FROM ranked r JOIN gold g ON r.query = g.query AND r.id = g.id WHERE rank <= 10), "
    "q AS (SELECT s.query, coalesce(found, 0) / clusters AS recall_at_k, coalesce(good, 0) / 10 AS precision_at_k, coalesce(1.0 / first, 0) AS reciprocal_rank "
    "FROM (SELECT query, count(DISTINCT cluster) AS clusters FROM gold GROUP BY query) s LEFT JOIN (SELECT query, count(DISTINCT cluster) AS found, count(DISTINCT id) AS good, min(rank) AS first FROM hit GROUP BY query) USING (query))"
)


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    ranked = E.ranks(c.select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), "c_acctbal"), ["query"], [F.desc("c_acctbal"), F.col("id")])
    gold = c.filter("c_acctbal > 8000 OR c_acctbal < 0").select(F.col("c_nationkey").alias("query"), F.col("c_mktsegment").alias("cluster"), F.col("c_custkey").alias("id"))
    return ranked, gold


@query("a15_ranking_metrics", f"WITH {RANKS} SELECT query, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(reciprocal_rank, 6) AS reciprocal_rank FROM q")
def a15_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over clusters, precision and reciprocal rank of each query's first ten."""
    m = E.ranking_metrics(*rankings(spark, sf_dir))
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "precision_at_k", "reciprocal_rank")])


@query("a21_corpus_metrics", f"WITH {RANKS} SELECT round(avg(recall_at_k), 6) AS recall, round(avg(precision_at_k), 6) AS precision, round(avg(reciprocal_rank), 6) AS mrr, round(avg((recall_at_k >= 0.5)::INT), 6) AS pass_rate, count(*) FILTER (WHERE reciprocal_rank = 0) AS alarms FROM q")
def a21_corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all queries, the pass rate and the number of alarms."""
    m = E.ranking_metrics(*rankings(spark, sf_dir))
    mean = lambda c: F.round(F.avg(c), 6)
    return m.agg(
        mean("recall_at_k").alias("recall"), mean("precision_at_k").alias("precision"), mean("reciprocal_rank").alias("mrr"),
        mean((F.col("recall_at_k") >= 0.5).cast("int")).alias("pass_rate"), F.count_if(F.col("reciprocal_rank") == 0).alias("alarms"),
    )


@query("a16_flood", "WITH r AS (SELECT c_nationkey AS query, c_mktsegment AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT query, count(*) - count(DISTINCT k) AS repeats FROM r WHERE rank <= 10 GROUP BY query")
def a16_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a query's first ten whose key came before."""
    ranked, _ = rankings(spark, sf_dir)
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("k"))
    top = ranked.filter("rank <= 10").join(keys, "id")
    return top.groupBy("query").agg((F.count(F.lit(1)) - F.countDistinct("k")).alias("repeats"))


@query("a17_isolation", f"WITH {RANKS} SELECT query, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank)::INT AS first, string_agg(rank, ',' ORDER BY rank) AS ranks FROM ranked JOIN gold USING (query, id) GROUP BY query")
def a17_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a query's isolated ids are in its first ten, the first rank, and all ranks."""
    ranked, gold = rankings(spark, sf_dir)
    hit = ranked.join(gold, ["query", "id"])
    return hit.groupBy("query").agg(F.count_if(F.col("rank") <= 10).alias("hits"), F.min("rank").alias("first"), F.array_join(F.array_sort(F.collect_list("rank")), ",").alias("ranks"))


@query("a18_set_overlap", "SELECT s.n_nationkey AS nation, round(CASE WHEN a IS NULL AND b IS NULL THEN 1 ELSE coalesce(len(list_intersect(a, b)), 0) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) END, 6) AS overlap FROM nation s LEFT JOIN (SELECT c_nationkey AS n, list(DISTINCT c_mktsegment) AS a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) x ON x.n = n_nationkey LEFT JOIN (SELECT c_nationkey AS n, list(DISTINCT c_mktsegment) AS b FROM customer WHERE c_acctbal < 0 GROUP BY 1) y ON y.n = n_nationkey")
def a18_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of two result sets; two empty ones are equal."""
    c = table(spark, sf_dir, "customer")
    side = lambda test, name: c.filter(test).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias(name))
    both = table(spark, sf_dir, "nation").join(side("c_acctbal > 9000", "a"), "n_nationkey", "left").join(side("c_acctbal < 0", "b"), "n_nationkey", "left")
    return both.select(F.col("n_nationkey").alias("nation"), F.round(T.jaccard(F.col("a"), F.col("b"), both_empty=1.0), 6).alias("overlap"))


@query("a19_over_broad", "SELECT lang, count(*) AS n, count(*) > 0.5 * (SELECT count(*) FROM documents) AS broad FROM documents GROUP BY lang")
def a19_over_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that match more than half of all rows."""
    d = table(spark, sf_dir, "documents")
    total = d.agg(F.count(F.lit(1)).alias("total"))
    n = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select("lang", "n", (F.col("n") > 0.5 * F.col("total")).alias("broad"))  # total is one row


@query("a20_rank_movement", "WITH a AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, c_nationkey AS q FROM customer), b AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r, c_nationkey AS q FROM customer), m AS (SELECT q, CASE WHEN a.r <= 10 THEN a.r ELSE 11 END - CASE WHEN b.r <= 10 THEN b.r ELSE 11 END AS d FROM a JOIN b USING (id, q) WHERE a.r <= 10 OR b.r <= 10) SELECT q AS query, median(d)::DOUBLE AS median, max(d) AS most FROM m GROUP BY q")
def a20_rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and largest move between two rankings' first ten; what is absent stands at eleven."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), "c_acctbal", "c_name")
    a, b = (E.ranks(c, ["query"], o).filter("rank <= 10") for o in ([F.desc("c_acctbal"), F.col("id")], [F.col("c_name"), F.col("id")]))
    return E.rank_moves(a, b, 10)


@query("a22_prevalence", f"WITH {V.ITEMS}, e AS (SELECT id, size, CASE WHEN t IN ('red','blue','small','large','ring','bolt','widget','gear') THEN t ELSE 'other' END AS t FROM (SELECT id, size, unnest(tags) AS t FROM items)), v(value) AS (VALUES ('red'),('blue'),('small'),('large'),('ring'),('bolt'),('widget'),('gear'),('other'),('never')) SELECT value, count(DISTINCT id) AS now, count(DISTINCT CASE WHEN size <= 25 THEN id END) AS before, round(count(DISTINCT id) / (SELECT count(*) FROM items), 6) AS rate FROM v LEFT JOIN e ON t = value GROUP BY value")
def a22_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each value of a vocabulary, now and before; others in one bucket, zeros kept."""
    vocabulary = ["red", "blue", "small", "large", "ring", "bolt", "widget", "gear"]
    i = V.items(spark, sf_dir)
    e = i.select("id", "size", F.explode("tags").alias("t")).select("id", "size", F.when(F.col("t").isin(vocabulary), F.col("t")).otherwise("other").alias("value")).distinct()
    n = e.groupBy("value").agg(F.count(F.lit(1)).alias("now"), F.count_if(F.col("size") <= 25).alias("before"))
    v = spark.createDataFrame([(x,) for x in [*vocabulary, "other", "never"]], "value string")
    total = i.agg(F.count(F.lit(1)).alias("total"))
    out = v.join(F.broadcast(n), "value", "left").na.fill(0, ["now", "before"]).join(F.broadcast(total))  # n has at most as many rows as v
    return out.select("value", "now", "before", F.round(F.col("now") / F.col("total"), 6).alias("rate"))


@query("a23_run_summary", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS cost, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def a23_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums per outcome, frequent ones first."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))
    return e.orderBy(F.desc("n"), "event_type")


@query("a24_index_percentiles", "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, list_sort(list(value))[least(floor(count(*) * 0.5), count(*) - 1)::INT + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.9), count(*) - 1)::INT + 1] AS p90 FROM events GROUP BY event_type")
def a24_index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean value and percentiles by index floor(n p), from counts of different values."""
    return E.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9})


@query("a26_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def a26_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return E.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9}, nearest=True).select("event_type", "p50", "p90")


@query("a31_hash_spread", "SELECT digest, n, high - low AS spread FROM (SELECT sha256(lower(regexp_replace(title, '[^a-zA-Z]', '', 'g'))) AS digest, count(*) AS n, min(length(body)) AS low, max(length(body)) AS high FROM (SELECT split_part(text, chr(10), 1) AS title, text AS body FROM documents) GROUP BY 1) WHERE n > 1 AND high - low > 500 ORDER BY spread DESC, digest LIMIT 10")
def a31_hash_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hash groups whose members' lengths differ most; the hash is of a title's letters."""
    key = F.sha2(F.lower(F.regexp_replace("title", "[^a-zA-Z]", "")), 256)
    g = V.texts(spark, sf_dir).groupBy(key.alias("digest")).agg(F.count(F.lit(1)).alias("n"), (F.max(F.length("body")) - F.min(F.length("body"))).alias("spread"))
    return g.filter("n > 1 AND spread > 500").orderBy(F.desc("spread"), "digest").limit(10)


@query("a32_diff_tallies", f"WITH {V.ITEMS}, d AS (SELECT tags AS a, CASE WHEN size < 25 THEN ['Red', string_split(title, ' ')[2]] ELSE ['gear', string_split(title, ' ')[1]] END AS b FROM items WHERE tags IS NOT NULL) SELECT sum(len(list_filter(b, lambda x: NOT list_contains(a, x) AND NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x)))))::BIGINT AS adds, sum(len(list_filter(a, lambda x: NOT list_contains(b, x) AND NOT list_contains(list_transform(b, lambda y: lower(y)), lower(x)))))::BIGINT AS drops, sum(len(list_filter(b, lambda x: NOT list_contains(a, x) AND list_contains(list_transform(a, lambda y: lower(y)), lower(x)))))::BIGINT AS casing FROM d")
def a32_diff_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values added, dropped, and changed in case alone."""
    words = F.split("title", " ")
    new = F.when(F.col("size") < 25, F.array(F.lit("Red"), words[1])).otherwise(F.array(F.lit("gear"), words[0]))
    d = V.items(spark, sf_dir).filter(F.col("tags").isNotNull()).select(T.set_diff(F.col("tags"), new).alias("d"))
    return d.agg(*[F.sum(F.size(F.col("d")[k])).alias(k) for k in ("adds", "drops", "casing")])


@query("a36_canonical_score", f"WITH {V.ITEMS} SELECT id, round(0.4 * greatest(0, 1 - size / 50.0) + 0.4 * (coalesce(len(tags), 0) / 4.0) + 0.2 * least(1, price / 1000), 6) AS score FROM items")
def a36_canonical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted recency, completeness and coverage."""
    recency = F.greatest(F.lit(0.0), 1 - F.col("size") / 50.0)
    complete = F.coalesce(F.array_size("tags"), F.lit(0)) / 4.0
    return V.items(spark, sf_dir).select("id", F.round(0.4 * recency + 0.4 * complete + 0.2 * F.least(F.lit(1.0), F.col("price") / 1000), 6).alias("score"))


@query("a37_content_quality", "SELECT doc_id, round(least(1.0, 0.4::DOUBLE * regexp_matches(text, '[.]\\s')::INT + 0.3 * contains(text, chr(10))::INT + 0.2 * (length(text) > 500)::INT + 0.2 * regexp_matches(text, '[A-Z][a-z]+,')::INT), 6)::DOUBLE AS quality FROM documents")
def a37_content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted hits of section patterns and bonuses, at most 1."""
    t = F.col("text")
    hits = [(0.4, t.rlike(r"[.][ \t\n\f\r]")), (0.3, t.contains("\n")), (0.2, F.length(t) > 500), (0.2, t.rlike("[A-Z][a-z]+,"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.least(F.lit(1.0), sum((w * h.cast("int") for w, h in hits), F.lit(0.0))), 6).alias("quality"))


@query("a34_bootstrap")
def a34_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price with its 95 % interval from a thousand resamples; no SQL has the draws."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return E.bootstrap_mean(o, "value")
