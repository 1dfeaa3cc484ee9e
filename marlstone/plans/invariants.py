"""Expectations over the tables: invariants, failing rows, labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import expectations as E
from marlstone.plans.catalog import query
from marlstone.sources.tables import table

LANGS = ("de", "en", "es")
_TESTS = {
    "length": ("n_chars = length(text)", "text IS NOT NULL", 0),
    "language": ("lang IN ('de', 'en', 'es')", "true", 200),
    "several lines": ("contains(text, chr(10))", "n_chars > 1000", 0),
    "source": ("regexp_matches(source, '^src[0-9]+$')", "true", 0),
    "no mail": ("NOT contains(text, '@')", "lang = 'en'", 0),
}


def _expected() -> list[E.Expectation]:
    text, lang = F.col("text"), F.col("lang")
    return [
        E.Expectation("length", F.col("n_chars") == F.length(text), text.isNotNull()),
        E.Expectation("language", lang.isin(*LANGS), at_most=200),
        E.Expectation("several lines", text.contains("\n"), F.col("n_chars") > 1000),
        E.Expectation("source", F.col("source").rlike("^src[0-9]+$")),
        E.Expectation("no mail", ~text.contains("@"), lang == "en"),
    ]


@query(
    "x10_expectations",
    " UNION ALL ".join(
        f"SELECT '{name}' AS expectation, count(*) FILTER (WHERE {when}) AS tested, count(*) FILTER (WHERE ({when}) AND NOT coalesce({test}, false)) AS failed, "
        f"count(*) FILTER (WHERE ({when}) AND NOT coalesce({test}, false)) <= {most} AS met FROM documents"
        for name, (test, when, most) in _TESTS.items()
    ),
)
def x10_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the documents with the rows tested and failed, in one pass."""
    return E.checked(table(spark, sf_dir, "documents"), _expected())


@query("x10_failing_rows", " UNION ALL ".join(f"SELECT doc_id, '{name}' AS expectation FROM documents WHERE ({when}) AND NOT coalesce({test}, false)" for name, (test, when, _) in _TESTS.items()))
def x10_failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside the invariants that it fails."""
    return E.failing(table(spark, sf_dir, "documents"), "doc_id", _expected())


KINDS = ("click", "purchase", "refund", "view")


@query(
    "x8_label_distribution",
    "WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS labels FROM events GROUP BY user_id), e AS (SELECT unnest(labels) AS v FROM s) "
    "SELECT v.value, count(e.v) AS n FROM (VALUES ('click'), ('purchase'), ('refund'), ('view')) v(value) LEFT JOIN e ON e.v = v.value GROUP BY v.value "
    "UNION ALL SELECT '(off vocabulary)', count(*) FROM e WHERE v NOT IN ('click', 'purchase', 'refund', 'view')",
)
def x8_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the kinds of their events, with the kinds that nobody has and those of no vocabulary."""
    samples = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))  # at most one of each kind
    return E.distribution(samples, F.col("labels"), KINDS)


@query(
    "x8_sample_errors",
    "WITH s AS (SELECT l.doc_id, d.doc_id IS NULL OR trim(coalesce(d.text, '')) = '' AS no_body, d.lang IS NOT NULL AND d.lang NOT IN ('de', 'en', 'es') AS off, quality = 1 AND toxic = 1 AS twice "
    "FROM (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT item_id + 1000000000, 0, 1 FROM benchmark) l LEFT JOIN documents d USING (doc_id)) "
    "SELECT doc_id, 'missing body' AS expectation FROM s WHERE no_body UNION ALL SELECT doc_id, 'vocabulary' FROM s WHERE NOT no_body AND off UNION ALL SELECT doc_id, 'one label' FROM s WHERE twice",
)
def x8_sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples without a body, off the vocabulary of languages, or with two labels that exclude each other."""
    more = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit(0), F.lit(1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").union(more)
    s = labels.join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "left")
    body = F.btrim(F.coalesce("text", F.lit(""))) != ""
    expected = [E.Expectation("missing body", body), E.Expectation("vocabulary", F.col("lang").isin(*LANGS), body & F.col("lang").isNotNull()), E.Expectation("one label", F.col("quality") + F.col("toxic") < 2)]
    return E.failing(s, "doc_id", expected)
