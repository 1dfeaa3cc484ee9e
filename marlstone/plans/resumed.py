"""Runs over the documents that break off, are taken up again and try failed inputs once more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import runs
from marlstone.plans.catalog import query
from marlstone.plans.joins import SPACE
from marlstone.plans.scratch import scratch_folder
from marlstone.sources.tables import table

SCHEMA = "key long, outcome string, digest string, attempt_no int"
_TOLD = f"""SELECT doc_id AS key, CASE WHEN trim(coalesce(text, '')) = '' THEN 'skipped' WHEN lang <> 'en' AND label THEN 'unchanged' ELSE 'done' END AS outcome,
  sha256(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))) AS digest, CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS attempt_no
FROM (SELECT d.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS label FROM documents d)"""


def _step(spark: SparkSession, sf_dir: str, attempt: int):
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("label", F.lit(True))

    def step(rows: DataFrame) -> DataFrame:
        told = rows.join(known, "doc_id", "left")
        failed = (F.col("source") == "src3") & F.lit(attempt == 0)  # a source that can't be reached at first
        outcome = F.when(failed, "failed").when(F.btrim(F.coalesce("text", F.lit(""))) == "", "skipped").when((F.col("lang") != "en") & F.coalesce("label", F.lit(False)), "unchanged").otherwise("done")
        return told.select("doc_id", outcome.alias("outcome"), T.content_hash(F.col("text")).alias("digest"), F.lit(attempt).alias("attempt_no"))

    return step


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each document after a run that stopped on its way, was taken up, and was tried again."""
    docs, target, run = table(spark, sf_dir, "documents"), scratch_folder(spark), runs.identity(task="refresh", version=1)
    for attempt in (0, 1):
        cursor = runs.carry_on(docs, "doc_id", _step(spark, sf_dir, attempt), target, run, attempt, batches=4, at_most=2)
        while cursor < 4:
            cursor = runs.carry_on(docs, "doc_id", _step(spark, sf_dir, attempt), target, run, attempt, batches=4)
    return runs.results(spark, target, run, SCHEMA)


@query("k12_resumed_run", _TOLD)
def k12_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's result is that of one unbroken run, from the attempt that finished it."""
    return refreshed(spark, sf_dir).select("key", "outcome", "digest", "attempt_no")


@query("k10_outcome_classes", f"SELECT outcome, count(*) AS n FROM ({_TOLD}) GROUP BY outcome")
def k10_outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the class of their outcome, after batches with a cursor."""
    return runs.outcomes(refreshed(spark, sf_dir))
