"""Runs that can be broken off and taken up again: batches, outcomes, and a ledger of what is finished."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outcomes after which an input isn't looked at again by the same run.
FINAL = ("done", "unchanged", "skipped")


def identity(**parts) -> str:
    """The name of a run: a digest of everything that its results depend on, each part framed by its name and length."""
    framed = "".join(f"{len(k)}:{k}{len(v)}:{v}" for k, v in ((k, json.dumps(parts[k], sort_keys=True)) for k in sorted(parts)))
    return hashlib.sha256(framed.encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def finished_batches(spark: SparkSession, target: str, run: str, attempt: int, batches: int) -> list[int]:
    """The batches of an attempt that are complete: Spark marks a folder as the last step of writing it."""
    return [b for b in range(batches) if _exists(spark, f"{target}/run={run}/attempt={attempt}/batch={b}/_SUCCESS")]


def results(spark: SparkSession, target: str, run: str, schema: str) -> DataFrame:
    """The latest row of each key among all attempts of a run, with the attempt and the batch that wrote it."""
    path = f"{target}/run={run}"
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, attempt int, batch int")
    rows = spark.read.schema(f"{schema}, attempt int, batch int").parquet(path)
    last = rows.groupBy("key").agg(F.max("attempt").alias("attempt"))
    return rows.join(last, ["key", "attempt"], "left_semi")


def carry_on(
    inputs: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], target: str, run: str, attempt: int = 0, batches: int = 8, at_most: int | None = None
) -> int:
    """Works off the batches of ``inputs`` that aren't finished and returns the next one to do, ``batches`` when all are.

    ``step`` turns the inputs of a batch into rows (``key``, outcome, ...), one a key. A batch holds the keys with one
    remainder of their hash, is written to a folder of its own and counts once that folder is complete,
    so a batch that broke off is done again whole and replaces what it left: a run that is broken
    and taken up any number of times ends with the rows of one run. A later ``attempt`` goes only
    over keys that have no row with an outcome of FINAL yet: failed ones, and inputs that came since.
    ``at_most`` stops after so many batches. Keys must be unique and not null; rows with a null key are left out.
    """
    spark = inputs.sparkSession
    rows = inputs.filter(F.col(key).isNotNull())
    if attempt:
        kind = inputs.schema[key].dataType.simpleString()
        before = results(spark, target, run, f"key {kind}, outcome string").filter((F.col("attempt") < attempt) & F.col("outcome").isin(*FINAL))
        rows = rows.join(before.select(F.col("key").alias(key)), key, "left_anti")
    done = set(finished_batches(spark, target, run, attempt, batches))
    left = [b for b in range(batches) if b not in done]
    for b in left[:at_most]:
        own = rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)) == b)
        step(own).withColumnRenamed(key, "key").write.mode("overwrite").parquet(f"{target}/run={run}/attempt={attempt}/batch={b}")
    rest = left[at_most:] if at_most is not None else []
    return rest[0] if rest else batches


def outcomes(rows: DataFrame) -> DataFrame:
    """(outcome, n) of the latest rows of a run."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
