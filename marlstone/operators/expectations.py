"""Declared expectations over a table, all checked in one pass, with the rows that fail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Expectation:
    """What each row must meet: ``test``, where ``when`` holds (everywhere if None). A null test is a failure.

    ``at_most`` rows may fail; ``at_least`` rows must be there to be tested.
    """

    name: str
    test: Column
    when: Column | None = None
    at_most: int = 0
    at_least: int = 0

    def applies(self) -> Column:
        return F.lit(True) if self.when is None else F.coalesce(self.when, F.lit(False))

    def fails(self) -> Column:
        return self.applies() & ~F.coalesce(self.test, F.lit(False))


def checked(rows: DataFrame, expected: Sequence[Expectation]) -> DataFrame:
    """(expectation, tested, failed, met) of all expectations, from one scan of the table and one row a task."""
    counts = [c for k, e in enumerate(expected) for c in (F.count_if(e.applies()).alias(f"t{k}"), F.count_if(e.fails()).alias(f"f{k}"))]
    told = F.array(*[
        F.struct(F.lit(e.name).alias("expectation"), F.col(f"t{k}").alias("tested"), F.col(f"f{k}").alias("failed"), ((F.col(f"f{k}") <= e.at_most) & (F.col(f"t{k}") >= e.at_least)).alias("met"))
        for k, e in enumerate(expected)
    ])
    return rows.agg(*counts).select(F.inline(told))


def failing(rows: DataFrame, key: str, expected: Sequence[Expectation]) -> DataFrame:
    """(key, expectation) of every row and each expectation that it fails."""
    names = F.array_compact(F.array(*[F.when(e.fails(), F.lit(e.name)) for e in expected]))
    return rows.select(key, F.explode(names).alias("expectation"))


def distribution(rows: DataFrame, values: Column, vocabulary: Sequence[str], off: str = "(off vocabulary)") -> DataFrame:
    """(value, n) of each value of a closed vocabulary, those that don't occur with 0, and of all others together.

    A row counts once for each different value of its array ``values``; null and empty arrays count for none.
    """
    spark = rows.sparkSession
    each = rows.select(F.explode(F.array_distinct(values)).alias("v"))
    each = each.select(F.when(F.col("v").isin(list(vocabulary)), F.col("v")).otherwise(F.lit(off)).alias("value"))
    named = spark.createDataFrame([(v,) for v in [*vocabulary, off]], "value string")
    return named.join(each.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
