"""Facet counts that leave a category's own filter out, and their roll-up along a tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def true_counts(items: DataFrame, categories: Sequence[str], active: dict[str, Sequence[str]]) -> DataFrame:
    """(category, value, n): items with the value that pass the filters of all other categories.

    One pass: an item that fails no active filter counts for all its values, one that fails
    exactly one counts for that category's values only, others not at all.
    """
    fails = [
        F.when(~F.coalesce(F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in active[c]])), F.lit(False)), F.lit(c)) if active.get(c) else F.lit(None).cast("string")
        for c in categories
    ]
    rows = items.withColumn("__failed", F.array_compact(F.array(*fails))).filter(F.size("__failed") <= 1)
    options = F.flatten(F.array(*[F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), _option(c)) for c in categories]))
    each = rows.select("__failed", F.explode(options).alias("o"))
    each = each.filter((F.size("__failed") == 0) | (F.get("__failed", F.lit(0)) == F.col("o.category")))
    return each.groupBy(F.col("o.category").alias("category"), F.col("o.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _option(category: str):
    return lambda v: F.struct(F.lit(category).alias("category"), v.alias("value"))


def rolled_up(tags: DataFrame, closure: DataFrame) -> DataFrame:
    """(key, n): different items with the key or one below it; tags are (id, key), closure (key, ancestor)."""
    return tags.join(closure, "key").groupBy(F.col("ancestor").alias("key")).agg(F.countDistinct("id").alias("n"))
