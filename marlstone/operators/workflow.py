"""Curation steps as functions of tables: latest rows, publishing, merging, retiring, attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    nth = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(nth)).filter("__nth = 1").drop("__nth")


def earlier(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows but the first of each key, for the archive."""
    nth = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(nth)).filter("__nth > 1").drop("__nth")


def first_line(body: Column) -> Column:
    """The first line that is not blank, a rule, a bracketed note or a summary label."""
    lines = F.filter(F.split(body, "\n", -1), lambda x: (F.btrim(x) != "") & ~F.btrim(x).rlike(r"^(-{3,}|\[.*\]|(?i:summary:).*)$"))
    return F.btrim(F.get(lines, F.lit(0)))


def upserted(kept: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """The loaded rows and the kept rows of other keys; loaded keys are unique."""
    return kept.join(loaded.select(key), key, "left_anti").unionByName(loaded)


def unpublished(approved: DataFrame, published: DataFrame, key: str) -> DataFrame:
    return approved.join(published.select(key), key, "left_anti")


def merged_tags(rows: DataFrame, group: str, tags: str) -> DataFrame:
    """(group, tags): the sorted union of the tags of each group."""
    return rows.select(group, F.explode(tags).alias("t")).groupBy(group).agg(F.array_sort(F.collect_set("t")).alias(tags))


def retired(rows: DataFrame, key: str, ids: DataFrame, reason: str) -> DataFrame:
    """Rows with a retired flag and reason on those whose key is in ``ids``."""
    marks = ids.select(key).distinct().withColumn("retired", F.lit(True))
    return rows.join(marks, key, "left").withColumn("retired", F.coalesce("retired", F.lit(False))).withColumn("retired_reason", F.when(F.col("retired"), F.lit(reason)))


def canonical(ids: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, canonical): the id that a duplicate was resolved to, else itself."""
    return ids.join(resolved, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def run_identity(inputs: Sequence[Column]) -> Column:
    """A digest of inputs, each framed by its length so that different splits differ."""
    framed = [F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in inputs]
    return F.sha2(F.concat_ws("|", *framed), 256)


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null test doesn't."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def decided(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows after approved submissions: (key, fields, version, status).

    A submission's non-null fields win over the row that it updates, whose version goes up by
    one; without such a row it is inserted as version 1. Keys are unique on both sides.
    """
    n = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__new"))
    both = old.join(n, key, "full")
    status = F.when(F.col("__new").isNull(), "kept").when(F.col("version").isNull(), "inserted").otherwise("updated")
    version = F.coalesce("version", F.lit(0)) + F.coalesce(F.col("__new").cast("int"), F.lit(0))
    return both.select(key, *[F.coalesce(f"__{f}", f).alias(f) for f in fields], version.alias("version"), status.alias("status"))
