"""Classes of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small, written


def text_classes(given: DataFrame) -> DataFrame:
    """(id, key, rep) of the rows (id, text): the MD5 of the text and the smallest id with it.

    Only classes of several rows are joined back, by a broadcast unless they are many, so that
    a text that a third of all rows share is dealt out like any other rows.
    """
    keyed = given.select("id", F.md5("text").alias("key"))
    several = written(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "rep"))
    return keyed.join(small(several, 300_000), "key", "left").select("id", "key", F.coalesce("rep", "id").alias("rep"))
