"""Connected components of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links (x, y); the label is the smallest id of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so chains shorten by half. Rounds are written to the shared folder; nothing but the
    flag whether a label changed reaches the driver.
    """
    both = written(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("label")).select("id", F.least("id", "label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = written(low.join(jump, "low").select("id", "old", F.least("low", "far").alias("label")))
        if new.filter("label < old").limit(1).count() == 0:
            return new.select("id", "label")
        labels = new.select("id", "label")
