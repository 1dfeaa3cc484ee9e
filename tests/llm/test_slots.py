"""Slots of keys: what is marked, with far more keys than slots, and how many jobs it takes."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.ngram_join import mixed
from marlstone.llm.slots import slot_levels


def keys_of(batches):
    for batch in batches:
        x = batch.column(0).to_numpy()
        yield mixed(x.astype(np.uint64))
        yield mixed(x[x % 1000 == 0].astype(np.uint64))  # as if of another document
        yield np.repeat(mixed(x[x % 10_000 == 0].astype(np.uint64)), 6)


def test_marks_grow_with_repeated_keys_and_not_with_all(spark):
    n = 1_000_000
    rows = spark.range(n).select("id", F.lit("").alias("text"))
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("slots"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("slots", "")
    try:
        levels = slot_levels(rows, keys_of, 18, (2, 5)).value
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x = np.arange(n)
    keys = mixed(x.astype(np.uint64))
    marked = levels.at_least(keys, 0)
    assert marked[x % 1000 == 0].all() and marked.mean() < 0.05  # four keys a slot: all but a few were marked
    assert levels.at_least(keys, 1)[x % 10_000 == 0].all() and levels.at_least(keys, 1).mean() < 0.01
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("slots")) - before) < 15  # not one a partition


def test_counts_of_many_tasks_add_up(spark):
    rows = spark.range(0, 300, 1, 60).select(F.lit(7).cast("long").alias("id"), F.lit("").alias("text"))

    def once(batches):
        for batch in batches:
            yield np.full(batch.num_rows, 1 << 60, np.uint64)

    for many, told in ((200, True), (150, True)):
        assert slot_levels(rows, once, 18, (2, many)).value.at_least(np.array([1 << 60], np.uint64), 1)[0] == told
    few = rows.limit(149)
    assert not slot_levels(few, once, 18, (2, 150)).value.at_least(np.array([1 << 60], np.uint64), 1)[0]
    none = slot_levels(rows.filter("id < 0"), once, 18, (2, 150)).value
    assert not none.at_least(np.array([1 << 60], np.uint64), 0)[0]
