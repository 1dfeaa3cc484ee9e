"""Seeded samples that depend on ids alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.scratch import small, written


def draw(id_col: str, seed: int) -> Column:
    """A hexadecimal number that is drawn by id and seed; any engine with MD5 draws the same."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def shuffled(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in an order drawn by the hash of id and seed."""
    return rows.orderBy(draw(id_col, seed), id_col)


def first_of(rows: DataFrame, id_col: str, by: str, size: int, seed: int) -> DataFrame:
    """Per value of ``by`` the ``size`` rows that are drawn first, in column ``__nth`` from 1.

    Spark keeps the first ``size`` rows of a group in each task before it shuffles, so a value
    with a third of all rows sends a few rows a task.
    """
    nth = Window.partitionBy(by).orderBy(draw(id_col, seed), id_col)
    return rows.withColumn("__nth", F.row_number().over(nth)).filter(F.col("__nth") <= size)


def per_bucket(rows: DataFrame, id_col: str, bucket: str, size: int, seed: int = 1) -> DataFrame:
    """``size`` rows of each bucket."""
    return first_of(rows, id_col, bucket, size, seed).drop("__nth")


def stratified(rows: DataFrame, id_col: str, stratum: str, size: int, seed: int = 1) -> DataFrame:
    """About ``size`` rows, by strata in proportion, cut or filled to exactly ``size``.

    Rows of a stratum are ranked by hash; the first round(share * size) come first and the rest
    fill up in order of rank over all strata.
    """
    total = rows.count()
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    ranked = first_of(rows, id_col, stratum, size, seed).join(F.broadcast(sizes), stratum)  # a row a stratum
    due = F.round(F.col("__n") * size / F.lit(max(total, 1)))
    return ranked.withColumn("__late", (F.col("__nth") > due).cast("int")).orderBy("__late", "__nth", id_col).limit(size).drop("__n", "__nth", "__late")


def greedy_cover(rows: DataFrame, id_col: str, values: str, cover: int, have: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(id, gain, draw): the rows that a greedy cover picks until each value of the arrays occurs in ``cover`` of them.

    Greedy takes the row that has most values still short of their due, of equal ones the one drawn
    first. Here each round takes all rows at once that are best for each of their open values. Such
    rows share no open value, and none that shares one comes before them in the sequence either, so the
    result is that of taking one row after another. Rounds run until no row has an open value; each
    costs a pass over the open values. ``have`` (value, n) counts what is there already. Null and empty
    arrays are never picked; ids must be unique.
    """
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.col(values))).alias("value")).filter("value IS NOT NULL")
    due = each.groupBy("value").agg(F.least(F.count(F.lit(1)), F.lit(cover)).alias("due"))
    if have is not None:
        due = due.join(have.select("value", "n"), "value", "left").select("value", (F.lit(cover) - F.coalesce("n", F.lit(0))).alias("due"))
    due = written(due.filter("due > 0"))
    each = written(each.withColumn("draw", draw("id", seed)))
    picked = None
    while True:
        open_ = each.join(small(due.select("value")), "value")
        gains = written(open_.groupBy("id", "draw").agg(F.count(F.lit(1)).alias("gain")))
        best = open_.select("id", "value").join(gains, "id").groupBy("value").agg(F.min_by(F.struct("id", "gain", "draw"), F.struct(-F.col("gain"), "draw", "id")).alias("b"))
        chosen = written(best.groupBy("b").agg(F.count(F.lit(1)).alias("first")).filter("first = b.gain").select("b.id", "b.gain", "b.draw"))
        if chosen.limit(1).count() == 0:
            return picked if picked is not None else chosen
        picked = chosen if picked is None else picked.union(chosen)
        taken = small(chosen.select("id"))
        met = open_.join(taken, "id", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("met"))
        due = written(due.join(met, "value", "left").select("value", (F.col("due") - F.coalesce("met", F.lit(0))).alias("due")).filter("due > 0"))
        each = written(each.join(taken, "id", "left_anti"))


def layered(rows: DataFrame, id_col: str, values: str, hard: Column, stratum: str, size: int, cover: int = 2, seed: int = 1) -> DataFrame:
    """(id, layer): hard cases of each kind in turn, then a greedy cover of all values, then a stratified fill.

    Layer ``hard`` takes a third of ``size``. Layer ``cover`` adds the rows of :func:`greedy_cover` until each
    value of the array ``values`` is in ``cover`` items of the sample, those of most gain first if
    there is no room for all. The sample never has more than ``size`` items.
    """
    kinds = rows.withColumn("__kind", hard).filter("__kind IS NOT NULL")
    first = first_of(kinds, id_col, "__kind", size, seed).orderBy("__nth", "__kind").limit(size // 3).select(id_col)
    first = written(first.withColumn("layer", F.lit("hard")))
    each = rows.select(id_col, F.explode(F.array_distinct(values)).alias("value"))
    have = each.join(first.select(id_col), id_col, "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    rest = rows.join(first.select(id_col), id_col, "left_anti")
    second = greedy_cover(rest, id_col, values, cover, have, seed + 1)
    second = second.orderBy(F.desc("gain"), "draw", "id").limit(max(0, size - first.count())).select(F.col("id").alias(id_col))
    taken = written(first.union(second.withColumn("layer", F.lit("cover"))))
    left = rows.join(taken.select(id_col), id_col, "left_anti").select(id_col, stratum)
    fill = stratified(left, id_col, stratum, max(0, size - taken.count()), seed + 2).select(id_col)
    return taken.union(fill.withColumn("layer", F.lit("fill")))
