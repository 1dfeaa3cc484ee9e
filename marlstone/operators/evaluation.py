"""Ranking and multi-label metrics, gates, intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.scratch import written


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def label_metrics(predicted: DataFrame, truth: DataFrame, by: str = "value") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per value of the sets (id, value); no base, no rate."""
    p, t = predicted.distinct().withColumn("p", F.lit(1)), truth.distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["id", by], "full").na.fill(0, ["p", "t"])
    n = both.groupBy(by).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(by, "tp", "fp", "fn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def averages(metrics: DataFrame) -> DataFrame:
    """Macro means over the values that have a rate, and micro rates of the pooled counts."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return metrics.agg(F.avg("f1").alias("macro_f1"), _ratio(tp, tp + fp).alias("micro_precision"), _ratio(tp, tp + fn).alias("micro_recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall_at_k over clusters, precision_at_k, reciprocal rank.

    ``ranked`` is (query, id, rank from 1), ``gold`` (query, cluster, id); an item of a cluster
    that a better item covers adds nothing to recall.
    """
    top = ranked.filter(F.col("rank") <= k)
    hit = top.join(gold, ["query", "id"])
    per = hit.groupBy("query").agg(F.countDistinct("cluster").alias("found"), F.countDistinct("id").alias("good"), F.min("rank").alias("first"))
    size = gold.groupBy("query").agg(F.countDistinct("cluster").alias("clusters"))
    out = size.join(per, "query", "left").na.fill(0, ["found", "good"])
    return out.select("query", (F.col("found") / F.col("clusters")).alias("recall_at_k"), (F.col("good") / k).alias("precision_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


#: Rows of a block of a bootstrap, and blocks at most; beyond that, blocks grow.
BLOCK_ROWS, BLOCKS = 1 << 16, 1 << 16


def block_draws(sizes: np.ndarray, block: int, rounds: int, seed: int) -> np.ndarray:
    """How many of the draws of each round fall on a block, when as many are drawn as there are rows in all blocks.

    The draws of a round are split in halves of the blocks by binomials, down to the block; the split of a
    node depends on the seed and the node alone, so all blocks see the same split and the draws of all add up.
    """
    low, high = 0, len(sizes)
    border = np.r_[0, np.cumsum(sizes)]
    draws = np.full(rounds, border[-1], np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        whole, left = border[high] - border[low], border[mid] - border[low]
        share = left / whole if whole else 0.0
        first = np.random.Generator(np.random.PCG64([seed, low, high])).binomial(draws, share)
        draws, low, high = (first, low, mid) if block < mid else (draws - first, mid, high)
    return draws


def bootstrap_sums(values: DataFrame, value: str, rounds: int, seed: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """((round, total) sums of ``rounds`` resamples with replacement, number of rows resampled).

    Rows (id, ``value``) are dealt into blocks by the hash of their id; each block draws its part of every round
    and sends a sum a round, so what is shuffled doesn't grow with draws. Null values aren't rows.
    """
    held = values.select("id", F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    rows = held.count()
    n_blocks = min(BLOCKS, rows // block_rows + 1)
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    sizes = np.zeros(n_blocks, np.int64)
    for r in held.groupBy("block").count().collect():  # BLOCKS rows at most
        sizes[r.block] = r["count"]

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "v"], kind="stable")
        block, v = int(own["block"].iloc[0]), own["v"].to_numpy()
        rng = np.random.Generator(np.random.PCG64([seed, len(sizes), block + len(sizes) + 1]))
        return pd.DataFrame({"round": np.arange(rounds), "total": [float(v[rng.integers(0, len(v), k)].sum()) for k in block_draws(sizes, block, rounds, seed)]})

    parts = held.groupBy("block").applyInPandas(draw, "round int, total double")
    return parts.groupBy("round").agg(F.sum("total").alias("total")), rows


def bootstrap_mean(values: DataFrame, value: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(mean, low, high): the mean of ``rounds`` resamples with replacement and their 95 % interval; an empty table has nulls."""
    sums, rows = bootstrap_sums(values, value, rounds, seed)
    means = sums.select((F.col("total") / F.lit(max(rows, 1))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def violations(metrics: DataFrame, f1: float, recall: float, support: int) -> DataFrame:
    """(value, rule) of the floors that a value misses; ``absent`` is predicted without any truth."""
    true = F.col("tp") + F.col("fn")
    rules = {"f1": F.col("f1") < f1, "recall": (true >= support) & (F.col("recall") < recall), "absent": (true == 0) & (F.col("fp") > 0)}
    missed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return metrics.select("value", F.explode(missed).alias("rule"))


def ranks(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(by, id, rank from 1) in the given order."""
    return rows.select(*by, "id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank"))


def rank_moves(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """(query, median, most): old rank minus new rank of the items in either top k; absent is k + 1."""
    both = old.withColumnRenamed("rank", "a").join(new.withColumnRenamed("rank", "b"), ["query", "id"], "full").na.fill(k + 1, ["a", "b"])
    d = both.withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("query").agg(F.expr("percentile(d, 0.5)").alias("median"), F.max("d").cast("long").alias("most"))


def index_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """(by, low, high, mean, a column per share): the value at index floor(n * share), at most the last.

    With ``nearest`` the index is ceil(n * share) - 1, at least the first.

    Values are counted first, and the running counts are those of different values of a group.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    n = F.col("n")
    at = {k: F.greatest(F.ceil(n * x) - 1, F.lit(0)) if nearest else F.least(F.floor(n * x), n - 1) for k, x in shares.items()}
    columns = [F.min(F.when(F.col("upto") > i, F.col(value))).alias(name) for name, i in at.items()]
    mean = F.round(F.sum(F.col("c") * F.col(value)) / F.sum("c"), 6)
    return placed.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), mean.alias("mean"), *columns)


def field_gates(predicted: DataFrame, baseline: DataFrame, truth: DataFrame, macro: float = 0.7, recall: float = 0.5, support: int = 2) -> DataFrame:
    """(gate, field, value, measured, floor) of what the sets (field, id, value) miss against the truth.

    ``baseline``: a field whose pooled F1 is below that of the baseline's, or is null where that isn't. ``macro``: the mean F1
    of the fields is below its floor. ``recall``: a value of ``support`` or more true items is below its floor.
    ``singleton``: a value of one true item that was missed, which is told and gates nothing (no floor).
    """
    keyed = lambda df: df.select("id", F.struct("field", F.col("value")).alias("value"))
    own = written(label_metrics(keyed(predicted), keyed(truth)).select(F.col("value.field").alias("field"), F.col("value.value").alias("value"), "tp", "fp", "fn", "recall"))
    old = label_metrics(keyed(baseline), keyed(truth)).select(F.col("value.field").alias("field"), "tp", "fp", "fn")
    pooled = lambda df, name: df.groupBy("field").agg(_ratio(2 * F.sum("tp"), F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias(name))
    fields = written(pooled(own, "f1").join(pooled(old, "base"), "field", "full"))
    none = F.lit(None).cast("string")
    lost = fields.filter(F.col("base").isNotNull() & (F.col("f1").isNull() | (F.col("f1") < F.col("base")))).select(F.lit("baseline").alias("gate"), "field", none.alias("value"), F.col("f1").alias("measured"), F.col("base").alias("floor"))
    mean = fields.agg(F.avg("f1").alias("m")).filter(F.col("m").isNull() | (F.col("m") < macro)).select(F.lit("macro"), none, none, "m", F.lit(macro))
    true = F.col("tp") + F.col("fn")
    low = own.filter((true >= support) & (F.col("recall") < recall)).select(F.lit("recall"), "field", "value", "recall", F.lit(recall))
    missed = own.filter((true == 1) & (F.col("tp") == 0)).select(F.lit("singleton"), "field", "value", "recall", F.lit(None).cast("double"))
    return lost.union(mean).union(low).union(missed)
