"""Trees of (key, label, parent): closure, descent, chains, depth, leaf collapse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.scratch import written


def closure(tree: DataFrame) -> DataFrame:
    """(key, ancestor, steps), each key its own ancestor at 0 steps.

    The distance doubles each round, so a tree of depth d takes about log2(d) joins. Keys on a
    cycle of parents reach each other, and themselves, by the fewest steps; rounds end when no
    new pair appears.
    """
    known = written(tree.filter("parent IS NOT NULL").select("key", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct())
    reach = 1
    while True:
        top = known.filter(F.col("steps") == reach)
        further = top.join(known.select(F.col("key").alias("ancestor"), F.col("ancestor").alias("far"), F.col("steps").alias("more")), "ancestor")
        further = further.groupBy("key", F.col("far").alias("ancestor")).agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        further = written(further.join(known, ["key", "ancestor"], "left_anti"))
        if further.limit(1).count() == 0:
            break
        known, reach = written(known.union(further)), 2 * reach
    return known.filter("key <> ancestor").union(tree.select("key", F.col("key").alias("ancestor"), F.lit(0).alias("steps")))


def cycles(tree: DataFrame) -> DataFrame:
    """(key): nodes that are above themselves."""
    chain = closure(tree).filter("steps > 0")
    back = chain.select(F.col("key").alias("ancestor"), F.col("ancestor").alias("key"))
    return chain.join(back, ["key", "ancestor"]).select("key").union(tree.filter("key = parent").select("key")).distinct()


def descendants(tree: DataFrame, chain: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(label): labels of all nodes below the wanted keys or labels, and the wanted that aren't nodes."""
    names = tree.sparkSession.createDataFrame([(w,) for w in wanted], "name string")
    roots = tree.join(F.broadcast(names), (F.col("key") == F.col("name")) | (F.col("label") == F.col("name")))
    below = roots.select(F.col("key").alias("ancestor")).join(chain, "ancestor").join(tree.select("key", "label"), "key").select("label")
    unknown = names.join(roots.select("name"), "name", "left_anti").select(F.col("name").alias("label"))
    return below.union(unknown).distinct()


def chain_labels(tree: DataFrame, chain: DataFrame) -> DataFrame:
    """(key, depth, path): the labels from the root to the key."""
    up = chain.join(tree.select(F.col("key").alias("ancestor"), "label"), "ancestor")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("steps", "label")), asc=False), lambda x: x["label"])
    return up.groupBy("key").agg(F.max("steps").alias("depth"), F.array_join(ordered, " -> ").alias("path"))


def dangling(tree: DataFrame) -> DataFrame:
    """Nodes whose parent isn't a node."""
    return tree.filter("parent IS NOT NULL").join(tree.select(F.col("key").alias("parent")), "parent", "left_anti")


def leaves(tags: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, key) without the keys that lie above another key of the same item."""
    above = tags.join(chain.filter("steps > 0"), "key").select("id", F.col("ancestor").alias("key")).distinct()
    return tags.join(above, ["id", "key"], "left_anti")


def nested_options(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, options) of the roots among (key, label, parent, n): each a JSON object with key, label, n and children, by n and key.

    Rows are folded into their parents' rows a level at a time from the deepest up, ``depth`` levels below
    the roots; a node deeper than that, or whose parents lead to no root, is in no tree. A parent's
    children are one row, so trees are those of a vocabulary of options, not of all items.
    """
    level = nodes.filter("parent IS NULL").select("key", F.lit(0).alias("depth"))
    placed = [level]
    for d in range(1, depth + 1):
        level = nodes.join(level.select(F.col("key").alias("parent")), "parent").select("key", F.lit(d).alias("depth"))
        placed.append(level)
    rows = written(reduce(DataFrame.union, placed).join(nodes, "key"))
    below = None
    for d in range(depth, -1, -1):
        own = rows.filter(F.col("depth") == d).withColumn("self", F.to_json(F.struct("key", "label", "n")))
        own = own.withColumn("children", F.lit("")) if below is None else own.join(below, "key", "left")
        own = own.select("key", "parent", "n", F.concat(F.expr("substring(self, 1, length(self) - 1)"), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}")).alias("options"))
        if d == 0:
            return own.select("key", "options")
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key", "options")))
        below = own.groupBy(F.col("parent").alias("key")).agg(F.array_join(F.transform(ordered, lambda x: x["options"]), ",").alias("children"))
