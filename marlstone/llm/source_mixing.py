"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WORD_CLASS, documents, small, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Sources that the tree deals one by one; with more, sources are dealt together by the rest of their number.
STRATA = 10_000
#: Words of a shard, about, and shards at least and at most.
SHARD_WORDS, SHARDS = 1 << 23, (16, 1 << 16)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from the sizes of documents; one row per source.

    Sources in code-point order, null last, take the weights in turn and share the size of all.
    A source stops at ``repeats`` times its size and the excess goes to the others by weight,
    until none is above. The fixed point of that resharing is a water level: sorted by
    repeats * size / weight, the first sources are full and the rest get level * weight, which
    one running sum over the sources finds. The window here is over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(turn, ((F.row_number().over(nth) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    full = per.withColumn("level", level).withColumn("nth", F.row_number().over(rising)).withColumn("full", F.col("ratio") <= F.col("level"))
    # of the first row that isn't full: later rows subtract its cap, also those of the same ratio
    free = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(whole)["level"]
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def shard_quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_ix, quota): how many of each stratum's block draws every shard gets.

    A tree node holds the draws of all strata for a range of 2^k shards. Its left half gets a
    uniform subset of half of them: stratum by stratum, item by item, a draw goes left with
    probability (places left) / (items left). That is an exact multivariate-hypergeometric
    split, by the chain of its conditionals; the quotas of all leaves sum to the root's counts.
    A node is one row of one count per stratum that has draws in it, at most :data:`STRATA`.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    nodes = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_ix", F.col("draws").alias("n")))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")

    def left_of(node: Column, level: int, q: Column, total: Column) -> Column:
        def by_source(state: Column, x: Column) -> Column:
            item = F.aggregate(
                F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(F.array().cast("array<bigint>")),
                F.struct(state["places"].alias("places"), state["items"].alias("items"), F.lit(0).cast("long").alias("got")),
                lambda a, i: let_take(a, _uniform(node, x["source_ix"], i, F.lit(seed * 64 + level))),
            )
            return F.transform(F.array(item), lambda d: F.struct(d["places"].alias("places"), d["items"].alias("items"), F.concat(state["out"], F.array(d["got"])).alias("out")))[0]

        def let_take(a: Column, u: Column) -> Column:
            take = (u * a["items"] < a["places"]).cast("long")
            return F.transform(F.array(take), lambda t: F.struct((a["places"] - t).alias("places"), (a["items"] - 1).alias("items"), (a["got"] + t).alias("got")))[0]

        zero = F.struct(F.floor((total + 1) / 2).cast("long").alias("places"), total.cast("long").alias("items"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(q, zero, by_source, lambda s: s["out"])

    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        nodes = nodes.withColumn("total", total)
        nodes = nodes.withColumn("l", left_of(F.col("node"), level, F.col("q"), F.col("total")))
        half = lambda side: F.transform(
            F.arrays_zip("q", "l"), lambda z: F.struct(z["q"]["source_ix"].alias("source_ix"), (z["l"] if side == 0 else z["q"]["n"] - z["l"]).alias("n"))
        )
        some = lambda side: F.filter(half(side), lambda x: (x["n"] > 0) | (F.col("node") * 2 + side == 0))
        nodes = nodes.select(
            F.explode(F.array(*[F.struct((F.col("node") * 2 + s).alias("node"), some(s).alias("q")) for s in (0, 1)])).alias("x")
        ).select("x.node", "x.q")
        if level >= 3:  # a node each for the tasks; written, as a level reads the one before it twice
            nodes = written(nodes.repartition("node")) if level in (3, 8) else nodes
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source_ix", F.col("x.n").alias("quota"))


def shards_for(words: int) -> int:
    """The power of two that gives shards of about :data:`SHARD_WORDS` words, within :data:`SHARDS`."""
    return min(SHARDS[1], max(SHARDS[0], 1 << (words // SHARD_WORDS).bit_length()))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
    repeats: int = MAX_REPEATS, shards: int | None = None, blocks: int | None = None, block_words: int = 1 << 14, seed: int = 17,
    row: str | None = None,
) -> DataFrame:
    """One row per document and draw: (row, id, size, source_size, target, epoch, taken, shard, place).

    Words of a document are its size. A source's documents fall into hashed blocks of about
    ``block_words`` words (fewer, larger blocks once there would be more than ``blocks``, by
    default 2^16 and at least sixteen a shard). The
    target of a source is whole passes over its blocks and a rest. In each pass the blocks come
    in a hashed order; the rest takes blocks in that order, then documents of the block at the
    border, and cuts the last of these, so that a source's taken words equal its target rounded
    down. Documents that no draw takes have one row with taken 0 and no shard. Block draws are
    dealt to the shards by :func:`shard_quotas`; ``place`` orders a shard's documents at random,
    for a local sort. The number of shards follows the words (:func:`shards_for`) unless it is given.

    ``row`` numbers the rows, so rows of null or repeated ids stay apart; it names a column that
    does so already, or else rows are numbered as they are written first. Draws depend on ids,
    texts' hashes and sources, not on that number: equal inputs give equal results, whatever
    the partitions. Null text has size 0; null is a
    source of its own; repeated rows are separate documents; an empty table gives no rows. The
    windows run over sources, over a source's blocks (bounded by ``blocks``), and over the
    documents of the one block at each source's border.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    number = F.col(row) if row else F.monotonically_increasing_id()
    base = written(docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size"), tie.alias("tie")))
    if shards is None:
        shards = shards_for(base.agg(F.sum("size")).first()[0] or 0)
    blocks = max(1 << 16, 16 * shards) if blocks is None else blocks
    per = source_targets(base.groupBy("source").agg(F.sum("size").alias("size")), weights, repeats)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("source_ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    width = F.greatest(F.lit(block_words), F.ceil(F.sum("source_size").over(whole) / blocks))
    per = per.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / width)).cast("long"))
    per = per.withColumn("quota", F.floor("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    per = written(per.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")))

    located = base.join(small(per), base["source"].eqNullSafe(per["source"])).drop(per["source"])
    located = written(located.withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.col("tie"), F.lit(seed)), F.col("n_blocks"))))

    table = located.groupBy("source_ix", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    shuffled = Window.partitionBy("source_ix").orderBy(F.xxhash64(F.col("source_ix"), F.col("block"), F.lit(seed + 1)), "block")
    table = table.withColumn("before", F.sum("block_size").over(shuffled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_size"))
    draws = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch"))
    part = F.col("epoch") == F.col("passes")
    left = F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - F.col("before")))
    draws = draws.withColumn("take", F.when(part, left).otherwise(F.col("block_size"))).filter("take > 0").withColumn("stratum", F.pmod("source_ix", F.lit(STRATA)))
    order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.col("source_ix"), F.col("block"), F.col("epoch"), F.lit(seed + 2)), "source_ix", "block", "epoch")
    draws = written(draws.select("stratum", "source_ix", "block", "epoch", "take", (F.col("take") < F.col("block_size")).alias("cut"), F.row_number().over(order).cast("long").alias("nth")))

    quotas = shard_quotas(draws.groupBy(F.col("stratum").alias("source_ix")).agg(F.count(F.lit(1)).alias("draws")), shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("source_ix").orderBy("shard"))
    ranges = quotas.withColumn("high", upto).withColumn("low", F.col("high") - F.col("quota")).filter("quota > 0")
    ranges = ranges.select(F.col("source_ix").alias("stratum"), "shard", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("nth"))
    dealt = draws.join(ranges, ["stratum", "nth"]).drop("nth")  # one row per draw on either side
    drawn = dealt.groupBy("source_ix", "block").agg(F.collect_list(F.struct("epoch", "shard", "take", "cut")).alias("draws"))  # at most repeats + 1 entries
    drawn = small(written(drawn), 1 << 18)

    kept = ["row", "id", "size", "source_size", "target"]
    rows = located.join(drawn, ["source_ix", "block"], "left").select(*kept, "tie", "source_ix", "block", F.explode_outer("draws").alias("d"))
    d = F.col("d")
    plain = rows.filter(d.isNull() | ~d["cut"]).select(*kept, "tie", d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.when(d.isNull(), F.lit(0)).otherwise(F.col("size")).cast("long").alias("taken"))
    inside = Window.partitionBy("source_ix", "block").orderBy(F.xxhash64(F.col("id"), F.col("tie"), F.lit(seed + 3)), "id", "size", "tie", "row")
    ahead = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    border = rows.filter(d["cut"]).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), d["take"] - ahead)).cast("long"))
    border = border.select(*kept, "tie", d["epoch"].alias("epoch"), F.when(F.col("taken") > 0, d["shard"]).alias("shard"), "taken")
    out = plain.union(border)
    return out.select(*kept, "epoch", "taken", "shard", F.xxhash64(F.col("id"), F.col("tie"), F.col("epoch"), F.lit(seed + 4)).alias("place"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each, repeats counted, and the shard and place of each draw.

    A row of ``documents`` is a row here, whether its id is null or repeated.
    """
    drawn = mix(documents(spark, sf_dir))
    where = F.sort_array(F.collect_list(F.when(F.col("taken") > 0, F.struct("shard", "place", "taken"))))
    per = drawn.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("id", "size", "source_size", "target")], F.sum("taken").alias("taken"), F.count("shard").alias("draws"), where.alias("placed")
    )
    return per.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "draws", "placed")
