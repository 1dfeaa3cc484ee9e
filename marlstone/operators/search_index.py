"""A stored index for faceted search: bucketed lists of postings in blocks, merged from batches.

Below the index's folder lie tables. ``word``, ``title`` and ``summary`` have a row per key and block:
``best`` and ``n`` of the block and its entries. Keys are dealt into buckets, which are folders, and
sorted, so a search reads the folders of its keys only and skips most of each. A block holds items that
lie together, so it is turned into lists where it lies and no posting is shuffled; a key that most items
have is many rows of bounded size. ``items`` has ids, titles and the columns that facets test, but no texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import search as S
from marlstone.plans.scratch import bounded_batches, written

#: Folders of a table; items and bytes of text of a block at most; tasks a core that write a table, and so files of a folder.
BUCKETS, BLOCK, BLOCK_BYTES, TASKS = 32, 4096, 16 << 20, 4


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _grams(words: pa.Array, word: np.ndarray, doc: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(trigrams, number of a trigram, item) of the pairs (number of a word, item); each word's trigrams are cut once."""
    known: dict[str, int] = {}
    cut = [[known.setdefault(p[i : i + 3], len(known)) for i in range(len(p) - 2)] for p in (f"  {w} " for w in words.to_pylist())]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((g for c in cut for g in c), np.int64, int(sizes.sum()))
    begins, own = np.r_[0, np.cumsum(sizes)][:-1], sizes[word]
    within = np.arange(int(own.sum())) - np.repeat(np.r_[0, np.cumsum(own)][:-1], own)
    return pa.array(list(known), pa.string()), flat[np.repeat(begins[word], own) + within], np.repeat(doc, own)


def _lists_of_block(table: pa.Table, weights: Sequence[float] | None, block: int) -> pa.RecordBatch:
    """The lists of some items (id, plain texts ...): words with the weight of their heaviest text, which comes first, or
    without weights the trigrams with the number of different ones of their item."""
    ids, n = table.column(0).combine_chunks(), max(1, table.num_rows)
    cut = [pc.split_pattern(table.column(k).combine_chunks(), " ") for k in range(1, table.num_columns)]
    section = np.repeat(np.arange(len(cut)), [len(c.flatten()) for c in cut])
    doc = np.concatenate([pc.list_parent_indices(c).to_numpy(zero_copy_only=False) for c in cut]).astype(np.int64)
    encoded = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
    keys, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(keys, "").to_numpy(zero_copy_only=False)[code]
    packed = np.sort((code[real] * n + doc[real]) * len(cut) + section[real])
    pair, section = np.divmod(packed, len(cut))
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    pair, section = pair[first], section[first]
    if weights is None:
        keys, code, doc = _grams(keys, *np.divmod(pair, n))
        pair = np.sort(code * n + doc)
        pair = pair[np.r_[True, pair[1:] != pair[:-1]][: len(pair)]]
    code, doc = np.divmod(pair, n)
    weight = np.bincount(doc, minlength=n)[doc].astype(float) if weights is None else np.asarray(weights)[section]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    edges = pa.array(np.r_[starts, len(code)].astype(np.int32))
    best = np.maximum.reduceat(weight, starts) if len(starts) else weight
    columns = [keys.take(pa.array(code[starts])), pa.array(np.full(len(starts), block)), pa.array(best), pa.array(np.diff(np.r_[starts, len(code)]))]
    columns += [pa.ListArray.from_arrays(edges, ids.take(pa.array(doc))), pa.ListArray.from_arrays(edges, pa.array(weight))]
    return pa.RecordBatch.from_arrays(columns, ["key", "block", "best", "n", "ids", "weights"])


def _write_lists(rows: DataFrame, weights: Sequence[float] | None, block: int, target: str) -> None:
    """Writes the lists of rows (id, plain texts ...) by bucket, key and block. Blocks are numbered by their task."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - sum(b.num_rows for b in held))
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.nbytes
                if size > BLOCK_BYTES or sum(b.num_rows for b in held) >= block:
                    yield _lists_of_block(pa.Table.from_batches(held), weights, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield _lists_of_block(pa.Table.from_batches(held), weights, number)

    most = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    kind = rows.schema["id"].dataType.simpleString()
    lists = bounded_batches(rows).coalesce(most).mapInArrow(invert, f"key string, block long, best double, n long, ids array<{kind}>, weights array<double>")
    lists.withColumn("bucket", _bucket(F.col("key"))).sortWithinPartitions("bucket", "key", "block").write.mode("overwrite").partitionBy("bucket").parquet(target)


def plain_texts(items: DataFrame, id_col: str, title: str, sections: dict[str, Column], summary: str | None = None) -> DataFrame:
    """(id, plain texts of the sections by their names, of the title and of a summary): what a batch adds to an index."""
    texts = sections | {"title": F.col(title)} | ({"summary": F.col(summary)} if summary else {})
    return items.select(F.col(id_col).alias("id"), *[T.plain(c).alias(name) for name, c in texts.items()])


def store(texts: DataFrame, items: DataFrame, target: str, block: int = BLOCK) -> None:
    """Writes the index of :func:`plain_texts` and of items (id, title and facet columns) to a folder.

    Ids are unique; words of rows that repeat one are put together. Blocks grow in number with the items. A run that is repeated replaces what it wrote.
    """
    items.write.mode("overwrite").parquet(f"{target}/items")
    names = sorted((c for c in texts.columns if c in S.SECTION_WEIGHTS), key=lambda s: -S.SECTION_WEIGHTS[s])
    _write_lists(S.one_row_an_id(texts.select("id", *names)), [S.SECTION_WEIGHTS[s] for s in names], block, f"{target}/word")
    for leg in ("title", "summary"):
        rows = texts.select("id", leg) if leg in texts.columns else texts.select("id", F.lit("").alias(leg)).limit(0)
        _write_lists(rows, None, block, f"{target}/{leg}")


def build(items: DataFrame, id_col: str, title: str, sections: dict[str, Column], target: str, facets: Sequence[str] = (), summary: str | None = None, block: int = BLOCK) -> None:
    """Indexes all items at once."""
    store(plain_texts(items, id_col, title, sections, summary), items.select(F.col(id_col).alias("id"), F.col(title).alias("title"), *facets), target, block)


_LISTS = "key string, block long, best double, n long, ids array<{id}>, weights array<double>, bucket int"


def _read(spark: SparkSession, source: str, kind: str, keys: Sequence[str], id_type: str) -> DataFrame:
    """The lists of some keys: other folders aren't opened, and of these only the parts that may have the keys are read."""
    wanted = spark.range(1).select(F.array_distinct(F.array(*[_bucket(F.lit(k)) for k in keys]))).first()[0] if keys else []
    lists = spark.read.schema(_LISTS.format(id=id_type)).parquet(f"{source}/{kind}")
    return lists.filter(F.col("bucket").isin(wanted) & F.col("key").isin(list(keys)))


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("key", F.explode(F.arrays_zip("ids", "weights")).alias("e")).select("key", F.col("e.ids").alias("id"), F.col("e.weights").alias("weight"))


def _similar(spark: SparkSession, source: str, kind: str, query: str, id_type: str) -> DataFrame:
    """(id, sim): trigram similarity above 0 of the query and a text of each item, from the lists of the query's trigrams."""
    grams = spark.range(1).select(T.trigrams(F.lit(query))).first()[0]
    both = _entries(_read(spark, source, kind, grams, id_type)).groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("weight").alias("n"))
    return both.select("id", (F.col("c") / (F.col("n") + len(grams) - F.col("c"))).alias("sim"))


def search(spark: SparkSession, source: str, request: S.Request, synonyms=(), live: Column | None = None, summary: bool = False) -> DataFrame:
    """The page that ``search.search`` finds over all items, from the index alone: (id, title, rank, total).

    Only lists of the query's words and trigrams and the table of items are read, no texts.
    """
    items = spark.read.parquet(f"{source}/items")
    held = items
    for test in [*S.facet_filter(request), *([live] if live is not None else [])]:
        held = held.filter(test)
    groups = S.expand(request.query, synonyms)
    if not groups:
        return S.page_of_ranked(held.select("id", "title", F.lit(0.0).alias("rank")), request)
    kind = items.schema["id"].dataType.simpleString()
    hits = S.matched(_entries(_read(spark, source, "word", S.wanted_words(groups), kind)).withColumnRenamed("key", "word"), groups)
    alike = _similar(spark, source, "title", request.query, kind).withColumnRenamed("sim", "alike")
    found = hits.join(alike, "id", "full")
    if summary:
        told = _similar(spark, source, "summary", request.query, kind).select("id", (S.SUMMARY * F.col("sim")).alias("told"))
        found = found.join(told, "id", "left")
    else:
        found = found.withColumn("told", F.lit(0.0))
    found = found.fillna(0.0, ["alike", "told", "score"]).fillna(0, ["hits"]).filter((F.col("hits") > 0) | (F.col("alike") >= S.FUZZY))
    scored = written(found.join(held.select("id", "title"), "id").select("id", "title", "alike", "told", "hits", "score"))
    return S.page_of(scored, len(groups), request)


def top_matches(spark: SparkSession, source: str, query: str, k: int, synonyms=()) -> DataFrame:
    """(id, score): the ``k`` items of highest text score that match all groups of a query; equal scores by id.

    The heaviest weight of each list bounds the scores in a block. Blocks of the highest bounds are scored until
    they hold ``k`` matches; of the others only those are read whose bound reaches the k-th score.
    """
    groups = S.expand(query, synonyms)
    kind = spark.read.parquet(f"{source}/items").schema["id"].dataType.simpleString()
    lists = _read(spark, source, "word", S.wanted_words(groups), kind)
    if not groups:
        return spark.createDataFrame([], f"id {kind}, score double")
    # the same scores over the best weights of a block are bounds of those of its items
    bounds = S.matched(lists.select(F.col("block").alias("id"), F.col("key").alias("word"), F.col("best").alias("weight")), groups)
    bounds = written(bounds.filter(F.col("hits") == len(groups)).select(F.col("id").alias("block"), F.col("score").alias("bound")))

    def scored(blocks: DataFrame) -> DataFrame:
        mine = lists.join(F.broadcast(blocks), "block", "left_semi")  # a row per BLOCK items
        return S.matched(_entries(mine).withColumnRenamed("key", "word"), groups).filter(F.col("hits") == len(groups)).select("id", "score")

    n, many = bounds.count(), 1
    while True:
        first = bounds.orderBy(F.desc("bound"), "block").limit(many)
        best = scored(first).orderBy(F.desc("score"), "id").limit(k)
        held = best.collect()  # k rows at most
        if len(held) == k or many >= n:
            break
        many *= 4
    least = held[-1].score if len(held) == k else 0.0
    return scored(bounds.filter(F.col("bound") >= least)).orderBy(F.desc("score"), "id").limit(k)
