"""Keeps the postings of a growing table of items up to date, batch by batch, and merges them into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import search_index
from marlstone.operators.search import postings


def keep_postings(spark: SparkSession, source: str, schema: str, target: str, state: str) -> StreamingQuery:
    """Appends the postings of new rows (id, title, body) of the folder ``source`` to ``target``.

    Each micro-batch overwrites its own partition, so a batch that is run again after a failure
    replaces what it wrote. Stops when all present files are done.
    """

    def derive(batch: DataFrame, number: int) -> None:
        rows = postings(batch, "id", {"A": F.col("title"), "D": F.col("body")})
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(derive).option("checkpointLocation", state).trigger(availableNow=True).start()


def keep_batches(spark: SparkSession, source: str, schema: str, target: str, state: str) -> StreamingQuery:
    """Writes what an index needs of new rows (id, title, body) of the folder ``source``, a folder of ``target`` a batch.

    A batch that is run again replaces what it wrote. Rows of a batch that repeat an id must be equal
    (the last one isn't known); a row of a later batch replaces the item. Stops when all present files are done.
    """

    def derive(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["id"])
        texts = search_index.plain_texts(rows, "id", "title", {"A": F.col("title"), "D": F.col("body")})
        texts.write.mode("overwrite").parquet(f"{target}/texts/batch={number}")
        rows.select("id", "title").write.mode("overwrite").parquet(f"{target}/items/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(derive).option("checkpointLocation", state).trigger(availableNow=True).start()


def merge_batches(spark: SparkSession, source: str, target: str) -> None:
    """The index of all batches below ``source``: of each id, the rows of its latest batch."""
    items = spark.read.parquet(f"{source}/items")
    newest = items.groupBy("id").agg(F.max("batch").alias("batch"))
    texts = spark.read.parquet(f"{source}/texts").join(newest, ["id", "batch"], "left_semi")
    search_index.store(texts.drop("batch"), items.join(newest, ["id", "batch"], "left_semi").drop("batch"), target)
